"""Key checks: split rows with duplicate or missing keys into a reject table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_key_check(df: DataFrame, keys: list[str], valid: Column | None = None, flag: str = "_unique") -> DataFrame:
    """``df`` with a boolean ``flag``: its key is complete, held by this row
    only and (with ``valid``) the row condition holds.

    The repeated keys are found by one grouped count (partial counts per task,
    so one hot key costs one row per task in the shuffle) and meet the rows in
    one left join; no window buffers a whole key group."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if valid is not None:
        complete = complete & F.coalesce(valid, F.lit(False))
    repeated = (df.where(complete).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                .where(F.col("_n") > 1).select(*keys, F.lit(True).alias("_repeated")))
    return df.join(repeated, keys, "left").select(*df.columns, (complete & F.col("_repeated").isNull()).alias(flag))


def split_duplicates(df: DataFrame, keys: list[str], valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is unique and complete, all other rows). ``valid`` is an
    optional extra row condition; rows failing it are rejected too."""
    checked = with_key_check(df, keys, valid)
    return checked.where("_unique").select(*df.columns), checked.where("NOT _unique").select(*df.columns)
