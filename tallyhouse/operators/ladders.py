"""Unit ladders of any depth: a product's ladder is the ascending list of its
own unit ids (coarse to fine), taken from the data.

A ladder is one array of at most MAX_UNITS ids per product. Whether a product
has more is found by a count, before anything is collected; rows of such a
product, rows that repeat a (product, unit) and rows without one are rejects.
Pairs and neighbours are read off the array by position, so no product's rows
are joined with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import with_key_check

MAX_UNITS = 64
KEY = ["product_id", "unit_id"]


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_unique``: the key is complete, unique, and its product
    has MAX_UNITS units at most. Both counts are grouped, with a partial stage;
    the products with too many units are few and meet the rows in a left join."""
    keyed = with_key_check(rows, KEY)
    long = (rows.where(F.col("product_id").isNotNull() & F.col("unit_id").isNotNull()).groupBy(*KEY).agg(F.lit(1).alias("_one"))
            .groupBy("product_id").agg(F.count(F.lit(1)).alias("_units")).where(F.col("_units") > MAX_UNITS)
            .select("product_id", F.lit(True).alias("_long")))
    return keyed.join(long, "product_id", "left").select(*rows.columns, (F.col("_unique") & F.col("_long").isNull()).alias("_unique"))


def split_ladder_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stand on a ladder, rejects) of a table keyed by (product, unit)."""
    checked = _checked(rows)
    return checked.where("_unique").drop("_unique"), checked.where("NOT _unique").drop("_unique")


def ladders(valid: DataFrame, *columns: str) -> DataFrame:
    """(product_id, ladder): the product's units as structs (unit_id,
    ``columns``), ascending. ``valid`` holds rows of ``split_ladder_rows``."""
    return valid.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("unit_id", *columns))).alias("ladder"))


def pairs(ladder: str | Column = "ladder") -> Column:
    """array<struct<coarse, fine>>: every two units of a ladder."""
    units = F.col(ladder) if isinstance(ladder, str) else ladder
    return F.flatten(F.transform(units, lambda x, i: F.transform(
        F.slice(units, i + 2, F.size(units)), lambda y: F.struct(x.alias("coarse"), y.alias("fine")))))


def neighbours(ladder: str | Column = "ladder") -> Column:
    """array<struct<coarse, fine>>: each unit but the coarsest with the next
    coarser one."""
    units = F.col(ladder) if isinstance(ladder, str) else ladder
    return F.zip_with(F.slice(units, F.lit(1), F.greatest(F.size(units) - 1, F.lit(0))), F.slice(units, F.lit(2), F.size(units)),
                      lambda x, y: F.struct(x.alias("coarse"), y.alias("fine")))
