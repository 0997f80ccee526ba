"""Three-way merge of an edited table: what one user changed since the version
they opened, over what others have saved meanwhile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir
from .keys import with_key_check


@dataclass
class Merge:
    result: DataFrame     # the merged table
    conflicts: DataFrame  # the keys, and base, theirs, mine as structs (null: no such row)
    rejects: DataFrame    # rows with a repeated or incomplete key: source and the row


def merge_edits(base: DataFrame, theirs: DataFrame, mine: DataFrame, keys: list[str]) -> Merge:
    """``mine`` was edited from ``base``; ``theirs`` is the table as it is now.

    By key: a row that I did not change is theirs, one that they did not change
    is mine (insertions and deletions are changes); changed by both in the same
    way it is that; changed by both in different ways it is a conflict, and
    theirs stays. Rows are compared whole and null-safe, in the columns of
    ``base``. Rows of ``theirs`` whose key is repeated or incomplete pass into the
    result as they are; all such rows are ``rejects``.

    The three tables are one union grouped by key, at most a row from each: no
    full outer join, and partial aggregates before the one shuffle."""
    columns = base.columns
    others = [c for c in columns if c not in keys]
    work_dir(base.sparkSession)
    rows = None
    for source, df in (("base", base), ("theirs", theirs), ("mine", mine)):
        checked = with_key_check(df.select(*columns), keys).withColumn("_source", F.lit(source))
        rows = checked if rows is None else rows.unionByName(checked)
    rows = rows.checkpoint()   # the three versions are read once
    off = rows.where("NOT _unique")

    row = F.struct(F.lit(True).alias("_there"), *others)

    def of(source: str) -> Column:
        return F.max(F.when(F.col("_source") == source, row)).alias(f"_{source}")

    three = rows.where("_unique").groupBy(*keys).agg(of("base"), of("theirs"), of("mine"))
    b, t, m = F.col("_base"), F.col("_theirs"), F.col("_mine")
    kept, unchanged, alike = b.eqNullSafe(m), b.eqNullSafe(t), t.eqNullSafe(m)
    three = three.withColumn("_conflict", ~(kept | unchanged | alike)).withColumn("_now", F.when(kept | ~unchanged, t).otherwise(m))
    result = three.where(F.col("_now").isNotNull()).select(*[F.col(c) if c in keys else F.col(f"_now.{c}").alias(c) for c in columns])
    passed = off.where(F.col("_source") == "theirs").select(*columns)

    def plain(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{x}").alias(x) for x in others])).alias(c[1:])

    conflicts = three.where("_conflict").select(*keys, plain("_base"), plain("_theirs"), plain("_mine"))
    return Merge(result.unionByName(passed), conflicts, off.select(F.col("_source").alias("source"), *columns))
