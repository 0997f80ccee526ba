"""Dense, ordered id assignment without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import work_dir

_POS_BITS = 33  # monotonically_increasing_id keeps the in-partition position in the low 33 bits


def with_consecutive_ids(df: DataFrame, order_by: list[str], id_col: str,
                         offset: DataFrame | None = None) -> DataFrame:
    """Add ``id_col`` = offset + 1-based rank of the row in the order of
    ``order_by``, which must be unique per row (else a ValueError).

    ``row_number()`` over an unpartitioned window would run in one task. Here
    the rows are range-partitioned and sorted by the order columns, each
    partition counts its rows, an exclusive prefix sum over the partition
    counts (one row per partition: a size bound known in advance) gives each
    partition its first id, and every row adds its position in the partition.
    The rows are checkpointed with their partition and position first: a range
    partitioning that is worked out twice may deal the rows out differently.
    ``offset`` is a one-row, one-column DataFrame (e.g. the current max id); it
    enters the prefix sum as one more row and is never collected.
    """
    ranged = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_pos", F.col("_pos") - F.shiftleft(F.col("_pid").cast("long"), _POS_BITS))
    work_dir(df.sparkSession)
    ranged = ranged.checkpoint()
    if ranged.groupBy(*order_by).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows repeat in the order of {order_by}")
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).cast("long").alias("_n"))
    if offset is not None:
        # the offset enters as a pseudo-partition -1 whose "count" is the offset
        counts = counts.unionByName(offset.select(
            F.lit(-1).alias("_pid"), F.col(offset.columns[0]).cast("long").alias("_n")))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = ranged.join(F.broadcast(starts), "_pid").withColumn(
        id_col, (F.col("_start") + F.col("_pos") + 1).cast("long"))
    return out.drop("_pid", "_pos", "_start")
