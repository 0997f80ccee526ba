"""Purchases recorded from a stream of purchase entries.

Each micro-batch of entries (purchase_id, product_id, quantity, unit_id,
total_price) becomes one commit: stock up and purchase history rows together
(``actions.record_purchases``). The commit carries the stream's checkpoint
folder and batch id as its tag, so a batch replayed after a failure is recognised and not added
twice: exactly-once stock updates on top of the stream's own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.actions import Applied, record_purchases
from ..sources.tables import TableStore

ENTRY = T.StructType([
    T.StructField("purchase_id", T.StringType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("total_price", S.MONEY),
])


def start_purchase_stream(spark: SparkSession, store: TableStore, entries_path: str, *, checkpoint: str,
                          name: str = "purchases", available_now: bool = True,
                          log: list[Applied] | None = None) -> StreamingQuery:
    """Record every batch of entry files arriving in ``entries_path`` (parquet).
    Batch ids count from 0 in each ``checkpoint`` folder, so the tag names the
    folder too: a stream started anew with another folder skips nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        res = record_purchases(store, batch, tag=f"{name}:{checkpoint}:{batch_id}")
        if log is not None:
            log.append(res)

    stream = spark.readStream.schema(ENTRY).parquet(entries_path)
    writer = (stream.writeStream.foreachBatch(handle)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
