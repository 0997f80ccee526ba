"""Posting driven by a stream of invoice status edits.

Each micro-batch of edits (invoice_id, status, edited_at) is one commit: the
edits (the latest of an invoice wins, of equally late ones the greatest
status), the posting of what is open then (gate, cascade, processed flag), and
the edits with an unknown status or invoice, which go to the table
``edit_reject``. A refused posting keeps the edits: its invoices stay open and
are tried again with the next batch. Only the invoice folders with open or
edited rows are written. The commit bears the batch's tag, so a batch replayed
after a failure is skipped; the stream's own progress is kept in a checkpoint
folder under the shared work folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.posting import Posting, post_invoices, with_statuses
from ..session import scratch_path, work_dir
from ..sources.tables import TableStore

EDIT = S.EDIT


def latest_edits(edits: DataFrame) -> DataFrame:
    """(invoice_id, status): the latest known status of each edited invoice."""
    known = edits.where(F.col("status").isin(list(S.STATUSES)) & F.col("invoice_id").isNotNull())
    return known.groupBy("invoice_id").agg(F.max(F.struct("edited_at", "status"))["status"].alias("status"))


def apply_status_edits(invoice: DataFrame, edits: DataFrame) -> DataFrame:
    """Invoices with the latest edited status of each edited invoice."""
    return with_statuses(invoice, latest_edits(edits))


def rejected_edits(invoice: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of an unknown status, or of an invoice that does not exist."""
    bad = ~F.coalesce(F.col("status").isin(list(S.STATUSES)), F.lit(False))
    missing = edits.where(~bad).join(invoice.select("invoice_id"), "invoice_id", "left_anti")
    return edits.where(bad).unionByName(missing.select(*edits.columns))


def posting_batch(store: TableStore, status: str = S.STATUS_INVOICE, parity: bool = False,
                  log: list[Posting] | None = None, name: str = "posting") -> Callable[[DataFrame, int], None]:
    """The handler of a micro-batch; ``name`` and the batch id are the tag of
    its commit."""
    def handle(edits: DataFrame, batch_id: int) -> None:
        tag = f"{name}:{batch_id}"
        if store.has_tag(tag):
            return
        work_dir(store.spark)
        latest = latest_edits(edits).checkpoint()   # one row an edited invoice; read by several jobs
        rejects = rejected_edits(store.read("invoice"), edits).checkpoint()
        append = {} if rejects.isEmpty() else {"edit_reject": rejects}
        result = post_invoices(store, status, parity, edits=latest, append=append, tag=tag)
        if log is not None:
            log.append(result)
    return handle


def start_posting_stream(spark: SparkSession, store: TableStore, edits_path: str, *,
                         status: str = S.STATUS_INVOICE, parity: bool = False,
                         checkpoint: str | None = None, available_now: bool = True,
                         log: list[Posting] | None = None) -> StreamingQuery:
    """Post every batch of edit files arriving in ``edits_path`` (parquet).
    Batch ids count from 0 in each ``checkpoint`` folder, so the tag names it."""
    folder = checkpoint or scratch_path(spark, "posting-stream")
    edits = spark.readStream.schema(EDIT).parquet(edits_path)
    writer = (edits.writeStream.foreachBatch(posting_batch(store, status, parity, log, f"posting:{folder}"))
              .option("checkpointLocation", folder))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
