"""Open demand kept over a stream of lines and invoice changes.

``demand`` reads all lines for each answer. Here the two kinds of events meet
in keyed state, and only changes come out: a new line of an open invoice adds
its quantity, an invoice that opens or closes adds or takes back the sums of its
lines. The changes go to Parquet files by the stream's own exactly-once sink;
``current_demand`` sums them and equals ``demand`` over all events, however they
are split into batches and in whatever order they come.

* State is kept per (invoice, part): a line goes to a part by its product and
  unit, an invoice change to all parts of its invoice, so a hot invoice is spread
  over ``parts`` tasks. A part holds one sum per (product, unit), not its lines.
* Of an invoice the latest change holds (``changed_at``, then status and flag).
* A line that comes again is dropped while its ``at`` is not older than the
  watermark; the ids before it are forgotten, which bounds the state. Late lines
  that come for the first time count.
* Lines and changes without an invoice id are left out, as ``demand`` does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas as S

LINE = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("invoice_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("txn_type", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_id", T.IntegerType()),
    T.StructField("at", T.TimestampType()),
])
CHANGE = T.StructType([
    T.StructField("invoice_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("is_process", T.IntegerType()),
    T.StructField("changed_at", T.TimestampType()),
])
DELTA = T.StructType([
    T.StructField("cell", T.StringType()),       # product and unit as JSON, so that blank ones stay blank
    T.StructField("quantity", T.DoubleType()),
    T.StructField("n_lines", T.LongType()),
    T.StructField("n_known", T.LongType()),      # lines with a quantity
])
_CELL = "product_id bigint, unit_id int"
PARTS = 8


def events(lines: DataFrame, changes: DataFrame, txn_type: str = S.TXN_OUT, status: str = S.STATUS_INVOICE,
           parts: int = PARTS) -> DataFrame:
    """(invoice_id, part, line, at, cell, quantity, open, rank): lines of
    ``txn_type`` and invoice changes as one table. ``rank`` orders the changes
    of an invoice, null for lines."""
    mine = lines.where((F.col("txn_type") == txn_type) & F.col("invoice_id").isNotNull()).select(
        "invoice_id", F.pmod(F.xxhash64("product_id", "unit_id"), F.lit(parts)).cast("int").alias("part"), F.col("transaction_id").alias("line"), "at",
        F.to_json(F.struct("product_id", "unit_id")).alias("cell"), "quantity", F.lit(False).alias("open"), F.lit(None).cast("string").alias("rank"))
    # microseconds of 19 digits with a bias, so that their text orders as they do
    micros = F.lpad((F.unix_micros("changed_at") + F.lit(10**18)).cast("string"), 19, "0")
    rank = F.concat_ws("|", F.coalesce(micros, F.lit("")), F.coalesce("status", F.lit("")), F.coalesce(F.col("is_process").cast("string"), F.lit("")))
    opens = F.coalesce((F.col("status") == status) & (F.col("is_process") == 0), F.lit(False))
    moved = changes.where(F.col("invoice_id").isNotNull()).select(
        "invoice_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(None).cast("string").alias("line"), F.col("changed_at").alias("at"),
        F.lit(None).cast("string").alias("cell"), F.lit(None).cast("double").alias("quantity"), opens.alias("open"), rank.alias("rank"))
    return mine.unionByName(moved)


def keep_demand(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The changes of the open demand that one part's events make. State, as
    JSON: the latest change, the cells' [quantity, n_lines, n_known], the ids
    that may come again with their times."""
    kept = json.loads(state.get[0]) if state.exists else {"rank": "", "open": False, "cells": {}, "seen": {}}
    cells, seen = kept["cells"], kept["seen"]
    was_open, before = kept["open"], {}
    horizon = state.getCurrentWatermarkMs()
    for frame in frames:
        times = (frame["at"].astype("datetime64[ms]").astype("int64")).where(frame["at"].notna(), 0)
        for line, cell, quantity, opens, rank, at in zip(frame["line"], frame["cell"], frame["quantity"], frame["open"], frame["rank"], times, strict=True):
            if rank is not None:
                if rank >= kept["rank"]:
                    kept["rank"], kept["open"] = rank, bool(opens)
                continue
            if line is not None:
                if line in seen:
                    continue
                seen[line] = int(at)
            total = cells.setdefault(cell, [0.0, 0, 0])
            before.setdefault(cell, list(total))
            total[1] += 1
            if not pd.isna(quantity):
                total[0], total[2] = total[0] + quantity, total[2] + 1
    kept["seen"] = {line: at for line, at in seen.items() if at >= horizon}
    state.update((json.dumps(kept),))
    none = [0.0, 0, 0]
    # an invoice that stays open gives the cells touched; one that opens or closes gives all
    changed = (before if was_open else {}) if kept["open"] == was_open else cells
    rows = []
    for cell in changed:
        old, new = (before.get(cell, cells[cell]) if was_open else none), (cells[cell] if kept["open"] else none)
        rows.append((cell, *(b - a for a, b in zip(old, new, strict=True))))
    if rows:
        yield pd.DataFrame(rows, columns=DELTA.fieldNames())


def start_demand_stream(spark: SparkSession, lines_path: str, changes_path: str, deltas_path: str, *, checkpoint: str,
                        txn_type: str = S.TXN_OUT, status: str = S.STATUS_INVOICE, parts: int = PARTS, delay: str = "1 day",
                        files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Follow the event files (parquet) of ``lines_path`` and ``changes_path``
    and write the changes of the open demand to ``deltas_path``. Both folders
    and ``checkpoint`` are shared ones. ``delay`` is the watermark within which
    a line may come again; ``parts`` must stay the same for a checkpoint."""
    def arriving(path: str, schema: T.StructType) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)

    both = events(arriving(lines_path, LINE), arriving(changes_path, CHANGE), txn_type, status, parts)
    deltas = both.withWatermark("at", delay).groupBy("invoice_id", "part").applyInPandasWithState(
        keep_demand, DELTA, "state string", "append", GroupStateTimeout.NoTimeout)
    writer = deltas.writeStream.format("parquet").option("path", deltas_path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_demand(deltas: DataFrame) -> DataFrame:
    """(product_id, unit_id, quantity) of the (product, unit) with open lines,
    as ``demand`` gives them; blank where no open line has a quantity."""
    sums = deltas.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("quantity", "n_lines", "n_known")]).where("n_lines > 0")
    cell = F.from_json("cell", _CELL)
    return sums.select(cell["product_id"].alias("product_id"), cell["unit_id"].alias("unit_id"), F.when(F.col("n_known") > 0, F.col("quantity")).alias("quantity"))


def read_demand(spark: SparkSession, deltas_path: str) -> DataFrame:
    """``current_demand`` of what the stream has written so far."""
    return current_demand(spark.read.schema(DELTA).parquet(deltas_path))
