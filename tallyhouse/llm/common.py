"""What the operators share: table readers, bounded Arrow batches, the shared
work folder, the labelled split and per-document word statistics."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = b" \t\n\x0b\x0c\r"  # the bytes of [\x20\x09-\x0D]
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the driver and the executors share: ``spark.checkpoint.dir``
    of the session; only where that is unset, a folder in the SQL warehouse."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/llm-checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, so
    that a lost executor costs a re-read and not the jobs before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """``name``, or one like it that no column bears (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_ROWS rows and BATCH_BYTES bytes
    from now on, so that very long texts do not add up in a Python worker. Tasks
    read the settings when they run, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with ``bounded_batches``."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema) -> DataFrame:
    """``map_stream`` with a dict of columns for each batch that has rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_pydict(fn(b))

    return map_stream(df, run, schema)


def worker_kept(kind: str, key, make: Callable):
    """``make()`` once for a ``key`` in each Python worker process: what it
    returns serves the worker's later tasks too, until another key of the same
    ``kind`` comes. For caches that depend on the key alone."""
    kept = sys.modules.setdefault("_tallyhouse_kept", types.ModuleType("_tallyhouse_kept")).__dict__
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = (key, make())
    return kept[kind][1]


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [b or b"" for b in col.cast(pa.large_binary()).to_pylist()]


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from, one per id (the
    larger label where an id repeats); null ids and labels are left out."""
    return (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
            .groupBy("doc_id").agg(F.max("label").alias("label")))


def word_codes(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Each word's number in order of first occurrence, and how many differ."""
    seen: dict[bytes, int] = {}
    code = seen.setdefault
    ids = np.fromiter([code(w, len(seen)) for w in words], np.int64, len(words))
    return ids, len(seen)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found at least twice in the text."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 1 << 20:  # three codes no longer fit in 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    _, inverse, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    mark = np.zeros(n, bool)
    mark[:-2] |= twice
    mark[1:-1] |= twice
    mark[2:] |= twice
    return int(mark.sum())
