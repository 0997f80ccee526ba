"""Reversible incremental line dedup: sharded cuckoo filters over exact
reference-count tables.

The state has three tables. ``postings`` holds which document has which line
key (a 128-bit digest of the key), ``counts`` the number of documents and the
smallest document of each key, ``filters`` one cuckoo filter per shard of the
keys. Inserting documents asks the filters which keys are certainly new (they
are appended to the counts as they are) and merges only the others with the
exact table; deleting documents lowers the counts, finds the next smallest
holder from the postings and takes keys without a holder out of the filters.
All decisions come from the exact tables; a filter only saves work.

Keys are aggregated to one row each before they meet a shard, so a line that
a third of all documents share is one row there; the join from postings back
to shared keys is a plain equi-join, which AQE splits where a key is hot.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import SPACE, map_batches, stored, texts, unused

MIN_CHARS = 10        # code points of a key that can be dropped
SHARD_KEYS = 1 << 16  # expected keys of a shard; its filter has twice as many slots
SLOTS = 4
MAX_ROUNDS = 500
POSTINGS = "digest binary, doc_id bigint"
COUNTS = "digest binary, shard int, n_docs bigint, min_doc bigint"
FILTERS = "shard int, table binary"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes.lower() lowers A-Z only


def key_digest(line: bytes) -> bytes | None:
    """The digest of a line's key; None for keys too short to be dropped."""
    key = line_key(line)
    if len(key) < MIN_CHARS or len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(key)


# ---- cuckoo filter: 16-bit fingerprints, 4 slots a bucket, 0 is a free slot


def _places(digests, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and fingerprint of each 16-byte digest."""
    raw = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return (raw[:, 0] % np.uint64(buckets)).astype(np.int64), (raw[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
    """The other bucket of a fingerprint; buckets is a power of two."""
    return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (buckets - 1))


class CuckooFilter:
    """Set of digests with insertion, deletion and no false negatives. Once an
    insertion finds no room the filter is saturated: it answers "maybe" for
    all, and the exact tables alone decide."""

    def __init__(self, table: np.ndarray | None):
        self.table = table

    @classmethod
    def sized(cls, keys: int = SHARD_KEYS) -> CuckooFilter:
        buckets = 1 << max(2, math.ceil(math.log2(max(1, 2 * keys / SLOTS))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes | None) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy() if data else None)

    def to_bytes(self) -> bytes:
        return b"" if self.table is None else self.table.tobytes()

    def contains(self, digests) -> np.ndarray:
        if self.table is None or not len(digests):
            return np.ones(len(digests), bool)
        n = len(self.table)
        at, mark = _places(digests, n)
        return ((self.table[at] == mark[:, None]) | (self.table[_other(at, mark, n)] == mark[:, None])).any(1)

    def insert(self, digests) -> None:
        """Round by round: every pending fingerprint tries its bucket; where the
        bucket is full, one of them takes over a slot and the fingerprint there
        goes to its other bucket."""
        if self.table is None or not len(digests):
            return
        n = len(self.table)
        at, mark = _places(digests, n)
        rng = np.random.default_rng(len(digests))
        for step in range(MAX_ROUNDS):
            for slot in range(SLOTS):  # one pending row a bucket and slot
                free = self.table[at, slot] == 0
                first = np.unique(np.where(free, at, -1), return_index=True)[1]
                first = first[free[first]]
                self.table[at[first], slot] = mark[first]
                left = np.ones(len(at), bool)
                left[first] = False
                at, mark = at[left], mark[left]
                if not len(at):
                    return
            if step == 0:
                at = _other(at, mark, n)
                continue
            row = np.unique(at, return_index=True)[1]
            slot = rng.integers(0, SLOTS, len(row))
            out = self.table[at[row], slot]
            self.table[at[row], slot] = mark[row]
            mark[row] = out
            at[row] = _other(at[row], out, n)
        self.table = None

    def delete(self, digests) -> None:
        """Takes out digests that were inserted before, one fingerprint each."""
        if self.table is None:
            return
        n = len(self.table)
        for a, m in zip(*_places(digests, n), strict=True):
            for bucket in (a, int(_other(np.array([a]), np.array([m], np.uint16), n)[0])):
                slot = np.flatnonzero(self.table[bucket] == m)
                if len(slot):
                    self.table[bucket, slot[0]] = 0
                    break


# ---- state


class LineState(NamedTuple):
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int


def postings_of(docs: DataFrame) -> DataFrame:
    """(digest, doc_id): the droppable keys of every text, once per row."""
    def keys(batch: pa.RecordBatch) -> dict:
        ids, out, at = batch.column(0), [], []
        for i, t in enumerate(texts(batch)):
            found = {d for x in t.split(b"\n") if (d := key_digest(x))}
            out += found
            at += [i] * len(found)
        return {"digest": pa.array(out, pa.binary()), "doc_id": ids.take(pa.array(at, pa.int64()))}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull()), keys, POSTINGS)


def empty_state(spark: SparkSession, expected_keys: int = SHARD_KEYS) -> LineState:
    """A state without documents; ``expected_keys`` sets the number of shards."""
    return LineState(spark.createDataFrame([], POSTINGS), spark.createDataFrame([], COUNTS), spark.createDataFrame([], FILTERS),
                     max(1, math.ceil(expected_keys / SHARD_KEYS)))


def _shard(shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _count(postings: DataFrame, shards: int) -> DataFrame:
    return postings.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("min_doc")).select(
        "digest", _shard(shards).alias("shard"), "n_docs", "min_doc")


def _new_or_known(key, keys: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    has = len(kept) > 0
    known = CuckooFilter.from_bytes(kept["table"].iloc[0]).contains(list(keys["digest"])) if has else np.zeros(len(keys), bool)
    return keys.assign(known=known)


def _grown(key, keys: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    f = CuckooFilter.from_bytes(kept["table"].iloc[0]) if len(kept) else CuckooFilter.sized()
    f.insert(list(keys["digest"]))
    return pd.DataFrame({"shard": [key[0]], "table": [f.to_bytes()]})


def _shrunk(key, keys: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    if not len(kept):
        return pd.DataFrame({"shard": pd.Series([], dtype="int32"), "table": pd.Series([], dtype=object)})
    f = CuckooFilter.from_bytes(kept["table"].iloc[0])
    f.delete(list(keys["digest"]))
    return pd.DataFrame({"shard": [key[0]], "table": [f.to_bytes()]})


def _by_shard(keys: DataFrame, filters: DataFrame, fn, schema: str) -> DataFrame:
    return keys.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(fn, schema)


def insert(state: LineState, postings: DataFrame) -> LineState:
    """The state with more documents. (document, key) rows it already has, and
    repeated ones, change nothing."""
    fresh = stored(postings.select("digest", "doc_id").distinct().join(state.postings, ["digest", "doc_id"], "left_anti"))
    asked = stored(_by_shard(_count(fresh, state.shards), state.filters, _new_or_known, COUNTS + ", known boolean"))
    columns = ["digest", "shard", "n_docs", "min_doc"]
    new, maybe = asked.where(~F.col("known")).select(columns), asked.where("known").select(columns)
    old = state.counts.select("digest", F.col("n_docs").alias("o"), F.col("min_doc").alias("m"))
    merged = (old.join(maybe, "digest", "full").select(
        "digest", _shard(state.shards).alias("shard"), (F.coalesce("o", F.lit(0)) + F.coalesce("n_docs", F.lit(0))).alias("n_docs"),
        F.least("m", "min_doc").alias("min_doc")))
    added = new.unionByName(maybe.join(old, "digest", "left_anti"))  # false positives are new keys too
    return LineState(stored(state.postings.unionByName(fresh)), stored(merged.unionByName(new)),
                     stored(_by_shard(added, state.filters, _grown, FILTERS)), state.shards)


def delete(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state as if the documents of ``doc_ids`` had never been inserted;
    ids without postings change nothing."""
    gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    left = stored(state.postings.join(gone, "doc_id", "left_anti"))
    touched = state.postings.join(gone, "doc_id", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    touched = stored(state.counts.join(touched, "digest").withColumn("n_docs", F.col("n_docs") - F.col("less")).drop("less"))
    still = touched.where("n_docs > 0").select("digest", "shard", "n_docs")
    smallest = left.join(still.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("min_doc"))
    counts = state.counts.join(touched.select("digest"), "digest", "left_anti").unionByName(still.join(smallest, "digest").select("digest", "shard", "n_docs", "min_doc"))
    emptied = touched.where("n_docs = 0")
    return LineState(left, stored(counts), stored(_by_shard(emptied, state.filters, _shrunk, FILTERS)), state.shards)


def build(docs: DataFrame, batches: int = 2) -> LineState:
    """The state of all documents, inserted in ``batches`` parts by id."""
    postings = stored(postings_of(docs))
    keys = postings.agg(F.approx_count_distinct("digest")).first()[0]
    state = empty_state(docs.sparkSession, keys)
    for part in range(batches):
        state = insert(state, postings.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == part))
    return state


def dropped_keys(state: LineState) -> DataFrame:
    """(doc_id, dropped): each document's keys that a smaller document holds."""
    shared = state.counts.where("n_docs >= 2").select("digest", "min_doc")
    return (state.postings.join(shared, "digest").where(F.col("doc_id") != F.col("min_doc"))
            .groupBy("doc_id").agg(F.collect_list("digest").alias("dropped")))


def deduplicated(docs: DataFrame, state: LineState, name: str = "_lines") -> DataFrame:
    """``docs`` with ``text`` less the lines whose key a smaller document of the
    state holds, and a struct ``name``: n_lines, n_dropped, kept_sha256. A
    column of that name in ``docs`` is replaced.

    Null and empty texts are one empty line. Rows with a null doc_id are not
    documents of the state and stay whole; rows that repeat a doc_id are one
    document and each loses the same keys. All rows and columns stay."""
    docs = docs.drop(name)
    gone_keys = unused(docs.columns, "_dropped")
    drops = dropped_keys(state)
    joined = docs.join(drops, docs["doc_id"].cast("long") == drops["doc_id"], "left").select(*[docs[c] for c in docs.columns], drops["dropped"].alias(gone_keys))
    docs_columns = docs.columns
    lines = StructType([StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_sha256", StringType())])

    def cut(batch: pa.RecordBatch) -> dict:
        out = []
        for t, gone in zip(texts(batch), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            rows = t.split(b"\n")
            gone = set(gone or ())
            kept = [x for x in rows if key_digest(x) not in gone] if gone else rows
            text = b"\n".join(kept) if gone else t
            out.append((text, len(rows), len(rows) - len(kept), hashlib.sha256(text).hexdigest()))
        text, n, less, sha = zip(*out, strict=True)
        columns = dict(zip(docs_columns, batch.columns[:-1], strict=True))
        columns["text"] = pa.array(text, pa.binary()).cast(pa.string())
        return columns | {name: pa.StructArray.from_arrays([pa.array(n), pa.array(less), pa.array(sha)], lines.names)}

    return map_batches(joined, cut, StructType([*docs.schema.fields, StructField(name, lines)]))
