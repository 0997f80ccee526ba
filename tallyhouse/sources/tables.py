"""Table sources and sinks.

* ``read_parquet_table`` / ``read_csv_table``: a table directory read with its
  declared schema (no inference; blank CSV cells become NULL).
* ``TableStore``: versioned tables under one shared folder. A replacement
  writes a new folder next to the version being read (overwriting the path a
  plan reads fails in Spark), then writes the one-row commit marker
  ``_commits/v=<n>`` last. Readers take, per table, the newest committed
  version, so a failed job leaves the previous versions in force, and several
  tables written under one version switch together.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import scratch_path
from .claims import move_new


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by name, cast to its types; unknown columns are an
    error (appends are by name, never by position)."""
    extra = set(df.columns) - set(schema.fieldNames())
    if extra:
        raise ValueError(f"columns not in the table schema: {sorted(extra)}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table exported as CSV with a header row (e.g. a spreadsheet tab)."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path))


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True) \
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


_MARKER = T.StructType([
    T.StructField("tables", T.ArrayType(T.StringType())),
    T.StructField("segments", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("tag", T.StringType()),
])

# Directory partitioning of the stored ledger tables: the direction filter of
# every demand / supply query and the status filter of every invoice query
# prune whole directories instead of reading and filtering rows. The open
# invoices of a status are folders of their own, so a posting rewrites those
# and carries the others into its version.
PARTITION_BY = {"txn": ["txn_type"], "invoice": ["status", "is_process"]}

# No bucketing by invoice: a bucketed scan gives all lines of a hot invoice
# (possibly a third of the table) to one task, in the join and in per-invoice
# aggregates alike, and AQE cannot split a scan. Shuffled plans pre-aggregate
# before the exchange and let AQE split a skewed join partition.

# The order that ``compact`` gives a table's files, so that the row groups' least
# and greatest values leave most files of a picked invoice or product unread. The
# folder columns come first (a task writes few folders), a unique column last (a
# hot invoice or product is cut into several files).
CLUSTER_BY = {
    "txn": ["txn_type", "invoice_id", "transaction_id"], "invoice": ["status", "is_process", "invoice_id"],
    "inventory": ["product_id", "inventory_id"], "unit_size": ["product_id", "unit_id"], "product": ["product_id"],
    "size_conversion": ["product_id", "original_unit_id", "convert_unit_id"], "purchase": ["product_id", "purchase_id"],
}

SEGMENT = "segment"
EMPTY = "__EMPTY__"  # an empty string in a folder column
NULL = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name of a NULL


def _text_folders(name: str, schema: T.StructType) -> list[str]:
    """The folder columns of a table that hold strings."""
    return [c for c in PARTITION_BY.get(name, ()) if schema[c].dataType == T.StringType()]


class CommitConflict(RuntimeError):
    """Another writer committed the version first; nothing was overwritten."""


@dataclass(frozen=True)
class Entry:
    version: int
    segments: tuple[str, ...]


class TableStore:
    """Versioned ledger tables in one folder (see module doc).

    A table lives under ``<root>/<table>/segment=<id>/``; a version of a table
    is a list of segments, or of the partition folders of a segment that are
    still in force. A replacement writes one new segment, an append
    writes one new segment and keeps the previous ones, a rewrite of some
    partition folders writes one new segment and keeps the other folders, so
    committed files are never touched and several tables switch together
    under one commit marker ``_commits/v=<n>``, written last. A read lists
    the version's own segment folders. Segments of a
    failed attempt are never listed in a marker and so never read.
    """

    def __init__(self, spark: SparkSession, root: str | None = None,
                 schemas: dict[str, T.StructType] | None = None):
        self.spark = spark
        self.root = (root or scratch_path(spark, "store")).rstrip("/")
        self.schemas = schemas or S.TABLES | S.LOGS
        self._entries: dict[str, dict[int, Entry]] | None = None
        self._tags: set[str] = set()
        self._staged: dict[int, dict[str, Entry]] = {}

    # ---- commit markers ----------------------------------------------------
    def refresh(self) -> None:
        """Re-read the commit markers (one small read; markers are metadata)."""
        try:
            rows = self.spark.read.parquet(f"{self.root}/_commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # anything else is not an empty store
                raise
            rows = []
        entries: dict[str, dict[int, Entry]] = {}
        for r in rows:
            for t, segs in zip(r["tables"], r["segments"]):
                entries.setdefault(t, {})[int(r["v"])] = Entry(int(r["v"]), tuple(segs))
        self._entries = entries
        self._tags = {r["tag"] for r in rows if r["tag"] is not None}

    def has_tag(self, tag: str) -> bool:
        """Whether a commit carrying ``tag`` exists (e.g. a stream batch id)."""
        self.refresh()
        return tag in self._tags

    def _committed(self) -> dict[str, dict[int, Entry]]:
        if self._entries is None:
            self.refresh()
        return self._entries

    def version(self, table: str | None = None) -> int:
        """Newest committed version (of ``table``); 0 when there is none."""
        e = self._committed()
        vs = [v for t, by_v in e.items() if table in (None, t) for v in by_v]
        return max(vs, default=0)

    def versions(self) -> dict[str, int]:
        return {t: max(by_v) for t, by_v in self._committed().items()}

    # ---- reading ---------------------------------------------------------------
    def _entry(self, table: str, version: int | None) -> Entry:
        if version is not None and table in self._staged.get(version, {}):
            return self._staged[version][table]
        by_v = self._committed().get(table, {})
        if not by_v or (version is not None and version not in by_v):
            self.refresh()
            by_v = self._committed().get(table, {})
        if not by_v:
            raise KeyError(f"table {table!r} has no committed version in {self.root}")
        return by_v[version if version is not None else max(by_v)]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        entry = self._entry(table, version)
        schema = self.schemas[table]
        # only the version's own segment folders are listed; the base path keeps the folder columns
        folder = f"{self.root}/{table}"
        df = (self.spark.read.schema(schema).option("basePath", folder)
              .parquet(*[f"{folder}/{SEGMENT}={s}" for s in entry.segments]))
        empty, named = F.lit(EMPTY), _text_folders(table, schema)
        return df.select(*[F.when(F.col(c) == empty, F.lit("")).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
                           for c in schema.fieldNames()])

    def folders(self, table: str) -> dict[str, tuple[str | None, ...]]:
        """The partition folders of the newest version, below the table's
        folder, and the values that name them (as text, in the order of
        PARTITION_BY). A listing of folder names; no file is opened."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        conf, depth = self.spark.sparkContext._jsc.hadoopConfiguration(), len(PARTITION_BY[table])
        out = {}
        todo = [f"{SEGMENT}={s}" for s in self._entry(table, None).segments]
        while todo:
            folder = todo.pop()
            if folder.count("/") == depth:
                values = [unquote(f.split("=", 1)[1]) for f in folder.split("/")[1:]]
                out[folder.split("=", 1)[1]] = tuple({NULL: None, EMPTY: ""}.get(x, x) for x in values)
                continue
            path = hadoop.Path(f"{self.root}/{table}/{folder}")
            for status in path.getFileSystem(conf).listStatus(path):
                if status.isDirectory() and "=" in status.getPath().getName():
                    todo.append(f"{folder}/{status.getPath().getName()}")
        return out

    # ---- writing ---------------------------------------------------------------
    def _write(self, name: str, df: DataFrame, segment: str) -> None:
        rows = conform(df, self.schemas[name])
        for c in _text_folders(name, self.schemas[name]):  # a folder named by an empty string would be read as NULL
            rows = rows.withColumn(c, F.when(F.col(c) == "", F.lit(EMPTY)).otherwise(F.col(c)))
        w = rows.write.mode("errorifexists")
        if name in PARTITION_BY:
            w = w.partitionBy(*PARTITION_BY[name])
        w.parquet(f"{self.root}/{name}/{SEGMENT}={segment}")

    def stage(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None,
              rewrite: dict[str, tuple[DataFrame, list[str]]] | None = None) -> int:
        """Write the replacements, appends and rewrites of one change under the
        next version, uncommitted, as concurrent jobs (one thread submits each).
        A rewrite is (rows, kept): the rows join the kept ones of ``folders``."""
        replace, append, rewrite = replace or {}, append or {}, rewrite or {}
        if len({*replace, *append, *rewrite}) < len(replace) + len(append) + len(rewrite):
            raise ValueError("a table is either replaced, rewritten or appended to in one change")
        v = max(self.version(), max(self._staged, default=0)) + 1
        jobs, entries = [], {}
        for name, df in [*replace.items(), *append.items(), *((n, rows) for n, (rows, _) in rewrite.items())]:
            seg = f"{v}-{uuid.uuid4().hex[:8]}"
            before = self._entry(name, None).segments if name in append and self.version(name) else ()
            before = tuple(rewrite[name][1]) if name in rewrite else before
            entries[name] = Entry(v, (*before, seg))
            jobs.append((name, df, seg))
        self._staged[v] = entries
        if len(jobs) == 1:
            self._write(*jobs[0])
        elif jobs:
            with ThreadPoolExecutor(max_workers=min(8, len(jobs))) as pool:
                for f in [pool.submit(self._write, *j) for j in jobs]:
                    f.result()
        return v

    def commit(self, version: int, tables: list[str] | None = None, tag: str | None = None) -> int:
        """Make a staged version visible: write its marker (the last write).
        ``tag`` is stored in the marker (see ``has_tag``)."""
        staged = self._staged.pop(version)
        tables = list(staged) if tables is None else list(tables)
        marker = self.spark.createDataFrame([(tables, [list(staged[t].segments) for t in tables], tag)], _MARKER)
        written = f"{self.root}/_staged/{uuid.uuid4().hex}"
        marker.coalesce(1).write.parquet(written)
        if not move_new(self.spark, written, f"{self.root}/_commits/v={version}"):
            self.refresh()
            raise CommitConflict(f"version {version} of {self.root} was committed by another writer; stage the change again")
        committed = self._committed()
        for t in tables:
            committed.setdefault(t, {})[version] = staged[t]
        if tag is not None:
            self._tags.add(tag)
        return version

    def abort(self, version: int) -> None:
        """Forget a staged version; its segments are in no marker, so no read
        lists them (``vacuum`` deletes them)."""
        self._staged.pop(version, None)

    def change(self, replace: dict[str, DataFrame] | None = None,
               append: dict[str, DataFrame] | None = None, tag: str | None = None) -> int:
        """Replace and append to several tables in one commit."""
        return self.commit(self.stage(replace, append), tag=tag)

    def replace(self, frames: dict[str, DataFrame]) -> int:
        """Replace whole tables (together) with new versions."""
        return self.change(replace=frames)

    def append(self, table: str, rows: DataFrame) -> int:
        """Append rows (matched by column name) to a table as a new version;
        the committed files of earlier versions are not touched."""
        return self.change(append={table: rows})

    def compact(self, table: str) -> int:
        """Rewrite a table's segments as one, its files in the order of
        CLUSTER_BY: one range shuffle, so that later reads of a few invoices or
        products (``between``, or a literal on the column) skip the other files."""
        rows, order = self.read(table), CLUSTER_BY.get(table)
        return self.replace({table: rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else rows})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the segment folders that none of each table's newest ``keep``
        versions reads, and return their paths. Only for a store without other
        readers or writers at work; staged versions are kept."""
        self.refresh()
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        gone = []
        for table, by_v in self._committed().items():
            live = {s.split("/")[0] for v in sorted(by_v)[-keep:] for s in by_v[v].segments}
            live |= {s.split("/")[0] for staged in self._staged.values() if table in staged for s in staged[table].segments}
            folder = hadoop.Path(f"{self.root}/{table}")
            fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith(f"{SEGMENT}=") and name.split("=", 1)[1] not in live:
                    fs.delete(status.getPath(), True)
                    gone.append(status.getPath().toString())
        return gone
