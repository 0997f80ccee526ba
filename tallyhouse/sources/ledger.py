"""The ledger's stored tables.

The eight ledger tables, derived from a driver folder by the fixture mapping,
are written into a ``TableStore`` (``import_driver_tables`` writes them all as
one version). ``LedgerTables`` reads them back at their imported versions
(without re-reading the commit markers); a table not yet imported in this
Spark application is imported on first use. Input batches (forms, drafts,
login attempts) pass through from the mapping.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..session import app_id
from .fixtures import Ledger
from .tables import TableStore


def import_driver_tables(spark: SparkSession, sf_dir: str, root: str | None = None,
                         tables: list[str] | None = None) -> TableStore:
    L = Ledger(spark, sf_dir)
    store = TableStore(spark, root)
    store.replace({name: getattr(L, name) for name in (tables or list(S.TABLES))})
    return store


class _Imported:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.store = TableStore(spark)
        self.mapping = Ledger(spark, sf_dir)
        self.versions: dict[str, int] = {}
        self.lock = threading.Lock()

    def ensure(self, names: list[str]) -> None:
        with self.lock:
            todo = [n for n in names if n not in self.versions]
            if todo:
                v = self.store.replace({n: getattr(self.mapping, n) for n in todo})
                self.versions.update({n: v for n in todo})


_IMPORTED: dict[tuple[str, str], _Imported] = {}
_LOCK = threading.Lock()


def imported(spark: SparkSession, sf_dir: str) -> _Imported:
    key = (app_id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _IMPORTED:
            _IMPORTED[key] = _Imported(spark, sf_dir)
        return _IMPORTED[key]


class LedgerTables:
    """Stored ledger tables of a driver folder plus its input batches."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._imp = imported(spark, sf_dir)
        self.store = self._imp.store
        self.inputs = self._imp.mapping

    def import_tables(self, names: list[str]) -> LedgerTables:
        """Import several tables at once (concurrent writes, one version)."""
        self._imp.ensure(names)
        return self

    def import_all(self) -> LedgerTables:
        return self.import_tables(list(S.TABLES))

    def __getattr__(self, name: str) -> DataFrame:
        if name in S.TABLES:
            self._imp.ensure([name])
            return self.store.read(name, self._imp.versions[name])
        return getattr(self.inputs, name)

    def fork(self, tables: list[str]) -> TableStore:
        """A new, private store seeded with copies of ``tables`` (for queries
        that write: the shared import stays untouched)."""
        store = TableStore(self.spark)
        store.replace({t: getattr(self, t) for t in tables})
        return store
