"""Create-only folders and the id ranges reserved with them.

``move_new`` gives a finished folder its name if no other writer has it yet: a
rename that does not overwrite, atomic on HDFS and on a local disk. Commit
markers and id ranges both rest on it.

``IdRanges`` hands out disjoint ranges of ids. A range is a folder
``_ids/<name>/<n>`` that holds one row, (first, last); range n starts above
range n - 1, so a writer reads the newest range only, claims the next folder
and tries again where another was quicker. A writer that fails after its claim
leaves a gap and nothing else.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it is missing."""
    fs, conf = _hadoop(spark)
    path = fs.Path(folder)
    system = path.getFileSystem(conf)
    return [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    fs, conf = _hadoop(spark)
    path = fs.Path(folder)
    path.getFileSystem(conf).delete(path, True)


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename the folder ``source`` to ``target``, and whether that worked: not
    if ``target`` exists, also where another writer makes it at the same moment."""
    fs, conf = _hadoop(spark)
    src, dst = fs.Path(source), fs.Path(target)
    dst.getFileSystem(conf).mkdirs(dst.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(dst.toUri(), conf).rename(src, dst, options)
    except Py4JJavaError as e:
        if not e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        delete(spark, source)
        return False
    # a local disk moves the later of two folders into the earlier one
    inside = fs.Path(dst, src.getName())
    lost = dst.getFileSystem(conf).exists(inside)
    if lost:
        delete(spark, inside.toString())
    return not lost


class IdRanges:
    """Disjoint id ranges of the tables under ``root`` (see module doc)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = f"{root.rstrip('/')}/_ids"

    def last(self, name: str) -> tuple[int, int]:
        """The number of the newest range of ``name`` and its last id; (0, 0) before the first."""
        n = max((int(x) for x in names(self.spark, f"{self.root}/{name}")), default=0)
        return (n, self.spark.read.parquet(f"{self.root}/{name}/{n}").first()["last"]) if n else (0, 0)

    def reserve(self, name: str, count: int, floor: int) -> int:
        """The first id of a new range of ``count`` ids, above all ranges reserved
        before and not under ``floor`` (max + 1 of a table that was numbered
        without ranges). A ``count`` of 0 reserves nothing."""
        while True:
            n, last = self.last(name)
            first = max(last + 1, floor)
            if count == 0:
                return first
            staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
            self.spark.createDataFrame([(first, first + count - 1)], "first long, last long").coalesce(1).write.parquet(staged)
            if move_new(self.spark, staged, f"{self.root}/{name}/{n + 1}"):
                return first
