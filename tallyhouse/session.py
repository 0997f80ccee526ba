"""Spark session settings and the shared work folder.

The settings below are the ones the ledger relies on at any scale: AQE (runtime
re-planning, skew-join splitting, partition coalescing), UTC session time and
no web UI. Cluster sizes (executor count, shuffle partitions, file split size)
belong to the deployment; ``cluster_conf`` gives a starting point for a
100 TB ledger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def cluster_conf(executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Settings for a large cluster: 3 shuffle partitions per core, 256 MB
    advisory partitions after AQE coalescing, 512 MB parquet splits."""
    cores = executors * cores_per_executor
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(cores * 3),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tallyhouse", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (cores if isinstance(cores, int) else 8))
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext
    except Exception:  # sessions without a local SparkContext handle
        return None


def app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or str(id(spark))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Read from ``spark.checkpoint.dir`` (the folder the cluster names). Only
    where that is unset, a folder in the SQL warehouse, which the driver and
    the executors of every master share too; never a machine's own temporary
    folder.
    """
    sc = _context(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tallyhouse-work"
        spark.conf.set("spark.checkpoint.dir", root)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared work folder."""
    return f"{work_dir(spark)}/tallyhouse/{name}-{uuid.uuid4().hex}"

