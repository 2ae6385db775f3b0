"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def _local_heap() -> str:
    """Driver heap for local mode: 60% of physical memory, between 2 and 16 GB."""
    try:
        with open("/proc/meminfo") as fh:
            kb = next(int(line.split()[1]) for line in fh if line.startswith("MemTotal:"))
        gb = int(kb / 1024 / 1024 * 0.6)
    except (OSError, StopIteration, ValueError):
        gb = 4
    return f"{max(2, min(16, gb))}g"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "tallyframe") -> SparkSession:
    """A session tuned for the library: AQE on, UTC clock, Arrow on, no UI.

    On a cluster, ``master`` stays ``None`` so spark-submit decides; the
    shuffle partition count should then be sized to ~128-256 MB per task
    (AQE coalesces small ones at runtime).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            b = b.config("spark.driver.memory", os.environ.get("TALLYFRAME_DRIVER_MEMORY", _local_heap()))
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a single-JVM
    (``local``) session, as in tests, gets a private folder; on a cluster a
    machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-ckpt-"))
    return urlparse(sc.getCheckpointDir()).path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage for an intermediate that is reused several times: write
    it as a parquet table under the shared ``spark.checkpoint.dir`` and read
    it back (never ``localCheckpoint``), so lost executors and repeated use
    do not recompute the upstream plan. Parquet keeps the columnar path
    (an RDD checkpoint would serialise rows)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
