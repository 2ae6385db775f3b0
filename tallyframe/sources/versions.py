"""Tables of whole versions for streaming sinks.

A version is a folder ``v<number>-<query>-<epoch>`` under the table's root,
written by Spark and valid once it holds Spark's ``_SUCCESS`` file. A version
is never written over: a new one takes the next number, whichever query or run
writes it, and an epoch that its query has already written is left out. Folders
are listed through the Hadoop file system of the path, so any shared storage
that Spark writes to will do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NAME = re.compile(r"v(\d+)-(.*)-(-?\d+)$")


def _list(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def versions(spark: SparkSession, root: str) -> list[tuple[int, str, int, str]]:
    """``(number, query, epoch, path)`` of the valid versions, oldest first."""
    fs, paths = _list(spark, root)
    done = spark._jvm.org.apache.hadoop.fs.Path
    found = [(m, p) for p in paths if (m := _NAME.match(p.getName())) and fs.exists(done(p, "_SUCCESS"))]
    return sorted((int(m[1]), m[2], int(m[3]), f"{root.rstrip('/')}/{p.getName()}") for m, p in found)


def query_id(spark: SparkSession) -> str:
    """Identity of the running streaming query; it outlives restarts from the
    same checkpoint. ``batch`` outside of a stream."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def is_written(spark: SparkSession, root: str, epoch: int) -> bool:
    own = query_id(spark)
    return any(q == own and e == epoch for _, q, e, _ in versions(spark, root))


def write_version(df: DataFrame, root: str, epoch: int = 0) -> None:
    spark = df.sparkSession
    number = max((n for n, *_ in versions(spark, root)), default=-1) + 1
    # an attempt that broke off has no _SUCCESS; only such a folder can be in the way
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/v{number:08d}-{query_id(spark)}-{epoch}")


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    found = versions(spark, root)
    return spark.read.parquet(found[-1][3]) if found else None
