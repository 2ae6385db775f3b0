"""Shared helpers for the registered plans (queries over the given tables)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tallyframe.sources.tables import read_table, with_utc_timestamps


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows by ``key`` in partitions of about ``rows``. Millions of narrow
    rows make one split of a file; where much work or many rows come of each,
    that split would be one long or large task."""
    n = math.ceil(df.count() / rows)  # from the file footers
    return df.repartition(n, key) if n > 1 else df


def pin_utc(spark: SparkSession) -> None:
    """Event times in the tables are UTC wall-clock values; pin the session
    zone to UTC so casts, day buckets, windows and formatting agree on every
    host."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def tu(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table with TIMESTAMP_NTZ columns cast to TIMESTAMP (UTC)."""
    pin_utc(spark)
    return with_utc_timestamps(read_table(spark, sf_dir, name))
