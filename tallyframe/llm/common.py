"""Expressions and small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

#: White space of the word contracts: space and the control range tab..return.
SPACES = r"[ \t-\r]+"


def text_of(col: str | Column) -> Column:
    """The text with null read as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def space_words(text: Column) -> Column:
    """Array of the maximal runs without white space."""
    return F.array_remove(F.split(text, SPACES), "")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared checkpoint folder: a lineage cut that
    survives lost executors, and a scan whose size the planner knows."""
    return materialize(df, name)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has two columns ``u`` and ``v`` of one orderable type. The result
    is ``(node, root)``. Alternates the large-star and the small-star step:
    every step is a grouped minimum and an equi-join, so no neighbourhood is
    gathered, and each round's edges are written to the shared folder. It ends
    when a round changes nothing, which takes about log(n) rounds.
    """
    e = written(edges.where("u <> v").select("u", "v").distinct(), "cc")
    state = None
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "cc")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = written(small, "cc")
        row = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if (row[0], row[1]) == state:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (row[0], row[1])


def stepwise(df: DataFrame, steps: list[tuple[str, Callable[[], Column]]]) -> DataFrame:
    """Add columns one projection at a time, so that a later step may use an
    earlier one many times and it is still computed once."""
    for name, build in steps:
        df = df.withColumn(name, build())
    return df
