"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null (groups keyed by a null
    value stay joinable); the right-hand key columns are dropped."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.drop(*[f"__r_{k}" for k in keys])


def running_agg(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column,
                out: str, kind: str = "max", include_current: bool = True) -> DataFrame:
    """Skew-safe running max/sum of ``value`` per ``keys`` in ``order``.

    A single key may hold a large share of all rows, so the ordered scan is
    split in two levels instead of one window over the whole key:
    ``bucket`` must be a non-decreasing function of ``order`` (e.g. the day of
    a timestamp). Level 1 runs the window inside each (key, bucket); level 2
    combines the per-bucket totals of all earlier buckets of the key (a small
    table: one row per bucket) and joins that carry back.
    """
    agg = F.max if kind == "max" else F.sum
    d = df.withColumn("__b", bucket)
    frame_end = 0 if include_current else -1
    w1 = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    d = d.withColumn("__in", agg(F.col(value)).over(w1))
    per_b = d.groupBy(*keys, "__b").agg(agg(F.col(value)).alias("__bt"))
    w2 = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.withColumn("__carry", agg(F.col("__bt")).over(w2)).drop("__bt")
    j = null_safe_join(d, carry, keys + ["__b"], "left")
    if kind == "max":
        res = F.greatest(F.col("__in"), F.col("__carry"))
    else:
        res = F.coalesce(F.col("__in"), F.lit(0)) + F.coalesce(F.col("__carry"), F.lit(0))
        if not include_current:
            res = F.when(F.col("__in").isNull() & F.col("__carry").isNull(), F.lit(None)).otherwise(res)
    return j.withColumn(out, res).drop("__b", "__in", "__carry")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable and evaluate ``body(var)`` once.

    Column expressions are trees: a sub-expression used k times is copied k
    times. Deep formulas that reuse intermediates (exact rounding, unit
    ladders) stay linear in size by binding them here."""
    return F.element_at(F.transform(F.array(value), body), 1)
