"""Exact, skew-safe percentiles (A2).

Spark's exact ``percentile`` aggregate keeps a map of every distinct value of
a group in one buffer, which does not survive a hot group holding a third of
the data. ``exact_percentiles`` gets the same linear-interpolated value
(``k = (n - 1) * p``, as DuckDB ``quantile_cont``) without ever gathering a
group:

1. per group: ``n`` and a ``percentile_approx`` bracket ``[lo, hi]`` around
   each target rank (a mergeable sketch, partial aggregation);
2. exact counts of the values below and inside every bracket; a bracket that
   misses its ranks is widened to the group's full range;
3. while a bracket holds more than ``max_band_rows`` values it is refined:
   approximate grid points split it into cells, each cell is counted
   exactly, only the cells holding the target ranks are kept and counted
   again (a bracket holding one repeated value is solved outright);
4. only the rows left in the brackets are ranked by a window, and the values
   at ranks ``floor(k)`` and ``floor(k) + 1`` are interpolated.

Every step is an aggregation with partial (map-side) combine or a window over
a bracket of bounded size; the driver only learns whether a bracket is still
too large (one row) to decide on another refinement round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.util import null_safe_join
from tallyframe.session import materialize

_INF = float("inf")


def _attach(vals: DataFrame, st: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Join every value row with the brackets of its group (a short array:
    one entry per requested percentile)."""
    packed = st.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c) for c in fields])).alias("_br"))
    return null_safe_join(vals, packed, keys)


def _recount(vals: DataFrame, st: DataFrame, keys: list[str]) -> DataFrame:
    """Exact below / inside counts (and the inside min / max) per bracket."""
    fields = ["_i", "_lo", "_hi"]
    j = _attach(vals, st.select(*keys, *fields), keys, fields)
    e = j.select(*keys, "_v", F.explode("_br").alias("_b"))
    inside = (F.col("_v") >= F.col("_b._lo")) & (F.col("_v") <= F.col("_b._hi"))
    cnt = e.groupBy(*keys, F.col("_b._i").alias("_i")).agg(
        F.sum(F.when(F.col("_v") < F.col("_b._lo"), 1).otherwise(0)).cast("bigint").alias("_below"),
        F.sum(F.when(inside, 1).otherwise(0)).cast("bigint").alias("_band"),
        F.min(F.when(inside, F.col("_v"))).alias("_bmin"),
        F.max(F.when(inside, F.col("_v"))).alias("_bmax"))
    base = st.drop("_below", "_band", "_bmin", "_bmax")
    return null_safe_join(base, cnt, keys + ["_i"], "left").fillna(0, ["_below", "_band"])


def _refine(vals: DataFrame, st: DataFrame, keys: list[str], max_band_rows: int, grid: int,
            accuracy: int) -> DataFrame:
    """Shrink every bracket holding more than ``max_band_rows`` values (and
    more than one distinct value) to the grid cells holding its two target
    ranks; other brackets pass through."""
    many = F.coalesce(F.col("_bmin") != F.col("_bmax"), F.lit(True))   # unknown (widened) counts as many
    big = st.filter((F.col("_band") > max_band_rows) & many)
    small = st.filter(~((F.col("_band") > max_band_rows) & many))
    fields = ["_i", "_lo", "_hi"]
    rows = _attach(vals, big.select(*keys, *fields), keys, fields).select(
        *keys, "_v", F.explode("_br").alias("_b"))
    rows = rows.filter((F.col("_v") >= F.col("_b._lo")) & (F.col("_v") <= F.col("_b._hi"))) \
        .select(*keys, F.col("_b._i").alias("_i"), "_v")
    fracs = [j / grid for j in range(grid + 1)]
    sk = rows.groupBy(*keys, "_i").agg(F.percentile_approx("_v", fracs, accuracy).alias("_g"))
    # cell of a value = number of interior grid points <= value (0 .. grid-1)
    tagged = null_safe_join(rows, sk, keys + ["_i"]).select(
        *keys, "_i", F.aggregate(F.slice("_g", 2, grid - 1), F.lit(0),
                                 lambda acc, b: acc + F.when(F.col("_v") >= b, 1).otherwise(0)).alias("_cell"))
    cells = tagged.groupBy(*keys, "_i", "_cell").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys, "_i").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    b = null_safe_join(cells, big.select(*keys, "_i", "_f", "_c", "_below"), keys + ["_i"])
    rf, rc = F.col("_f") - F.col("_below"), F.col("_c") - F.col("_below")

    def hit(r):
        return (F.col("_before") <= r) & (r < F.col("_before") + F.col("_cnt"))
    pick = b.groupBy(*keys, "_i").agg(F.min(F.when(hit(rf), F.col("_cell"))).alias("_cf"),
                                      F.max(F.when(hit(rc), F.col("_cell"))).alias("_cc"))
    pick = null_safe_join(pick, sk, keys + ["_i"])
    # cell j spans [g[j], g[j+1]) (1-based element_at: g[j] is element j+1);
    # the first cell starts at the old lower bound, the last ends at the old upper
    new_lo = F.when(F.col("_cf") == 0, F.lit(None)).otherwise(F.element_at("_g", F.col("_cf") + 1))
    new_hi = F.when(F.col("_cc") == grid - 1, F.lit(None)).otherwise(F.element_at("_g", F.col("_cc") + 2))
    bounds = pick.select(*keys, "_i", new_lo.alias("_nlo"), new_hi.alias("_nhi"))
    refined = null_safe_join(big, bounds, keys + ["_i"], "left").select(
        *[c for c in big.columns if c not in ("_lo", "_hi")],
        F.coalesce(F.col("_nlo"), F.col("_lo")).alias("_lo"), F.coalesce(F.col("_nhi"), F.col("_hi")).alias("_hi"))
    return small.unionByName(_recount(vals, refined.select(*small.columns), keys).select(*small.columns))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float],
                      accuracy: int = 10000, max_band_rows: int = 2_000_000, grid: int = 64) -> DataFrame:
    """Exact linear-interpolated percentiles per group.

    ``ps`` maps output column name -> fraction in [0, 1]. Null values are
    ignored; groups with no values are absent (callers default them). The
    common case is three passes (sketch, counts, bracket ranking) for all
    requested percentiles together; brackets larger than ``max_band_rows``
    (hot groups) are refined until none is larger or no bracket shrinks any
    more, so no window ranks a whole hot group."""
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    names = list(ps)
    margin = 3.0 / accuracy
    bounds = []
    for n in names:
        bounds += [max(0.0, ps[n] - margin), min(1.0, ps[n] + margin)]
    stats = vals.groupBy(*keys).agg(F.count("_v").alias("_n"),
                                    F.percentile_approx("_v", bounds, accuracy).alias("_b"))
    per_p = []
    for i, n in enumerate(names):
        k = (F.col("_n") - 1).cast("double") * F.lit(ps[n])
        f = F.floor(k).cast("bigint")
        per_p.append(F.struct(F.lit(i).alias("_i"), F.col("_b")[2 * i].alias("_lo"), F.col("_b")[2 * i + 1].alias("_hi"),
                              k.alias("_k"), f.alias("_f"), F.least(f + 1, F.col("_n") - 1).alias("_c")))
    st = stats.select(*keys, "_n", F.explode(F.array(*per_p)).alias("_s")).select(*keys, "_n", "_s.*")
    st = _recount(vals, st, keys)
    # a bracket that misses its ranks widens to the whole group (exact counts)
    ok = (F.col("_below") <= F.col("_f")) & (F.col("_below") + F.col("_band") > F.col("_c"))
    st = st.select(*keys, "_n", "_i", "_k", "_f", "_c",
                   F.when(ok, F.col("_lo")).otherwise(F.lit(-_INF)).alias("_lo"),
                   F.when(ok, F.col("_hi")).otherwise(F.lit(_INF)).alias("_hi"),
                   F.when(ok, F.col("_below")).otherwise(F.lit(0)).cast("bigint").alias("_below"),
                   F.when(ok, F.col("_band")).otherwise(F.col("_n")).cast("bigint").alias("_band"),
                   F.when(ok, F.col("_bmin")).alias("_bmin"), F.when(ok, F.col("_bmax")).alias("_bmax"))
    # the bracket table is small (groups x percentiles): write it once so the
    # size check and the later passes do not recompute the sketch and counts
    st = materialize(st, "pct-brackets")
    left = None
    while True:
        open_big = st.filter((F.col("_band") > max_band_rows)
                             & ~F.coalesce(F.col("_bmin") == F.col("_bmax"), F.lit(False)))
        size = open_big.agg(F.sum("_band")).first()[0]
        if size is None or size == left:  # none is large, or only equal neighbours are left in the large ones
            break
        left = size
        st = materialize(_refine(vals, st, keys, max_band_rows, grid, accuracy), "pct-brackets")
    # a bracket holding one repeated value is solved without ranking
    solved = F.coalesce(F.col("_bmin") == F.col("_bmax"), F.lit(False))
    direct = st.filter(solved).select(*keys, "_i", F.col("_bmin").alias("_val"))
    todo = st.filter(~solved)
    fields = ["_i", "_lo", "_hi", "_k", "_f", "_c", "_below"]
    tagged = _attach(vals, todo.select(*keys, *fields), keys, fields).select(
        *keys, "_v", F.explode(F.filter("_br", lambda q: (F.col("_v") >= q["_lo"]) & (F.col("_v") <= q["_hi"])))
        .alias("_p"))
    w = Window.partitionBy(*keys, F.col("_p._i")).orderBy("_v")
    ranked = tagged.withColumn("_r", F.row_number().over(w) - 1 + F.col("_p._below"))
    picked = ranked.filter((F.col("_r") == F.col("_p._f")) | (F.col("_r") == F.col("_p._c")))
    res = picked.groupBy(*keys, F.col("_p._i").alias("_i")).agg(
        F.max(F.when(F.col("_r") == F.col("_p._f"), F.col("_v"))).alias("_vf"),
        F.max(F.when(F.col("_r") == F.col("_p._c"), F.col("_v"))).alias("_vc"),
        F.first("_p._k").alias("_k"), F.first("_p._f").alias("_f"))
    ranked_vals = res.select(*keys, "_i", (F.col("_vf") + (F.col("_vc") - F.col("_vf")) *
                                           (F.col("_k") - F.col("_f"))).alias("_val"))
    allv = ranked_vals.unionByName(direct)
    return allv.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_val"))).alias(n)
                                     for i, n in enumerate(names)])


def approx_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float],
                       accuracy: int = 10000) -> DataFrame:
    """One-pass sketch percentiles (rank error <= n / accuracy)."""
    return df.groupBy(*keys).agg(*[
        F.percentile_approx(F.col(value).cast("double"), p, accuracy).alias(name)
        for name, p in ps.items()])
