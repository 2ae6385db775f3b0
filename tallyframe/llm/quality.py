"""Quality rules: robust multivariate outliers per language and source.

Every text gets a vector of transformed statistics. For each (language,
source) group the minimum covariance determinant of half of its rows is
estimated by concentration steps: from a median / median absolute deviation
start, the half of the rows with the smallest Mahalanobis distances gives the
next mean and covariance. The estimate is reweighted once: the rows within the
``CORE`` quantile of its distances give the final mean and covariance. Rows
farther than ``max_distance`` robust standard deviations from their group are
rejected. Half is the greatest breakdown point there is, so a group of copies
does not shape the estimate that judges it; it is the same estimate for every
group, whatever its size and its share of bad rows.

Only DataFrame functions run. A concentration step is one scan of the narrow
statistics table: distances fall into logarithmic bins, counts and moments are
summed per (group, bin) with partial aggregation, and a window over the at
most few hundred bins of a group picks the bins of the support set. So no
group, however large, meets in one task, and all rows count.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.util import let
from tallyframe.llm.common import space_words, stepwise, text_of, written

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: The transformed statistics, in units of 1/UNIT so that moments are sums of
#: whole numbers and do not depend on the order of addition.
FEATURES = ("word_len", "symbols", "marks", "upper", "dup_lines", "repeats")
UNIT = 100
#: Least standard deviation of each statistic (ridge of the covariance): a
#: statistic that is constant over the support set stays usable.
RIDGE = (0.05, 0.05, 0.05, 0.05, 0.10, 0.10)
BINS_PER_OCTAVE = 4
#: Support of the estimate (the greatest breakdown point), and the share of a
#: normal sample that its reweighting keeps.
HALF, CORE = 0.5, 0.975


def base_statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of the whole text added under ``prefix``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` (words inside 8-word windows found twice or more in the
    text; windows are compared by 64-bit hash), ``n_upper`` and ``n_marks``.
    Null and empty texts count 0 everywhere. Columns of ``docs`` named like a
    result are the caller's to keep apart with ``prefix``.
    """
    p = prefix

    def col(name: str) -> Column:
        return F.col(f"`{p}{name}`")

    t = text_of(F.col(f"`{text}`"))
    n = col("n_words")

    def hashes() -> Column:
        window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(col("w"), i + k) for k in range(WINDOW)]))
        return F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>"))

    def covered() -> Column:
        """Words covered by repeated windows: sort (hash, position), keep those
        with an equal neighbour, then add up the union of their extents."""
        pairs = F.sort_array(F.transform(col("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            return F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))

        starts = F.sort_array(F.transform(let(pairs, repeated), lambda e: e["i"]))
        zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("end"))
        return F.aggregate(
            starts, zero,
            lambda a, i: F.struct((a["c"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("c"), (i + WINDOW).alias("end")),
            lambda a: a["c"])

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def removed(pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    d = stepwise(docs, [
        (f"{p}w", lambda: space_words(t)),
        (f"{p}n_words", lambda: F.size(col("w")).cast("long")),
        (f"{p}h", hashes),
        (f"{p}lines", lambda: lines),
        (f"{p}word_chars", lambda: F.length(F.array_join(col("w"), "")).cast("long")),
        (f"{p}n_symbols", lambda: removed(SYMBOLS).cast("long")),
        (f"{p}n_dup_lines", lambda: (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long")),
        (f"{p}n_lines", lambda: F.size(col("lines")).cast("long")),
        (f"{p}n_repeat_words", lambda: F.when(
            F.size(F.array_distinct(col("h"))) == F.size(col("h")), F.lit(0)).otherwise(covered()).cast("long")),
        (f"{p}n_upper", lambda: removed(r"\p{Lu}").cast("long")),
        (f"{p}n_marks", lambda: removed(r"[.,!?;:]").cast("long")),
    ])
    return d.drop(f"{p}w", f"{p}h", f"{p}lines")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 20) | (n_repeat * 100 > n_words * 30)


def features(prefix: str = "") -> list[Column]:
    """The transformed statistic vector, as whole numbers of 1/UNIT."""
    def c(name: str) -> Column:
        return F.col(f"`{prefix}{name}`").cast("double")

    words = F.greatest(c("n_words"), F.lit(1.0))
    lines = F.greatest(c("n_lines"), F.lit(1.0))
    raw = [F.log1p(c("word_chars") / words), F.log1p(c("n_symbols") / words), F.log1p(c("n_marks") / words),
           F.sqrt(c("n_upper") / F.greatest(c("word_chars"), F.lit(1.0))),
           c("n_dup_lines") / lines, c("n_repeat_words") / words]
    return [F.round(x * UNIT) for x in raw]


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= z / k
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(share: float, p: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < share else (lo, mid)
    return hi


def consistency(support: float, p: int) -> float:
    """Factor that makes the covariance of the central ``support`` share of a
    normal sample unbiased."""
    return support / chi2_cdf(chi2_quantile(support, p), p + 2)


def _group_join(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's parameters; null keys equal null. Group
    parameters are one row per group, so the planner may broadcast them when
    they are small, and else splits a hot group of the sort-merge join."""
    r = params.select(*[F.col(k).alias(f"__g_{k}") for k in keys], *[c for c in params.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__g_{k}")) for k in keys])
    return rows.join(r, cond).drop(*[f"__g_{k}" for k in keys])


def _inverse_root(groups: DataFrame, p: int, factor: float) -> DataFrame:
    """Adds ``r_i_j``, the inverse of the Cholesky root of ``factor`` times the
    covariance ``v_i_j`` plus the ridge, by columns computed step by step."""
    def ridge(i: int, j: int) -> float:
        return (RIDGE[i] * UNIT) ** 2 if i == j else 0.0

    def entry(i: int, j: int) -> Column:
        s = f"v_{i}_{j} * {factor!r} + {ridge(i, j)!r}" + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
        return F.expr(f"sqrt(greatest({s}, 1e-6D)) as l_{i}_{j}" if i == j else f"({s}) / l_{j}_{j} as l_{i}_{j}")

    def inverse(i: int, j: int) -> Column:
        s = "".join(f" - l_{i}_{k} * r_{k}_{j}" for k in range(j, i))
        return F.expr(f"{'1D' if i == j else f'(0D{s})'} / l_{i}_{i} as r_{i}_{j}")

    g = groups
    for j in range(p):
        g = g.select("*", entry(j, j))
        g = g.select("*", *[entry(i, j) for i in range(j + 1, p)])
    for i in range(p):
        g = g.select("*", *[inverse(i, j) for j in range(i + 1)])
    return g.drop(*[c for c in g.columns if c.startswith(("l_", "v_"))])


def squared_distance(p: int) -> Column:
    """Squared Mahalanobis distance of ``x_0..`` from the joined parameters."""
    rows = [" + ".join(f"r_{i}_{j} * (x_{j} - m_{j})" for j in range(i + 1)) for i in range(p)]
    return F.expr(" + ".join(f"pow({y}, 2)" for y in rows))


def _counts(rows: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Exact counts of the whole-number values of every statistic and group."""
    long = rows.select(*keys, F.posexplode(F.array(*[F.col(f"x_{i}") for i in range(p)])).alias("dim", "x"))
    return long.groupBy(*keys, "dim", "x").agg(F.count(F.lit(1)).alias("n"))


def _ranked(counts: DataFrame, keys: list[str], x: str) -> DataFrame:
    by = Window.partitionBy(*keys, "dim")
    return counts.withColumn("cum", F.sum("n").over(by.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))) \
                 .withColumn("all", F.sum("n").over(by))


def _quantile(x: str, q: float) -> Column:
    return F.min(F.when(F.col("cum") >= F.col("all") * q, F.col(x)))


def _wide(g: DataFrame, keys: list[str], p: int) -> DataFrame:
    """One row per group of the rows ``dim``, ``m`` and ``scale``."""
    wide = g.groupBy(*keys).agg(
        *[F.max(F.when(F.col("dim") == i, F.col("m"))).alias(f"m_{i}") for i in range(p)],
        *[F.max(F.when(F.col("dim") == i, F.pow(F.col("scale"), 2))).alias(f"v_{i}_{i}") for i in range(p)])
    for i in range(p):
        for j in range(i):
            wide = wide.withColumn(f"v_{i}_{j}", F.lit(0.0))
    return wide


def _start(counts: DataFrame, keys: list[str], p: int) -> DataFrame:
    """Median and median absolute deviation of every statistic and group."""
    c = _ranked(counts, keys, "x").withColumn("m", _quantile("x", 0.5).over(Window.partitionBy(*keys, "dim")))
    c = c.groupBy(*keys, "dim", "m", F.abs(F.col("x") - F.col("m")).alias("off")).agg(F.sum("n").alias("n"))
    g = _ranked(c, keys, "off").groupBy(*keys, "dim").agg(F.max("m").alias("m"), _quantile("off", 0.5).alias("off"))
    return _wide(g.withColumn("scale", F.col("off") * 1.4826), keys, p)


def _sums(p: int) -> list[str]:
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    return ["count(1) as n", *[f"sum(x_{i}) as s_{i}" for i in range(p)], *[f"sum(x_{i} * x_{j}) as q_{i}_{j}" for i, j in pairs]]


def _moments(sums: DataFrame, keys: list[str], p: int) -> DataFrame:
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    return sums.selectExpr(*keys, *[f"s_{i} / n as m_{i}" for i in range(p)], *[f"q_{i}_{j} / n - (s_{i} / n) * (s_{j} / n) as v_{i}_{j}" for i, j in pairs])


def _concentrated(rows: DataFrame, keys: list[str], start: DataFrame, support: float, steps: int) -> DataFrame:
    """Location ``m_i`` and inverse root ``r_i_j`` of every group.

    ``rows`` holds ``keys`` and the whole-number statistics ``x_0..``. The
    support set of a step is every row whose distance bin lies at or below the
    bin in which the ``support`` share is reached, so ties stay together and
    the result does not depend on the order of the rows.
    """
    p = len(FEATURES)
    params = written(_inverse_root(start, p, 1.0), "mcd")
    names = [x.split(" as ")[1] for x in _sums(p)]
    for step in range(steps):
        d = _group_join(rows, params, keys).withColumn("d2", squared_distance(p))
        d = d.withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0 ** -6) * BINS_PER_OCTAVE))
        bins = d.groupBy(*keys, "bin").agg(*[F.expr(x) for x in _sums(p)])
        by = Window.partitionBy(*keys)
        before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inner = bins.withColumn("before", before).withColumn("all", F.sum("n").over(by)).where(F.col("before") < F.col("all") * support)
        g = inner.groupBy(*keys).agg(*[F.expr(f"sum({x}) as {x}") for x in names])
        factor = consistency(support, p) if step == steps - 1 else 1.0
        params = written(_inverse_root(_moments(g, keys, p), p, factor), "mcd")
    return params


def fit(rows: DataFrame, keys: list[str], support: float = HALF, steps: int = 4) -> DataFrame:
    """Location ``m_i`` and inverse root ``r_i_j`` of every group: the estimate
    from the ``support`` share of its rows, reweighted."""
    p = len(FEATURES)
    half = _concentrated(rows, keys, _start(_counts(rows, keys, p), keys, p), support, steps)
    core = _group_join(rows, half, keys).where(squared_distance(p) <= chi2_quantile(CORE, p))
    sums = core.groupBy(*keys).agg(*[F.expr(x) for x in _sums(p)])
    return written(_inverse_root(_moments(sums, keys, p), p, consistency(CORE, p)), "mcd")


def judge(stats: DataFrame, keys: list[str], prefix: str = "", support: float = HALF, steps: int = 4,
          max_distance: float = 5.5, min_group: int = 50) -> DataFrame:
    """``stats`` (from ``base_statistics``, as a written table: it is read
    several times) with ``base_failed``, ``distance`` and ``kept`` under
    ``prefix``; names that begin with ``__mcd_`` are reserved.

    The estimate uses every row that passes the base rule. Groups with fewer
    than ``min_group`` such rows are judged by the estimate of their first key
    alone (the language), and where that has too few, of all rows. A row that
    fails the base rule is not kept and has no distance if none of its group
    passes. Null keys form a group of their own. No row is added or lost, so
    repeated rows stay and an empty table gives an empty result.
    """
    p = len(FEATURES)
    own = [f"__mcd_k{i}" for i in range(len(keys))]
    failed = F.coalesce(base_failed(F.col(f"`{prefix}n_words`"), F.col(f"`{prefix}n_repeat_words`")), F.lit(True))
    fit_rows = stats.where(~failed).select(*[F.col(f"`{k}`").alias(v) for k, v in zip(keys, own, strict=True)],
                                           *[x.alias(f"x_{i}") for i, x in enumerate(features(prefix))])
    sizes = fit_rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n"))
    enough = [F.when(F.sum("n").over(Window.partitionBy(*own[:k])) >= min_group, F.lit(k)) for k in range(len(keys), 0, -1)]
    chosen = written(sizes.select(*own, F.coalesce(*enough, F.lit(0)).alias("level")), "mcd")
    needed = [r[0] for r in chosen.select("level").distinct().collect()]  # a number of keys: at most len(keys) + 1 values

    def at(level: int) -> list[Column]:
        return [F.when(F.lit(level > i), F.col(v)).alias(v) for i, v in enumerate(own)]

    xs = [f"x_{i}" for i in range(p)]
    levels = reduce(DataFrame.unionByName, [fit_rows.select(F.lit(k).alias("level"), *at(k), *xs) for k in needed or [0]])
    params = fit(levels, ["level", *own], support, steps)
    params = params.select("level", *own, F.array(*[F.col(f"m_{i}") for i in range(p)]).alias("__mcd_m"),
                           F.array(*[F.col(f"r_{i}_{j}") for i in range(p) for j in range(i + 1)]).alias("__mcd_r"))
    served = chosen.select(*[F.col(v).alias(f"{v}g") for v in own], "level",
                           *[F.when(F.col("level") > i, F.col(v)).alias(v) for i, v in enumerate(own)])
    # one row per group, written so that the planner knows its size before it shuffles the rows
    served = written(_group_join(served, params, ["level", *own]).select(*[f"{v}g" for v in own], "__mcd_m", "__mcd_r"), "mcd")
    cond = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"{v}g")) for k, v in zip(keys, own, strict=True)])
    out = stats.join(served, cond, "left")

    out = out.withColumn("__mcd_x", F.array(*features(prefix)))
    rows = [" + ".join(f"__mcd_r[{i * (i + 1) // 2 + j}] * (__mcd_x[{j}] - __mcd_m[{j}])" for j in range(i + 1)) for i in range(p)]
    total = F.expr(" + ".join(f"pow({y}, 2)" for y in rows))
    out = out.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}distance", F.sqrt(total))
    near = F.coalesce(F.col(f"`{prefix}distance`") <= max_distance, F.lit(False))
    out = out.withColumn(f"{prefix}kept", ~F.col(f"`{prefix}base_failed`") & near)
    return out.drop("__mcd_x", "__mcd_m", "__mcd_r", *[f"{v}g" for v in own])


def keep_good(docs: DataFrame, keys: list[str], text_col: str = "text", **rule) -> DataFrame:
    """``docs`` without the rows that ``judge`` rejects; all columns stay.

    The rows are written once with their statistics and read back for the
    verdict, so the texts are taken apart once and the wide rows are never
    shuffled: the groups' estimates come to them. Names that begin with
    ``__mcd_`` are reserved.
    """
    stats = written(base_statistics(docs, text_col, "__mcd_s_"), "quality-stats")
    return judge(stats, keys, "__mcd_s_", **rule).where(F.col("__mcd_s_kept")).select(*[f"`{c}`" for c in docs.columns])
