"""Bench-run operators: metric extraction, roll-ups, gates and variant policy
(P7, A1, A2, A11, F5, J6, J7, J9, W2, W6, V3, T3)."""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.quantiles import approx_percentiles, exact_percentiles
from tallyframe.functions.util import running_agg
from tallyframe.session import materialize

# Metric names of a quant run summary, in output order.
RUN_METRICS = ("p50_ms", "p95_ms", "peak_rss_mb", "load_time_ms",
               "obedience_pass_rate", "tokens_per_sec")

# Alias order for bench result files.
P95_FLAT_KEYS = ("p95_ms", "latency_p95_ms", "tokens_p95_ms")
P95_NESTED_PARENTS = ("latencies_ms", "latency_ms", "latencies")
P95_NESTED_KEYS = ("p95", "latency_p95_ms")
RSS_MB_KEYS = ("rss_mb", "max_rss_mb", "rss_peak_mb")
RSS_BYTES_KEYS = ("peak_rss", "rss_bytes")
BYTES_PER_MB = 1048576.0

# Default gates.
DEFAULT_THRESHOLDS = {"p95_ms": 3500.0, "obedience_pass_rate": 1.0, "rss_max_mb": 12288.0}
DEFAULT_P95_GATE_MS = 2000.0
DEFAULT_VALID_RATE_GATE = 0.85


def _num(js: Column, path: str) -> Column:
    return F.get_json_object(js, path).try_cast("double")


def metric_p95(js: Column) -> Column:
    """First non-null p95 over the flat aliases, then nested ones."""
    cands = [_num(js, f"$.{k}") for k in P95_FLAT_KEYS]
    for parent in P95_NESTED_PARENTS:
        for k in P95_NESTED_KEYS:
            cands.append(_num(js, f"$.{parent}.{k}"))
    return F.coalesce(*cands)


def metric_rss_mb(js: Column) -> Column:
    """Rss in MB aliases, else a truthy byte count (0 falls through) / 2^20."""
    mb = F.coalesce(*[_num(js, f"$.{k}") for k in RSS_MB_KEYS])
    by = F.coalesce(*[F.nullif(_num(js, f"$.{k}"), F.lit(0.0)) for k in RSS_BYTES_KEYS])
    return F.coalesce(mb, by / F.lit(BYTES_PER_MB))


def metric_pass_rate(js: Column) -> Column:
    """Flat ``obedience_pass_rate`` else ``obedience.pass_rate``."""
    return F.coalesce(_num(js, "$.obedience_pass_rate"), _num(js, "$.obedience.pass_rate"))


def to_mb(bytes_col: Column) -> Column:
    """Bytes -> MB (2^20)."""
    return bytes_col.cast("double") / F.lit(BYTES_PER_MB)


def summarize_runs(runs: DataFrame, keys: Sequence[str] = ("variant", "batch_size"),
                   metrics: Iterable[str] = RUN_METRICS) -> DataFrame:
    """A1: per (variant, batch_size) - null keys form their own group - the
    run count and the mean of each metric over its numeric values only
    (booleans count 0/1); a metric with no numeric value gives null."""
    # a text column holds no numbers, whatever its texts look like
    present = {f.name for f in runs.schema.fields if f.dataType.simpleString() != "string"}
    aggs = [F.count(F.lit(1)).cast("bigint").alias("runs")]
    for m in metrics:
        v = F.col(m).try_cast("double") if m in present else F.lit(None).cast("double")
        aggs.append(F.avg(v).alias(f"{m}_avg"))
    return runs.groupBy(*keys).agg(*aggs)


def latency_percentiles(samples: DataFrame, keys: list[str], value: str = "latency_s",
                        scale: float = 1000.0, ps: dict[str, float] | None = None,
                        method: str = "exact", accuracy: int = 10000) -> DataFrame:
    """A2: linear-interpolated percentiles per group, times ``scale``
    (seconds -> ms). ``exact`` uses the skew-safe exact algorithm;
    ``approx`` is the one-pass mergeable sketch (rank error <= n / accuracy,
    returns a sample value rather than an interpolation)."""
    ps = ps or {"p50_ms": 0.50, "p95_ms": 0.95}
    if method == "approx":
        r = approx_percentiles(samples, keys, value, ps, accuracy)
    elif method == "exact":
        r = exact_percentiles(samples, keys, value, ps, accuracy)
    else:
        raise ValueError("method must be 'exact' or 'approx'")
    return r.select(*keys, *[(F.col(n) * F.lit(scale)).alias(n) for n in ps])


def threshold_gate(results: DataFrame, p95: str = "p95_ms", rss: str = "rss_mb",
                   pass_rate: str = "obedience_pass_rate",
                   thresholds: dict | None = None) -> DataFrame:
    """p95 <= limit (missing p95 fails); rss and pass rate are only
    checked when present. The thresholds are literals (one config row), so no
    join is needed."""
    th = dict(DEFAULT_THRESHOLDS)
    th.update(thresholds or {})
    p95_ok = F.coalesce(F.col(p95) <= F.lit(float(th["p95_ms"])), F.lit(False))
    rss_ok = F.coalesce(F.col(rss) <= F.lit(float(th["rss_max_mb"])), F.lit(True))
    pr_ok = F.coalesce(F.col(pass_rate) >= F.lit(float(th["obedience_pass_rate"])), F.lit(True))
    return (results.withColumn("p95_ok", p95_ok).withColumn("rss_ok", rss_ok)
            .withColumn("pass_rate_ok", pr_ok)
            .withColumn("passed", p95_ok & rss_ok & pr_ok))


def choose_variant(samples: DataFrame, free_gb: str, policy: dict) -> DataFrame:
    """As-of rule match - the rule with the highest ``min_free_gb`` that is
    <= the sample (missing threshold = -1, equal thresholds keep listing
    order); ``force_variant`` wins; no match -> last listed variant with reason
    ``fallback:last_variant``. The policy is a small config, compiled into one
    CASE ladder (codegen, no join)."""
    variants = list(policy.get("variants") or [])
    force = policy.get("force_variant")
    if force:
        return samples.withColumn("variant", F.lit(force)).withColumn("reason", F.lit("force_variant"))
    rules = sorted((dict(r) for r in policy.get("rules") or []),
                   key=lambda r: r.get("min_free_gb", -1) if r.get("min_free_gb") is not None else -1,
                   reverse=True)
    fb_v = F.lit(variants[-1]) if variants else F.lit(None).cast("string")
    fb_r = F.lit("fallback:last_variant") if variants else F.lit(None).cast("string")
    v_expr, r_expr = fb_v, fb_r
    for r in reversed(rules):
        th = r.get("min_free_gb", -1)
        th = -1 if th is None else th
        cond = F.col(free_gb) >= F.lit(float(th))
        v_expr = F.when(cond, F.lit(r.get("variant"))).otherwise(v_expr)
        r_expr = F.when(cond, F.lit(r.get("reason"))).otherwise(r_expr)
    return samples.withColumn("variant", v_expr).withColumn("reason", r_expr)


def choose_two_level(samples: DataFrame, free_gb: str, policy: dict) -> DataFrame:
    """>= medium or >= low -> preferred (different reasons), else fallback."""
    med, low = float(policy["ram_medium_gb"]), float(policy["ram_low_gb"])
    f = F.col(free_gb)
    return (samples
            .withColumn("variant", F.when(f >= med, F.lit(policy["preferred_variant"]))
                        .when(f >= low, F.lit(policy["preferred_variant"]))
                        .otherwise(F.lit(policy["fallback_variant"])))
            .withColumn("reason", F.when(f >= med, F.lit("free>=ram_medium_gb"))
                        .when(f >= low, F.lit("free>=ram_low_gb")).otherwise(F.lit("fallback"))))


def run_matrix(variants: DataFrame, batch_sizes: Sequence[int], files: DataFrame,
               variant: str = "variant") -> DataFrame:
    """Variants x batch sizes, keeping variants whose file exists. The
    batch-size list is a literal array exploded per row (no join), the file
    check a left-semi join."""
    v = variants.select(variant).distinct().join(files.select(variant), variant, "left_semi")
    return v.withColumn("batch_size", F.explode(F.array(*[F.lit(int(b)) for b in batch_sizes])))


def latest_result(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Newest row per group by ``ts`` (tie -> larger ``tie``), via
    ``max_by`` (partial aggregation; no group is gathered in one buffer)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col(ts), F.col(tie)))
    return df.groupBy(*keys).agg(packed.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others])


def running_peak(samples: DataFrame, keys: list[str], ts: str, tie: str, value: str, out: str = "running_peak",
                 buckets: int | None = None) -> DataFrame:
    """Peak value so far per key in time order. The rows are cut into
    ranges of (key, time, tie) by splitters from a sample of the rows, so the
    ranges hold about equal numbers of rows whatever the clock or the share of
    a key; a two-level scan runs inside the ranges and over their peaks. The
    number of ranges is the shuffle width, or ``buckets``."""
    n = buckets or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = samples.repartitionByRange(n, *[F.col(k).asc_nulls_first() for k in keys], F.col(ts), F.col(tie))
    # written, as the splitters of a second run of the sampling may differ
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()), "peak-ranges")
    return running_agg(ranged, keys, [ts, tie], value, F.col("__range"), out, "max").drop("__range")


def compare_variants(latest: DataFrame, variant: str, metrics: list[str], variants: Sequence[str]) -> DataFrame:
    """One wide row with each metric of the policy's ``variants``; the
    long form is ``latest`` itself. One aggregate, no job for the values."""
    return latest.agg(*[F.max(F.when(F.col(variant) == v, F.col(m))).alias(f"{v}_{m}") for v in variants for m in metrics])


def gate_status(df: DataFrame, valid_rate: str | None = None, p95: str | None = None,
                valid_gate: float = DEFAULT_VALID_RATE_GATE,
                p95_gate: float = DEFAULT_P95_GATE_MS) -> DataFrame:
    """V3: exit status columns - 2 when the valid rate is below the gate, 1
    when p95 exceeds its gate, else 0."""
    out = df
    if valid_rate:
        out = out.withColumn("valid_status", F.when(F.col(valid_rate) < F.lit(valid_gate), F.lit(2)).otherwise(F.lit(0)))
    if p95:
        out = out.withColumn("p95_status", F.when(F.col(p95) <= F.lit(p95_gate), F.lit(0)).otherwise(F.lit(1)))
    return out


def sort_by_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Catalog ordered by name (range-partitioned global sort)."""
    return df.orderBy(F.col(name).asc())

