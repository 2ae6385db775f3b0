"""BEN operators: policy rules, exact percentiles, gates, summaries."""

import numpy as np
from pyspark.sql import functions as F

from tallyframe.functions.quantiles import exact_percentiles
from tallyframe.operators import bench as B
from tallyframe.plans.bench import TWO_LEVEL_POLICY, VARIANT_POLICY


def _choose(spark, policy, free):
    df = spark.createDataFrame([(float(f),) for f in free], "free_gb double")
    return [(r.variant, r.reason) for r in B.choose_variant(df, "free_gb", policy).collect()]


def test_policy_rule_table(spark):
    got = _choose(spark, VARIANT_POLICY, [2.0, 4.0, 12.5])
    assert [v for v, _ in got] == ["q4_K_M", "q8_0", "q8_0"]
    assert all(r for _, r in got)


def test_policy_force_and_fallback(spark):
    forced = dict(VARIANT_POLICY, force_variant="q4_0")
    assert _choose(spark, forced, [10.0]) == [("q4_0", "force_variant")]
    no_match = {"variants": ["a", "b"], "rules": [{"min_free_gb": 100, "variant": "a", "reason": "big"}]}
    assert _choose(spark, no_match, [1.0]) == [("b", "fallback:last_variant")]
    # equal thresholds keep listing order
    tie = {"variants": ["x", "y"], "rules": [{"min_free_gb": 1, "variant": "x", "reason": "first"},
                                             {"min_free_gb": 1, "variant": "y", "reason": "second"}]}
    assert _choose(spark, tie, [5.0]) == [("x", "first")]


def test_two_level(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (8.0,)], "free_gb double")
    got = [(r.variant, r.reason) for r in B.choose_two_level(df, "free_gb", TWO_LEVEL_POLICY).collect()]
    assert got == [("q4_0", "fallback"), ("q8_0", "free>=ram_low_gb"), ("q8_0", "free>=ram_medium_gb")]


def _ref_percentile(values, p):
    v = sorted(values)
    k = (len(v) - 1) * p
    f = int(k)
    c = min(f + 1, len(v) - 1)
    return v[f] + (v[c] - v[f]) * (k - f)


def test_exact_percentiles_match_interpolation(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.exponential(5, 20000)]          # one hot group
    rows += [("cold", float(x)) for x in rng.normal(size=7)] + [("one", 4.0)]
    rows += [("dup", 1.0)] * 50 + [("dup", 2.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, accuracy=200).collect()}
    for g in ("hot", "cold", "one", "dup"):
        vals = [v for k, v in rows if k == g]
        assert abs(got[g][0] - _ref_percentile(vals, 0.5)) < 1e-9
        assert abs(got[g][1] - _ref_percentile(vals, 0.95)) < 1e-9


def test_metric_aliases_and_gate(spark):
    docs = ['{"p95_ms": 10, "rss_mb": 100}', '{"latencies": {"latency_p95_ms": 20}, "peak_rss": 0, "rss_bytes": 1048576}',
            '{"latency_ms": {"p95": 5000}, "obedience": {"pass_rate": 0.5}}', '{"peak_rss": 2097152}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    m = df.select(B.metric_p95(F.col("j")).alias("p95_ms"), B.metric_rss_mb(F.col("j")).alias("rss_mb"),
                  B.metric_pass_rate(F.col("j")).alias("obedience_pass_rate"))
    rows = B.threshold_gate(m).collect()
    assert [r.p95_ms for r in rows] == [10.0, 20.0, 5000.0, None]
    assert [r.rss_mb for r in rows] == [100.0, 1.0, None, 2.0]
    assert [r.p95_ok for r in rows] == [True, True, False, False]
    assert [r.passed for r in rows] == [True, True, False, False]
    assert rows[2].pass_rate_ok is False and rows[0].pass_rate_ok is True


def test_summarize_runs_nulls_and_booleans(spark):
    df = spark.createDataFrame([("a", 1, 10.0, True), ("a", 1, None, False), (None, None, 3.0, None)],
                               "variant string, batch_size int, p95_ms double, obedience_pass_rate boolean")
    got = {(r.variant, r.batch_size): r for r in B.summarize_runs(df).collect()}
    assert got[("a", 1)].runs == 2 and got[("a", 1)].p95_ms_avg == 10.0
    assert got[("a", 1)].obedience_pass_rate_avg == 0.5
    assert got[(None, None)].p50_ms_avg is None


def test_running_peak_of_one_crowded_hour(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=i // 3), None if i % 5 == 0 else "p", None if i % 7 == 0 else float((i * 37) % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, name string, v double")
    got = {r.id: r.running_peak for r in B.running_peak(df, ["name"], "ts", "id", "v", buckets=16).collect()}
    peaks = {}
    for i, _, name, v in rows:
        peaks[name] = v if peaks.get(name) is None else peaks[name] if v is None else max(peaks[name], v)
        assert got[i] == peaks[name]
    ranged = df.repartitionByRange(16, F.col("name").asc_nulls_first(), "ts", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 600


def test_running_peak_two_level(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=5 * i), "p", float((i * 37) % 11)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, name string, v double")
    got = sorted((r.id, r.running_peak) for r in B.running_peak(df, ["name"], "ts", "id", "v").collect())
    peak, want = -1.0, []
    for i, _, _, v in rows:
        peak = max(peak, v)
        want.append((i, peak))
    assert got == want


def test_exact_percentiles_refinement_rounds(spark):
    """Tiny max_band_rows forces the hot-group refinement path, incl. a
    bracket made of one repeated value."""
    rng = np.random.default_rng(9)
    rows = [("hot", float(x)) for x in rng.normal(size=5000)] + [("hot", 0.5)] * 3000
    rows += [("dup", 7.0)] * 400 + [("dup", 8.0)] * 3 + [("small", 1.0), ("small", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    ps = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    for acc in (50, 3):          # 3: sketch brackets miss and widen to the whole group
        got = {r.g: r for r in exact_percentiles(df, ["g"], "v", ps, accuracy=acc, max_band_rows=40,
                                                 grid=8).collect()}
        for g in ("hot", "dup", "small"):
            vals = [v for k, v in rows if k == g]
            for name, p in ps.items():
                assert abs(getattr(got[g], name) - _ref_percentile(vals, p)) < 1e-9, (acc, g, name)


def test_latency_percentiles_methods(spark):
    vals = [float(i) for i in range(1, 1001)]
    df = spark.createDataFrame([("v", x / 1000.0) for x in vals], "g string, latency_s double")
    ex = B.latency_percentiles(df, ["g"]).first()
    ap = B.latency_percentiles(df, ["g"], method="approx", accuracy=1000).first()
    assert abs(ex.p50_ms - _ref_percentile(vals, 0.5)) < 1e-9 and abs(ex.p95_ms - _ref_percentile(vals, 0.95)) < 1e-9
    assert abs(ap.p95_ms - ex.p95_ms) <= 2.0            # within the sketch's rank error
