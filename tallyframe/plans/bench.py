"""BEN plans over ``events`` (bench runs) and ``part`` (policy samples).

Stand-in mapping (rows in the schema the operators expect, no results):
variant = event_type, batch_size = user_id % 3, p95_ms = value,
p50_ms = props.k, peak_rss_mb = user_id * 10, timestamp = ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import bench as B
from tallyframe.plans.common import t, tu

# The reference's shipped variant policy and two-level policy.
VARIANT_POLICY = {
    "variants": ["q8_0", "q4_K_M", "q4_0"],
    "rules": [
        {"min_free_gb": 4, "variant": "q8_0", "reason": "preferred"},
        {"min_free_gb": 0, "variant": "q4_K_M", "reason": "low-memory"},
        {"min_free_gb": -1, "variant": "q4_0", "reason": "emergency-fallback"},
    ],
    "force_variant": None,
}
TWO_LEVEL_POLICY = {"ram_low_gb": 4, "ram_medium_gb": 8,
                    "preferred_variant": "q8_0", "fallback_variant": "q4_0"}
RUN_BATCH_SIZES = (1, 4, 8)
#: Variants of the wide comparison, as a policy lists them.
COMPARED = ("click", "error", "purchase", "signup", "view")


def quant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tu(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("double")
    return e.select(
        F.col("event_id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("variant"),
        (F.col("user_id") % 3).cast("int").alias("batch_size"),
        k.alias("p50_ms"), F.col("value").alias("p95_ms"),
        (F.col("user_id") * 10.0).alias("peak_rss_mb"), F.col("event_id").alias("load_time_ms"),
        F.when(F.col("event_type") == "error", F.lit(None)).otherwise(k / 100.0).alias("obedience_pass_rate"),
        F.lit(None).cast("double").alias("tokens_per_sec"))


def bench_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bench-result JSON document per event, in the alias shapes the
    reference accepts (flat, nested, bytes or MB, flat or nested pass rate)."""
    e = t(spark, sf_dir, "events")
    et, v, u = F.col("event_type"), F.col("value"), F.col("user_id")
    k = F.get_json_object("props", "$.k").try_cast("int")
    lat = (F.when(et == "click", F.to_json(F.struct(v.alias("p95_ms"))))
           .when(et == "view", F.to_json(F.struct(v.alias("latency_p95_ms"))))
           .when(et == "purchase", F.to_json(F.struct(F.struct(v.alias("p95")).alias("latencies_ms"))))
           .when(et == "signup", F.to_json(F.struct(F.struct(v.alias("latency_p95_ms")).alias("latency_ms"))))
           .otherwise(F.lit("{}")))
    rss = (F.when(u % 4 == 0, F.to_json(F.struct((u * 100.0).alias("rss_mb"))))
           .when(u % 4 == 1, F.to_json(F.struct((u * 1048576 * 60).alias("peak_rss"))))
           .when(u % 4 == 2, F.to_json(F.struct(F.lit(0).alias("peak_rss"), (u * 1048576 * 50).alias("rss_bytes"))))
           .otherwise(F.lit("{}")))
    pr = (F.when(k % 3 == 0, F.to_json(F.struct((k / 100.0 + 0.5).alias("obedience_pass_rate"))))
          .when(k % 3 == 1, F.to_json(F.struct(F.struct((k / 100.0 + 0.5).alias("pass_rate")).alias("obedience"))))
          .otherwise(F.lit("{}")))
    # merge the three fragments into one object
    js = F.concat(F.lit("{"), F.concat_ws(",", *[F.nullif(F.regexp_replace(x, r"^\{|\}$", ""), F.lit(""))
                                             for x in (lat, rss, pr)]), F.lit("}"))
    return e.select("event_id", js.alias("result"))


def summarize(spark, sf_dir):
    s = B.summarize_runs(quant_runs(spark, sf_dir))
    return s.select("variant", "batch_size", "runs",
                    *[F.round(f"{m}_avg", 6).alias(f"{m}_avg") for m in B.RUN_METRICS])


def percentiles(spark, sf_dir):
    r = quant_runs(spark, sf_dir)
    p = B.latency_percentiles(r, ["variant"], "p95_ms", scale=1.0,
                              ps={"p50": 0.50, "p95": 0.95, "p99": 0.99})
    return p.select("variant", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def gate(spark, sf_dir):
    j = bench_result_json(spark, sf_dir)
    m = j.select("event_id", B.metric_p95(F.col("result")).alias("p95_ms"),
                 B.metric_rss_mb(F.col("result")).alias("rss_mb"),
                 B.metric_pass_rate(F.col("result")).alias("obedience_pass_rate"))
    g = B.threshold_gate(m, thresholds={"p95_ms": 40.0, "rss_max_mb": 6000.0, "obedience_pass_rate": 0.9})
    return g.select("event_id", F.round("p95_ms", 6).alias("p95_ms"), F.round("rss_mb", 6).alias("rss_mb"),
                    F.round("obedience_pass_rate", 6).alias("obedience_pass_rate"),
                    "p95_ok", "rss_ok", "pass_rate_ok", "passed")


def as_policy_samples(part):
    return part.select("p_partkey", (F.col("p_size") / 4.0).alias("free_gb"))


def policy_samples(spark, sf_dir):
    return as_policy_samples(t(spark, sf_dir, "part"))


def choose(spark, sf_dir):
    return B.choose_variant(policy_samples(spark, sf_dir), "free_gb", VARIANT_POLICY)


def choose_forced(spark, sf_dir):
    pol = dict(VARIANT_POLICY, force_variant="q4_0")
    return B.choose_variant(policy_samples(spark, sf_dir), "free_gb", pol)


def choose_two(spark, sf_dir):
    return B.choose_two_level(policy_samples(spark, sf_dir), "free_gb", TWO_LEVEL_POLICY)


def matrix(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    variants = o.select(F.col("o_orderpriority").alias("variant"))
    files = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderpriority").alias("variant"))
    return B.run_matrix(variants, RUN_BATCH_SIZES, files)


def latest(spark, sf_dir):
    r = quant_runs(spark, sf_dir).select("variant", "event_id", "timestamp", "p95_ms", "peak_rss_mb")
    return B.latest_result(r, ["variant"], "timestamp", "event_id")


def peak(spark, sf_dir):
    e = tu(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return B.running_peak(e, ["event_type"], "ts", "event_id", "value").select(
        "event_id", "event_type", "value", "running_peak")


def compare(spark, sf_dir):
    l = latest(spark, sf_dir)
    return B.compare_variants(l, "variant", ["p95_ms", "peak_rss_mb"], COMPARED)


def gates(spark, sf_dir):
    p = B.latency_percentiles(quant_runs(spark, sf_dir), ["variant"], "p95_ms", scale=1.0,
                              ps={"p95": 0.95})
    return B.gate_status(p, p95="p95", p95_gate=49.5).select("variant", F.round("p95", 6).alias("p95"), "p95_status")


def sorted_parts(spark, sf_dir):
    return B.sort_by_name(t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), "name")


_RUNS_SQL = """runs AS (
  SELECT event_id, ts AS timestamp, event_type AS variant, CAST(user_id % 3 AS INTEGER) AS batch_size,
         TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS p50_ms, value AS p95_ms,
         user_id * 10.0 AS peak_rss_mb, event_id AS load_time_ms,
         CASE WHEN event_type = 'error' THEN NULL
              ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 END AS obedience_pass_rate,
         CAST(NULL AS DOUBLE) AS tokens_per_sec
  FROM events)"""

SQL_SUMMARIZE = "WITH " + _RUNS_SQL + """
SELECT variant, batch_size, CAST(count(*) AS BIGINT) AS runs,
""" + ",\n".join(f"  round(avg({m}), 6) AS {m}_avg" for m in B.RUN_METRICS) + """
FROM runs GROUP BY variant, batch_size"""

SQL_PERCENTILES = """
SELECT event_type AS variant, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
FROM events GROUP BY event_type"""

SQL_GATE = """
WITH j AS (
  SELECT event_id, event_type AS et, value AS v, user_id AS u,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m AS (
  SELECT event_id,
         CASE WHEN et IN ('click', 'view', 'purchase', 'signup') THEN v END AS p95_ms,
         CASE WHEN u % 4 = 0 THEN u * 100.0
              WHEN u % 4 = 1 THEN (u * 1048576 * 60) / 1048576.0
              WHEN u % 4 = 2 THEN CASE WHEN u * 1048576 * 50 = 0 THEN NULL ELSE (u * 1048576 * 50) / 1048576.0 END
         END AS rss_mb,
         CASE WHEN k % 3 IN (0, 1) THEN k / 100.0 + 0.5 END AS pr
  FROM j)
SELECT event_id, round(p95_ms, 6) AS p95_ms, round(rss_mb, 6) AS rss_mb, round(pr, 6) AS obedience_pass_rate,
       coalesce(p95_ms <= 40.0, false) AS p95_ok, coalesce(rss_mb <= 6000.0, true) AS rss_ok,
       coalesce(pr >= 0.9, true) AS pass_rate_ok,
       coalesce(p95_ms <= 40.0, false) AND coalesce(rss_mb <= 6000.0, true) AND coalesce(pr >= 0.9, true) AS passed
FROM m"""

SQL_CHOOSE = """
WITH s AS (SELECT p_partkey, p_size / 4.0 AS free_gb FROM part),
rules(min_free_gb, variant, reason, ord) AS (VALUES (4.0, 'q8_0', 'preferred', 0),
  (0.0, 'q4_K_M', 'low-memory', 1), (-1.0, 'q4_0', 'emergency-fallback', 2)),
m AS (
  SELECT s.p_partkey, s.free_gb, r.variant, r.reason,
         row_number() OVER (PARTITION BY s.p_partkey ORDER BY r.min_free_gb DESC, r.ord) AS rn
  FROM s LEFT JOIN rules r ON s.free_gb >= r.min_free_gb)
SELECT p_partkey, CAST(free_gb AS DOUBLE) AS free_gb, coalesce(variant, 'q4_0') AS variant,
       coalesce(reason, 'fallback:last_variant') AS reason
FROM m WHERE rn = 1"""

SQL_CHOOSE_FORCED = """
SELECT p_partkey, CAST(p_size / 4.0 AS DOUBLE) AS free_gb, 'q4_0' AS variant, 'force_variant' AS reason FROM part"""

SQL_CHOOSE_TWO = """
SELECT p_partkey, CAST(p_size / 4.0 AS DOUBLE) AS free_gb,
       CASE WHEN p_size / 4.0 >= 4 THEN 'q8_0' ELSE 'q4_0' END AS variant,
       CASE WHEN p_size / 4.0 >= 8 THEN 'free>=ram_medium_gb'
            WHEN p_size / 4.0 >= 4 THEN 'free>=ram_low_gb' ELSE 'fallback' END AS reason
FROM part"""

SQL_MATRIX = """
SELECT v.variant, CAST(b.batch_size AS INTEGER) AS batch_size
FROM (SELECT DISTINCT o_orderpriority AS variant FROM orders
      WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F')) v,
     (VALUES (1), (4), (8)) b(batch_size)"""

SQL_LATEST = "WITH " + _RUNS_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY timestamp DESC, event_id DESC) AS rn FROM runs)
SELECT variant, event_id, timestamp, p95_ms, peak_rss_mb FROM r WHERE rn = 1"""

SQL_PEAK = """
SELECT event_id, event_type, value,
       max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_peak
FROM events"""

SQL_COMPARE = "WITH " + _RUNS_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY timestamp DESC, event_id DESC) AS rn FROM runs),
l AS (SELECT * FROM r WHERE rn = 1)
SELECT """ + ",\n".join(
    f"  max(CASE WHEN variant = '{v}' THEN {m} END) AS {v}_{m}"
    for v in ("click", "error", "purchase", "signup", "view") for m in ("p95_ms", "peak_rss_mb")) + """
FROM l"""

SQL_GATES = """
SELECT event_type AS variant, round(quantile_cont(value, 0.95), 6) AS p95,
       CASE WHEN quantile_cont(value, 0.95) <= 49.5 THEN 0 ELSE 1 END AS p95_status
FROM events GROUP BY event_type"""

SQL_SORTED_PARTS = "SELECT p_partkey, p_name AS name FROM part ORDER BY p_name"

QUERIES = {
    "ben_summarize_runs": (summarize, SQL_SUMMARIZE),
    "ben_latency_percentiles": (percentiles, SQL_PERCENTILES),
    "ben_threshold_gate": (gate, SQL_GATE),
    "ben_choose_variant": (choose, SQL_CHOOSE),
    "ben_choose_variant_forced": (choose_forced, SQL_CHOOSE_FORCED),
    "ben_choose_two_level": (choose_two, SQL_CHOOSE_TWO),
    "ben_run_matrix": (matrix, SQL_MATRIX),
    "ben_latest_result": (latest, SQL_LATEST),
    "ben_running_peak": (peak, SQL_PEAK),
    "ben_compare_variants": (compare, SQL_COMPARE),
    "ben_gate_status": (gates, SQL_GATES),
    "ben_sort_by_name": (sorted_parts, SQL_SORTED_PARTS),
}
