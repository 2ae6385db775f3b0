"""Plans for the declared log operators and remaining catalog/validation
helpers (F7, W7, P26, A13, J11, J14, R7, P6, P22)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import bench as B
from tallyframe.operators import catalog as C
from tallyframe.operators import logs as L
from tallyframe.operators import validate as V
from tallyframe.plans import bench as PB
from tallyframe.plans import validate as PV
from tallyframe.plans.common import t, tu
from tallyframe.session import scratch_path
from tallyframe.streaming import events as E


def recent_errors(spark: SparkSession, sf_dir: str):
    e = tu(spark, sf_dir, "events")
    return L.log_query(e, "event_type", ["error", "signup"], "ts", 20, ["event_id", "ts", "event_type"], tie="event_id")


def _doc_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def context_lines(spark, sf_dir):
    lines = _doc_lines(spark, sf_dir)
    ctx = L.log_context(lines, ["doc_id"], "line_no", F.col("line").contains("License"), 2)
    return ctx.select("doc_id", "line_no", F.md5("line").alias("line_md5"))


def placeholder_refs(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    txt = F.concat(F.lit("use ${steps."), F.col("role"), F.lit(".result.text} then ${slots.s"),
                   F.col("conv_id").cast("string"), F.lit("}"),
                   F.when(F.col("turn") % 2 == 0, F.lit(" and ${steps.prev.result.id}")).otherwise(F.lit("")))
    x = c.select("conv_id", "turn", F.posexplode(L.placeholders(txt)).alias("i", "p"))
    return x.select("conv_id", "turn", "i", "p.kind", "p.name", "p.field")


def ordered_words(spark, sf_dir):
    b = t(spark, sf_dir, "benchmark")
    w = C.distinct_ordered(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\s]", "")), r"\s+"))
    return b.select("item_id", F.array_join(w, " ").alias("words"), F.size(w).alias("n"))


def layered(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    arr = lambda c: F.to_json(F.array(c))
    def layer(k, v, prio):
        return F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(prio).alias("priority"))
    src = p.select(F.col("p_partkey").alias("entity"), F.explode(F.array(
        layer("name", F.col("p_name"), 0),
        layer("name", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), 1),
        layer("size", F.col("p_size").cast("string"), 1),
        layer("tags", arr(F.col("p_type")), 2),
        layer("license", F.lit("mit"), 2),
        layer("tags", arr(F.col("p_brand")), 3),
        layer("name", F.when(F.col("p_size") > 40, F.upper("p_name")), 3),
        layer("size", F.when(F.col("p_partkey") % 5 == 0, (F.col("p_size") * 2).cast("string")), 4),
    )).alias("s")).select("entity", "s.key", "s.value", "s.priority").filter(F.col("value").isNotNull())
    return C.layered_metadata(src)


def companion_groups(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    p = t(spark, sf_dir, "part").select("p_partkey", "p_type")
    return _companion_groups(li, p)


def _companion_catalog(li, p):
    """Seven of the suffixes by line number; every third model holds packed parts."""
    packed = F.col("l_orderkey") % 3 == 0
    four = F.array(*[F.lit(s) for s in (".weight_packed", ".weight_shape", ".weight_scale", ".weight_zero_point")])
    seven = F.array(*[F.lit(s) for s in (".g_idx",) + C.COMPANION_SUFFIXES[:6]])
    sfx = F.when(packed, F.element_at(four, (F.col("l_linenumber") % 4 + 1).cast("int"))) \
        .otherwise(F.element_at(seven, (F.col("l_linenumber") % 7 + 1).cast("int")))
    kind = F.when(packed, F.lit("packed")).otherwise(F.lower("p_type"))
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_orderkey").alias("model"), F.concat(F.lit("blk.0."), kind, sfx).alias("name"))


def _companion_groups(li, p):
    r = C.companions(_companion_catalog(li, p))
    return r.select("model", "base", F.array_join("parts", ",").alias("parts"), "kind", "merged")


def merged_companions(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return C.merge_companions(_companion_catalog(li, t(spark, sf_dir, "part").select("p_partkey", "p_type")))


def decisions(spark, sf_dir):
    """One decision record per policy evaluation (value, choice, reason)."""
    s = PB.policy_samples(spark, sf_dir)
    return E.decision_log(B.choose_variant(s, "free_gb", PB.VARIANT_POLICY), "free_gb")


def decisions_streamed(spark, sf_dir):
    """The same decisions as a stream over the sample rows, read back from the log."""
    schema = t(spark, sf_dir, "part").schema
    samples = PB.as_policy_samples(E.event_stream(spark, sf_dir, schema, glob="part.parquet"))
    path = scratch_path(spark, "decision-log")
    E.decision_stream(samples, lambda b: B.choose_variant(b, "free_gb", PB.VARIANT_POLICY), "free_gb", path, scratch_path(spark, "decision-ckpt"))
    return spark.read.schema("value double, choice string, reason string").json(path).select("value", "choice", "reason")


def fingerprints(spark, sf_dir):
    p = PV.plan_texts(spark, sf_dir).select("conv_id", "turn", V.json_fragment(F.col("plan_text")).alias("v"))
    return p.select("conv_id", "turn", V.fingerprint(F.col("v")).alias("fingerprint"))


def contexts(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    # the text's lines are the snippets, the whole text is the query
    ctx = V.context_json(F.split("text", "\n"), F.struct(F.col("turn").alias("turn")), F.col("text"))
    return c.select("conv_id", "turn", F.md5(ctx).alias("context_md5"))


SQL_RECENT = """
SELECT event_id, ts, event_type FROM events WHERE event_type IN ('error', 'signup')
ORDER BY ts DESC, event_id DESC LIMIT 20"""

SQL_CONTEXT = """
WITH l AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT doc_id, line_no FROM l WHERE contains(line, 'License'))
SELECT DISTINCT l.doc_id, l.line_no, md5(l.line) AS line_md5
FROM l JOIN h ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2"""

SQL_PLACEHOLDERS = """
WITH x AS (
  SELECT conv_id, turn, 0 AS i, 'step' AS kind, role AS name, 'text' AS field FROM conversations
  UNION ALL SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END, 'slot', 's' || conv_id, NULL FROM conversations
  UNION ALL SELECT conv_id, turn, 1, 'step', 'prev', 'id' FROM conversations WHERE turn % 2 = 0)
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, kind, name, field FROM x"""

SQL_ORDERED_WORDS = """
WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\s]', '', 'g')), '\\s+')) AS word,
                  generate_subscripts(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\s]', '', 'g')), '\\s+'), 1) AS pos
           FROM benchmark),
f AS (SELECT item_id, word, min(pos) AS first FROM w GROUP BY item_id, word)
SELECT item_id, string_agg(word, ' ' ORDER BY first) AS words, CAST(count(*) AS INTEGER) AS n FROM f GROUP BY item_id"""

SQL_LAYERED = """
WITH s AS (
  SELECT p_partkey AS entity, 'name' AS key, p_name AS value, 0 AS priority FROM part
  UNION ALL SELECT p_partkey, 'name', p_brand, 1 FROM part WHERE p_size % 2 = 0
  UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 1 FROM part
  UNION ALL SELECT p_partkey, 'license', 'mit', 2 FROM part
  UNION ALL SELECT p_partkey, 'name', upper(p_name), 3 FROM part WHERE p_size > 40
  UNION ALL SELECT p_partkey, 'size', CAST(p_size * 2 AS VARCHAR), 4 FROM part WHERE p_partkey % 5 = 0)
SELECT entity, key, arg_max(value, priority) AS value FROM s GROUP BY entity, key
UNION ALL
SELECT p_partkey, 'tags', CAST(to_json(list_distinct_ordered) AS VARCHAR) FROM (
  SELECT p_partkey, CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END AS list_distinct_ordered FROM part)"""

_SQL_COMPANION_GROUPS = """c AS (
  SELECT l.l_orderkey AS model, 'blk.0.' || CASE WHEN l.l_orderkey % 3 = 0 THEN 'packed' ELSE lower(p.p_type) END AS base,
         CASE WHEN l.l_orderkey % 3 = 0 THEN ['.weight_packed', '.weight_shape', '.weight_scale', '.weight_zero_point'][l.l_linenumber % 4 + 1]
              ELSE ['.g_idx', '.weight', '.weight_scale', '.weight_scale_inv', '.qweight', '.qzeros', '.scales'][l.l_linenumber % 7 + 1] END AS part
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
g0 AS (SELECT model, base, list_sort(list_distinct(list(part))) AS parts FROM c GROUP BY model, base),
g AS (
  SELECT *, CASE WHEN list_has_all(parts, ['.weight', '.weight_scale_inv']) THEN 'fp8_scale_inv'
            WHEN list_has_all(parts, ['.weight', '.weight_scale']) THEN 'scaled'
            WHEN list_has_all(parts, ['.qweight', '.qzeros', '.scales']) THEN 'gptq'
            WHEN list_has_all(parts, ['.weight_packed', '.weight_shape', '.weight_scale']) THEN 'packed' ELSE 'plain' END AS kind FROM g0)"""

SQL_COMPANIONS = f"""
WITH {_SQL_COMPANION_GROUPS}
SELECT model, base, array_to_string(parts, ',') AS parts, kind, kind <> 'plain' AS merged FROM g"""

SQL_MERGED_COMPANIONS = f"""
WITH {_SQL_COMPANION_GROUPS}
SELECT model, base || '.weight' AS name, kind AS origin FROM g WHERE kind <> 'plain'
UNION ALL
SELECT model, base || part, 'kept' FROM (SELECT model, base, kind, unnest(parts) AS part FROM g)
WHERE NOT list_contains(CASE kind WHEN 'fp8_scale_inv' THEN ['.weight', '.weight_scale_inv'] WHEN 'scaled' THEN ['.weight', '.weight_scale']
  WHEN 'gptq' THEN ['.qweight', '.qzeros', '.scales', '.g_idx']
  WHEN 'packed' THEN ['.weight_packed', '.weight_shape', '.weight_scale', '.weight_zero_point'] ELSE [''] END, part)"""

SQL_DECISIONS = """
SELECT CAST(p_size / 4.0 AS DOUBLE) AS value,
       CASE WHEN p_size / 4.0 >= 4 THEN 'q8_0' WHEN p_size / 4.0 >= 0 THEN 'q4_K_M' ELSE 'q4_0' END AS choice,
       CASE WHEN p_size / 4.0 >= 4 THEN 'preferred' WHEN p_size / 4.0 >= 0 THEN 'low-memory' ELSE 'emergency-fallback' END AS reason
FROM part"""

SQL_CONTEXTS = """
SELECT conv_id, turn, md5('{"user_query":' || to_json(text) || ',"retrieval_snippets":' || to_json(string_split(text, chr(10)))
  || ',"state_snapshot":{"turn":' || turn || '}}') AS context_md5
FROM conversations"""

# canonical form of the stand-in plan texts: keys in order, no blanks, numbers without trailing zeros
SQL_FINGERPRINTS = """
WITH c AS (SELECT *, (conv_id * 1000 + turn) % 7 AS n FROM conversations),
j AS (
  SELECT conv_id, turn, CASE WHEN n <> 6 THEN '{'
      || CASE WHEN n = 1 THEN '' WHEN n = 4 THEN '"confidence":1.5,' WHEN turn % 10 = 0 THEN '"confidence":0,' ELSE '"confidence":0.' || turn % 10 || ',' END
      || '"intent":"' || role || '",' || CASE WHEN n = 2 THEN '"note":"extra",' ELSE '' END
      || '"slots":{"turn":' || turn || '},"sources":["conv-' || conv_id || '"],"steps":'
      || CASE WHEN n = 3 THEN '[]' ELSE '[{"api_call":"append_log","args":{"turn":' || turn || '},"expected_state":{},"step_label":"s1"}]' END || '}' END AS doc
  FROM c)
SELECT conv_id, turn, CASE WHEN doc IS NOT NULL THEN sha256(doc) END AS fingerprint FROM j"""

QUERIES = {
    "log_recent_errors": (recent_errors, SQL_RECENT),
    "log_context_lines": (context_lines, SQL_CONTEXT),
    "log_placeholders": (placeholder_refs, SQL_PLACEHOLDERS),
    "cat_distinct_ordered": (ordered_words, SQL_ORDERED_WORDS),
    "cat_layered_metadata": (layered, SQL_LAYERED),
    "cat_companions": (companion_groups, SQL_COMPANIONS),
    "cat_merge_companions": (merged_companions, SQL_MERGED_COMPANIONS),
    "mon_decision_log": (decisions, SQL_DECISIONS),
    "mon_decision_log_stream": (decisions_streamed, SQL_DECISIONS),
    "val_plan_fingerprint": (fingerprints, SQL_FINGERPRINTS),
    "val_context_json": (contexts, SQL_CONTEXTS),
}
