"""VAL plans over ``conversations`` (plan JSON stand-ins) and ``documents``.

Stand-in plan text per conversation turn (string concatenation, identical in
both engines); shape ``n = (conv_id * 1000 + turn) % 7``: 0 valid, 1 no
confidence, 2 extra root key, 3 empty steps, 4 confidence 1.5, 5 prose around
a valid object, 6 cut-off text. Operators never see ``n``; they parse text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import validate as V
from tallyframe.operators.retrieval import knn
from tallyframe.functions.embed import hash_embed
from tallyframe.plans.retrieval import SQL_KNN_DOCUMENTS
from tallyframe.plans.common import t


def _plan_text(conv_id: Column, turn: Column, role: Column, n: Column) -> Column:
    s = lambda c: c.cast("string")
    steps = F.concat(F.lit('[{"step_label":"s1","api_call":"append_log","args":{"turn":'), s(turn),
                     F.lit('},"expected_state":{}}]'))
    head = F.concat(F.lit('{"intent":"'), role, F.lit('","slots":{"turn":'), s(turn), F.lit('},"steps":'))
    src = F.concat(F.lit(',"sources":["conv-'), s(conv_id), F.lit('"]'))
    conf = F.concat(F.lit(',"confidence":0.'), s(turn % 10))
    base = F.concat(head, steps, src, conf, F.lit("}"))
    return (F.when(n == 1, F.concat(head, steps, src, F.lit("}")))
            .when(n == 2, F.concat(head, steps, src, conf, F.lit(',"note":"extra"}')))
            .when(n == 3, F.concat(head, F.lit("[]"), src, conf, F.lit("}")))
            .when(n == 4, F.concat(head, steps, src, F.lit(',"confidence":1.5}')))
            .when(n == 5, F.concat(F.lit("Sure, here is the plan: "), base, F.lit(" Hope this helps.")))
            .when(n == 6, F.substring(base, F.lit(1), (F.char_length(base) / 2).cast("int")))
            .otherwise(base))


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    n1 = (F.col("conv_id") * 1000 + F.col("turn")) % 7
    n2 = (F.col("conv_id") * 1000 + F.col("turn") + 3) % 7
    return c.select("conv_id", "turn", "role", "text",
                    _plan_text(F.col("conv_id"), F.col("turn"), F.col("role"), n1).alias("plan_text"),
                    _plan_text(F.col("conv_id"), F.col("turn"), F.col("role"), n2).alias("alt_text"))


def validate_plans(spark, sf_dir):
    p = plan_texts(spark, sf_dir).withColumn("pv", V.json_fragment(F.col("plan_text")))
    r = V.validate_contract(p, "pv")
    return r.select("conv_id", "turn", F.col("pv").isNotNull().alias("parsed"), "valid",
                    F.size("errors").alias("n_errors"), "extra_fields",
                    F.array_join(V.missing_keys(F.col("pv")), ",").alias("missing"),
                    F.array_join(V.unexpected_keys(F.col("pv")), ",").alias("unexpected"))


def cascade(spark, sf_dir):
    p = plan_texts(spark, sf_dir)
    p = p.select("conv_id", "turn", "role",
                 F.when(F.col("role") == "user", F.col("plan_text")).alias("remote"),
                 F.col("alt_text").alias("local"),
                 # a snippet whose step has a label of the wrong type makes the fallback itself invalid
                 F.array(F.when(F.col("turn") % 5 == 4, F.lit('{"steps":[{"step_label":7}]}'))
                         .when(F.col("turn") % 3 == 0, F.col("alt_text")).otherwise(F.col("text"))).alias("snippets"),
                 F.concat(F.lit("conv "), F.col("conv_id").cast("string"), F.lit(" turn "),
                          F.col("turn").cast("string")).alias("query"))
    r = V.resolve_cascade(p, "remote", "local", "snippets", "query")
    r = V.plan_fields(V.validate_contract(r, "plan"), "plan")
    return r.select("conv_id", "turn", "role", "chosen_by", "intent",
                    F.round("confidence", 6).alias("confidence"), "n_steps", "valid", "extra_fields")


def rollup(spark, sf_dir):
    r = cascade(spark, sf_dir)
    a = V.obedience_rollup(r, keys=["role"])
    return a.select("role", "total", "valid_count", F.round("valid_rate", 6).alias("valid_rate"),
                    "extra_field_count", F.round("avg_confidence", 6).alias("avg_confidence"))


def normalized_steps(spark, sf_dir):
    p = plan_texts(spark, sf_dir)
    st = V.normalize_steps(F.col("alt_text"))
    return p.select("conv_id", "turn", F.size(st).alias("n_steps"),
                    F.array_join(F.transform(st, lambda x: F.get_json_object(x, "$.step_label")), ",").alias("labels"))


_TOKEN_RE = r'token = "([0-9a-f]+)"'


def mask_tokens(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    toks = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN_RE), 1)).alias("pos", "token"))
    return toks.select("doc_id", "pos", V.mask_secret(F.col("token")).alias("masked"),
                       V.mask_secret(F.substring("token", 1, 6)).alias("masked_short"))


def mask_headers(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    toks = d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_TOKEN_RE), 1)).alias("pos", "token"))
    h = toks.select("doc_id", "pos", F.create_map(
        F.lit("Authorization"), F.concat(F.lit("Bearer "), F.col("token")),
        F.lit("X-Api-Authorization-Key"), F.col("token"),
        F.lit("Content-Type"), F.lit("application/json")).alias("headers"))
    m = h.select("doc_id", "pos", V.mask_headers(F.col("headers")).alias("m"))
    return m.select("doc_id", "pos", F.col("m")["Authorization"].alias("authorization"),
                    F.col("m")["X-Api-Authorization-Key"].alias("api_key"),
                    F.col("m")["Content-Type"].alias("content_type"))


def truncate_docs(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "text")
    tr = V.truncate_text(F.col("text"), 4000)
    return d.select("doc_id", F.char_length(tr).alias("n_chars"), F.md5(tr).alias("md5"))


def retrieve_then_score(spark, sf_dir):
    """V7: each benchmark prompt retrieves its top-1 document (J1), runs the
    cascade with no model output (fallback plan from the snippet), validates
    the result (V1) and rolls up (A3)."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    qs = t(spark, sf_dir, "benchmark").select("item_id", "text")
    top = knn(qs.select("item_id", hash_embed(F.col("text")).alias("embedding")),
              docs.select("doc_id", hash_embed(F.col("text")).alias("embedding")), 1,
              query_key="item_id", corpus_key="doc_id")
    j = top.join(docs, "doc_id").join(qs.withColumnRenamed("text", "prompt"), "item_id")
    j = j.select("item_id", F.array(F.col("text")).alias("snippets"), F.col("prompt"))
    r = V.resolve_cascade(j, None, None, "snippets", "prompt")
    r = V.plan_fields(V.validate_contract(r, "plan"), "plan")
    a = V.obedience_rollup(r)
    # which document each prompt retrieved, as one number
    pairs = top.select(F.sum((F.col("item_id") + 1) * (F.col("doc_id") + 1)).cast("bigint")).scalar()
    return a.select("total", "valid_count", F.round("valid_rate", 6).alias("valid_rate"),
                    "extra_field_count", F.round("avg_confidence", 6).alias("avg_confidence"), pairs.alias("retrieved"))


# ------------------------------------------------------------------ oracle SQL
def _sql_plan(n: str) -> str:
    steps = """'[{"step_label":"s1","api_call":"append_log","args":{"turn":' || turn || '},"expected_state":{}}]'"""
    head = """'{"intent":"' || role || '","slots":{"turn":' || turn || '},"steps":'"""
    src = """',"sources":["conv-' || conv_id || '"]'"""
    conf = """',"confidence":0.' || (turn % 10)"""
    base = f"({head} || {steps} || {src} || {conf} || '}}')"
    return f"""CASE WHEN {n} = 1 THEN {head} || {steps} || {src} || '}}'
  WHEN {n} = 2 THEN {head} || {steps} || {src} || {conf} || ',"note":"extra"}}'
  WHEN {n} = 3 THEN {head} || '[]' || {src} || {conf} || '}}'
  WHEN {n} = 4 THEN {head} || {steps} || {src} || ',"confidence":1.5}}'
  WHEN {n} = 5 THEN 'Sure, here is the plan: ' || {base} || ' Hope this helps.'
  WHEN {n} = 6 THEN substr({base}, 1, CAST(trunc(length({base}) / 2) AS INTEGER))
  ELSE {base} END"""


_SQL_TEXTS = f"""texts AS (
  SELECT conv_id, turn, role, text,
         {_sql_plan('((conv_id * 1000 + turn) % 7)')} AS plan_text,
         {_sql_plan('((conv_id * 1000 + turn + 3) % 7)')} AS alt_text
  FROM conversations)"""


def _sql_frag(x: str) -> str:
    """DuckDB form of P2 (JSON or NULL)."""
    tr = f"trim({x}, ' \t\n\r')"
    fr = f"regexp_extract({tr}, '(?s)\\{{.*\\}}', 0)"
    return (f"CASE WHEN {tr} <> '' AND json_valid({tr}) THEN {tr}::JSON "
            f"WHEN {fr} <> '' AND json_valid({fr}) THEN {fr}::JSON END")


def _sql_isnum(tp: str) -> str:
    return f"coalesce({tp} IN ('BIGINT', 'UBIGINT', 'DOUBLE'), false)"


def _sql_nerr(j: str) -> str:
    """DuckDB count of V1 violations for JSON value ``j``."""
    keys = f"json_keys({j})"
    req = "['intent', 'slots', 'steps', 'sources', 'confidence']"
    stepk = "['step_label', 'api_call', 'args', 'expected_state']"
    ty = lambda p: f"json_type({j}, '{p}')"
    step = (f"CASE WHEN json_type(e) <> 'OBJECT' THEN 1 ELSE "
            f"len(list_filter({stepk}, lambda k: NOT list_contains(json_keys(e), k))) + "
            f"(len(list_filter(json_keys(e), lambda k: NOT list_contains({stepk}, k))) > 0)::INT + "
            f"(json_type(e, '$.step_label') IS NOT NULL AND json_type(e, '$.step_label') <> 'VARCHAR')::INT + "
            f"(json_type(e, '$.api_call') IS NOT NULL AND json_type(e, '$.api_call') <> 'VARCHAR')::INT + "
            f"(json_type(e, '$.args') IS NOT NULL AND json_type(e, '$.args') <> 'OBJECT')::INT + "
            f"(json_type(e, '$.expected_state') IS NOT NULL AND json_type(e, '$.expected_state') <> 'OBJECT')::INT END")
    steps_sum = (f"CASE WHEN {ty('$.steps')} = 'ARRAY' THEN coalesce(list_sum(list_transform("
                 f"json_extract({j}, '$.steps[*]'), lambda e: {step})), 0) ELSE 0 END")
    src_sum = (f"CASE WHEN {ty('$.sources')} = 'ARRAY' THEN len(list_filter(json_extract({j}, '$.sources[*]'), "
               f"lambda e: json_type(e) <> 'VARCHAR')) ELSE 0 END")
    conf = f"json_extract({j}, '$.confidence')::DOUBLE"
    return f"""(CASE WHEN {j} IS NULL OR json_type({j}) <> 'OBJECT' THEN 1 ELSE
  len(list_filter({req}, lambda k: NOT list_contains({keys}, k)))
  + (len(list_filter({keys}, lambda k: NOT list_contains({req}, k))) > 0)::INT
  + ({ty('$.intent')} IS NOT NULL AND {ty('$.intent')} <> 'VARCHAR')::INT
  + ({ty('$.slots')} IS NOT NULL AND {ty('$.slots')} <> 'OBJECT')::INT
  + ({ty('$.steps')} IS NOT NULL AND {ty('$.steps')} <> 'ARRAY')::INT
  + ({ty('$.steps')} = 'ARRAY' AND json_array_length({j}, '$.steps') = 0)::INT
  + ({ty('$.sources')} IS NOT NULL AND {ty('$.sources')} <> 'ARRAY')::INT
  + ({ty('$.confidence')} IS NOT NULL AND NOT {_sql_isnum(ty('$.confidence'))})::INT
  + coalesce({_sql_isnum(ty('$.confidence'))} AND {conf} < 0, false)::INT
  + coalesce({_sql_isnum(ty('$.confidence'))} AND {conf} > 1, false)::INT
  + {steps_sum} + {src_sum} END)"""


def _sql_extra(j: str) -> str:
    return (f"CASE WHEN {j} IS NULL OR json_type({j}) <> 'OBJECT' THEN 0 ELSE len(list_filter(json_keys({j}), "
            f"lambda k: NOT list_contains(['intent', 'slots', 'steps', 'sources', 'confidence'], k))) END")


SQL_VALIDATE = f"""WITH {_SQL_TEXTS},
p AS (SELECT conv_id, turn, {_sql_frag('plan_text')} AS j FROM texts)
SELECT conv_id, turn, j IS NOT NULL AS parsed, {_sql_nerr('j')} = 0 AS valid,
       CAST({_sql_nerr('j')} AS INTEGER) AS n_errors, CAST({_sql_extra('j')} AS INTEGER) AS extra_fields,
       CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'intent,slots,steps,sources,confidence'
            ELSE array_to_string(list_filter(['intent', 'slots', 'steps', 'sources', 'confidence'],
                                             lambda k: NOT list_contains(json_keys(j), k)), ',') END AS missing,
       CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN ''
            ELSE array_to_string(list_sort(list_filter(json_keys(j), lambda k: NOT list_contains(
                 ['intent', 'slots', 'steps', 'sources', 'confidence'], k))), ',') END AS unexpected
FROM p"""

_SQL_CASCADE = f"""{_SQL_TEXTS},
p AS (
  SELECT conv_id, turn, role,
         CASE WHEN role = 'user' THEN {_sql_frag('plan_text')} END AS rv,
         {_sql_frag('alt_text')} AS lv,
         'conv ' || conv_id || ' turn ' || turn AS query
  FROM texts),
q AS (
  SELECT *, coalesce(rv IS NOT NULL AND json_type(rv) = 'OBJECT' AND len(json_keys(rv)) > 0
                     AND {_sql_nerr('rv')} = 0, false) AS r_ok FROM p),
m AS (
  SELECT *, CASE WHEN r_ok THEN 'remote' WHEN lv IS NOT NULL THEN 'local' END AS src,
         CASE WHEN r_ok THEN rv ELSE lv END AS mv FROM q),
c AS (
  SELECT *, CASE WHEN src IS NOT NULL AND {_sql_nerr('mv')} = 0
                      AND coalesce(json_extract(mv, '$.confidence')::DOUBLE, 0.0) >= 0.5
                 THEN src WHEN turn % 5 = 4 THEN 'failure' ELSE 'fallback' END AS chosen_by FROM m)"""

#: Confidence, validity and extra fields of the chosen plan: the failure record is invalid by its empty steps and its error key.
SQL_CHOSEN = """CASE chosen_by WHEN 'fallback' THEN 0.4 WHEN 'failure' THEN 0.0 ELSE json_extract(mv, '$.confidence')::DOUBLE END AS conf,
  chosen_by <> 'failure' AS valid, CAST(CASE WHEN chosen_by = 'failure' THEN 1 ELSE 0 END AS INTEGER) AS extra"""

SQL_CASCADE = f"""WITH {_SQL_CASCADE},
r AS (SELECT *, {SQL_CHOSEN} FROM c)
SELECT conv_id, turn, role, chosen_by,
       CASE WHEN chosen_by IN ('fallback', 'failure') THEN query ELSE json_extract_string(mv, '$.intent') END AS intent,
       round(conf, 6) AS confidence,
       CAST(CASE chosen_by WHEN 'fallback' THEN 1 WHEN 'failure' THEN 0 ELSE json_array_length(mv, '$.steps') END AS INTEGER) AS n_steps,
       valid, extra AS extra_fields
FROM r"""

SQL_ROLLUP = f"""WITH {_SQL_CASCADE},
r AS (SELECT role, {SQL_CHOSEN} FROM c)
SELECT role, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE valid) AS BIGINT) AS valid_count,
       round(avg(CASE WHEN valid THEN 1.0::DOUBLE ELSE 0 END), 6) AS valid_rate,
       CAST(sum(extra) AS BIGINT) AS extra_field_count, round(avg(conf), 6) AS avg_confidence
FROM r GROUP BY role"""

SQL_NORMALIZED = f"""WITH {_SQL_TEXTS},
p AS (SELECT conv_id, turn, CASE WHEN json_valid(alt_text) THEN alt_text::JSON END AS j FROM texts),
s AS (
  SELECT conv_id, turn,
         CASE WHEN j IS NOT NULL AND json_type(j) = 'OBJECT' AND json_type(j, '$.steps') = 'ARRAY'
              THEN list_filter(json_extract(j, '$.steps[*]'), lambda e: json_type(e) = 'OBJECT') ELSE [] END AS st
  FROM p)
SELECT conv_id, turn, CAST(len(st) AS INTEGER) AS n_steps,
       array_to_string(list_transform(st, lambda e: json_extract_string(e, '$.step_label')), ',') AS labels
FROM s"""

_SQL_TOKENS = """toks AS (
  SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS INTEGER) AS pos, unnest(m) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1) AS m FROM documents))"""


def _sql_mask(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' WHEN length({x}) <= 8 THEN '***' "
            f"ELSE left({x}, 4) || '***' || right({x}, 2) END")


SQL_MASK_TOKENS = f"""WITH {_SQL_TOKENS}
SELECT doc_id, pos, {_sql_mask('token')} AS masked, {_sql_mask('left(token, 6)')} AS masked_short FROM toks"""

SQL_MASK_HEADERS = f"""WITH {_SQL_TOKENS}
SELECT doc_id, pos, 'Bearer ' || {_sql_mask('token')} AS authorization,
       'Bearer ' || {_sql_mask('token')} AS api_key, 'application/json' AS content_type FROM toks"""

SQL_TRUNCATE = """
SELECT doc_id, CAST(length(tr) AS INTEGER) AS n_chars, md5(tr) AS md5
FROM (SELECT doc_id, CASE WHEN length(text) > 4000 THEN left(text, 4000) || '...(truncated)' ELSE text END AS tr
      FROM documents)"""

SQL_RETRIEVE_THEN_SCORE = f"""
WITH knn AS ({SQL_KNN_DOCUMENTS})
SELECT CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) AS BIGINT) AS valid_count, 1.0::DOUBLE AS valid_rate,
       CAST(0 AS BIGINT) AS extra_field_count, 0.4::DOUBLE AS avg_confidence,
       CAST(sum((item_id + 1) * (doc_id + 1)) AS BIGINT) AS retrieved
FROM knn WHERE rank = 1"""

QUERIES = {
    "val_validate_contract": (validate_plans, SQL_VALIDATE),
    "val_resolve_cascade": (cascade, SQL_CASCADE),
    "val_obedience_rollup": (rollup, SQL_ROLLUP),
    "val_normalize_steps": (normalized_steps, SQL_NORMALIZED),
    "val_mask_tokens": (mask_tokens, SQL_MASK_TOKENS),
    "val_mask_headers": (mask_headers, SQL_MASK_HEADERS),
    "val_truncate_text": (truncate_docs, SQL_TRUNCATE),
    "val_retrieve_then_score": (retrieve_then_score, SQL_RETRIEVE_THEN_SCORE),
}
