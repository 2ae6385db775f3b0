"""Contract validation and decision flows (P2-P4, P6, P20-P22, U2, V1, V2, F8,
A3, V7). All checks are VARIANT/JSON expressions evaluated per row in the
JVM (the per-element checks are higher-order functions, which Spark
interprets rather than compiles); nothing is gathered per group.

Known parser gap (documented, not emulated): Spark's ``try_parse_json``
rejects duplicate keys and ``NaN``, which Python's ``json`` accepts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.util import let

# The plan contract (required root keys, step keys).
ROOT_KEYS = ("intent", "slots", "steps", "sources", "confidence")
STEP_KEYS = ("step_label", "api_call", "args", "expected_state")
# Fallback plan constants.
FALLBACK_CONFIDENCE = 0.4
FALLBACK_API = "append_log"
FALLBACK_STEP_LABEL = "log_fallback_intent"
LOW_CONFIDENCE = 0.5
FAILURE_ERROR = "VALIDATION_FAIL"
TRUNCATED_SUFFIX = "...(truncated)"
_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


# ---------------------------------------------------------------- scalars
def json_fragment(text: Column) -> Column:
    """VARIANT of the whole trimmed text, else of the span from the first
    ``{`` to the last ``}``, else null."""
    stripped = F.regexp_replace(text, r"^\s+|\s+$", "")
    whole = F.when(stripped != "", F.try_parse_json(stripped))
    frag = F.regexp_extract(stripped, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when(frag != "", F.try_parse_json(frag)))


def mask_secret(s: Column) -> Column:
    """P3: '' for empty/null; '***' up to 8 chars; else first 4 + '***' + last 2."""
    n = F.char_length(s)
    return (F.when(s.isNull() | (s == ""), F.lit(""))
            .when(n <= 8, F.lit("***"))
            .otherwise(F.concat(F.substring(s, 1, 4), F.lit("***"), F.substring(s, -2, 2))))


def mask_headers(headers: Column) -> Column:
    """Header map with values of keys containing 'authorization'
    (case-insensitive) replaced by 'Bearer ' + masked token (the text after
    the last 'Bearer', trimmed, when present)."""
    def mv(k, v):
        tok = F.when(v.contains("Bearer"), F.trim(F.element_at(F.split(v, "Bearer"), -1))).otherwise(v)
        return F.when(F.lower(k).contains("authorization"),
                      F.concat(F.lit("Bearer "), mask_secret(tok))).otherwise(v)
    return F.transform_values(headers, mv)


def truncate_text(s: Column, limit: int = 4000) -> Column:
    """Over ``limit`` characters -> prefix + '...(truncated)'."""
    return F.when(F.char_length(s) > limit,
                  F.concat(F.substring(s, 1, limit), F.lit(TRUNCATED_SUFFIX))).otherwise(s)


def fingerprint(v: Column) -> Column:
    """Sha-256 of the canonical (key-sorted) JSON of a VARIANT.

    Spark's VARIANT serialises object keys sorted, so equal documents give
    equal digests; the bytes differ from Python's ``json.dumps`` separators,
    so digests are stable within this library, not equal to the reference's."""
    return F.sha2(F.to_json(v), 256)


# ---------------------------------------------------------------- types
def vtype(v: Column, path: str | None = None) -> Column:
    """Variant type name (``OBJECT<..>``, ``ARRAY<..>``, ``STRING``, ``BIGINT``,
    ``DECIMAL(p,s)``, ``DOUBLE``, ``BOOLEAN``, ``VOID``) or null when absent."""
    x = v if path is None else F.try_variant_get(v, path, "variant")
    return F.schema_of_variant(x)


def is_object(t: Column) -> Column:
    return F.coalesce(t.startswith("OBJECT"), F.lit(False))


def is_array(t: Column) -> Column:
    return F.coalesce(t.startswith("ARRAY"), F.lit(False))


def is_string(t: Column) -> Column:
    return F.coalesce(t == "STRING", F.lit(False))


def is_number(t: Column) -> Column:
    return F.coalesce(t.isin(*_NUMERIC) | t.startswith("DECIMAL"), F.lit(False))


def object_keys(v: Column) -> Column:
    """Top-level keys of an object VARIANT (sorted), else null."""
    return F.when(is_object(vtype(v)), F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def unexpected_keys(v: Column, allowed=ROOT_KEYS) -> Column:
    """Keys not in the contract (sorted)."""
    return F.array_except(F.coalesce(object_keys(v), F.array().cast("array<string>")),
                          F.array(*[F.lit(k) for k in allowed]))


def missing_keys(v: Column, required=ROOT_KEYS) -> Column:
    """Required keys absent, in contract order."""
    keys = F.coalesce(object_keys(v), F.array().cast("array<string>"))
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: ~F.array_contains(keys, k))


def _err(cond: Column, msg: Column | str) -> Column:
    m = F.lit(msg) if isinstance(msg, str) else msg
    return F.when(cond, m)


def _step_errors(x: Column, i: Column) -> Column:
    """Errors of one step element (array<string>)."""
    facts = F.struct(
        vtype(x).alias("t"), F.coalesce(object_keys(x), F.array().cast("array<string>")).alias("keys"),
        vtype(x, "$.step_label").alias("label"), vtype(x, "$.api_call").alias("api"),
        vtype(x, "$.args").alias("args"), vtype(x, "$.expected_state").alias("exp"))

    def body(f):
        keys = f["keys"]
        pref = F.concat(F.lit("steps["), i.cast("string"), F.lit("]: "))
        missing = F.transform(
            F.filter(F.array(*[F.lit(k) for k in STEP_KEYS]), lambda k: ~F.array_contains(keys, k)),
            lambda k: F.concat(pref, F.lit("step missing "), k))
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in STEP_KEYS]))
        typed = F.array_compact(F.array(
            _err(F.array_contains(keys, "step_label") & ~is_string(f["label"]),
                 F.concat(pref, F.lit("step_label must be a string"))),
            _err(F.array_contains(keys, "api_call") & ~is_string(f["api"]),
                 F.concat(pref, F.lit("api_call must be a string"))),
            _err(F.array_contains(keys, "args") & ~is_object(f["args"]),
                 F.concat(pref, F.lit("args must be an object"))),
            _err(F.array_contains(keys, "expected_state") & ~is_object(f["exp"]),
                 F.concat(pref, F.lit("expected_state must be an object"))),
            _err(F.size(extra) > 0, F.concat(pref, F.lit("unexpected step fields: "), F.array_join(extra, ","))),
        ))
        return F.when(~is_object(f["t"]), F.array(F.concat(pref, F.lit("step is not an object")))) \
            .otherwise(F.concat(missing, typed))
    return let(facts, body)


def contract_errors(v: Column) -> Column:
    """V1 errors (array<string>): one entry per violation - missing keys,
    unexpected root keys (one entry listing them), wrong types, empty steps,
    per-step violations, non-string sources, confidence outside [0, 1].
    Every fact about the document is extracted once per row into one bound
    struct (the expression stays small and the document is read once)."""
    facts = F.struct(
        vtype(v).alias("t"), F.coalesce(object_keys(v), F.array().cast("array<string>")).alias("keys"),
        vtype(v, "$.intent").alias("ti"), vtype(v, "$.slots").alias("tsl"), vtype(v, "$.steps").alias("tst"),
        vtype(v, "$.sources").alias("tsr"), vtype(v, "$.confidence").alias("tc"),
        F.try_variant_get(v, "$.steps", "array<variant>").alias("steps"),
        F.try_variant_get(v, "$.sources", "array<variant>").alias("sources"),
        F.try_variant_get(v, "$.confidence", "double").alias("conf"))
    return let(facts, _contract_errors)


def _contract_errors(f: Column) -> Column:
    keys = f["keys"]
    miss = F.transform(F.filter(F.array(*[F.lit(k) for k in ROOT_KEYS]), lambda k: ~F.array_contains(keys, k)),
                       lambda k: F.concat(F.lit("missing required field: "), k))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in ROOT_KEYS]))
    t_int, t_slots, t_steps, t_src, t_conf = f["ti"], f["tsl"], f["tst"], f["tsr"], f["tc"]
    steps, sources, conf = f["steps"], f["sources"], f["conf"]
    root = F.array_compact(F.array(
        _err(F.size(extra) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(extra, ","))),
        _err(t_int.isNotNull() & ~is_string(t_int), "intent must be a string"),
        _err(t_slots.isNotNull() & ~is_object(t_slots), "slots must be an object"),
        _err(t_steps.isNotNull() & ~is_array(t_steps), "steps must be an array"),
        _err(is_array(t_steps) & (F.size(steps) == 0), "steps must be non-empty"),
        _err(t_src.isNotNull() & ~is_array(t_src), "sources must be an array"),
        _err(t_conf.isNotNull() & ~is_number(t_conf), "confidence must be a number"),
        _err(is_number(t_conf) & (conf < 0), "confidence below minimum 0"),
        _err(is_number(t_conf) & (conf > 1), "confidence above maximum 1"),
    ))
    step_errs = F.flatten(F.coalesce(F.transform(steps, _step_errors), F.array().cast("array<array<string>>")))
    src_errs = F.coalesce(F.transform(
        F.filter(F.transform(sources, lambda x, i: F.struct(vtype(x).alias("t"), i.alias("i"))),
                 lambda s: ~is_string(s["t"])),
        lambda s: F.concat(F.lit("sources["), s["i"].cast("string"), F.lit("] must be a string"))),
        F.array().cast("array<string>"))
    return F.when(~is_object(f["t"]), F.array(F.lit("not a JSON object"))).otherwise(
        F.concat(miss, root, step_errs, src_errs))


def validate_contract(df: DataFrame, plan: str, prefix: str = "") -> DataFrame:
    """V1: add ``valid``, ``errors`` and ``extra_fields`` (count of unexpected
    root keys) for the VARIANT column ``plan``."""
    v = F.col(plan)
    out = df.withColumn(f"{prefix}errors", contract_errors(v))
    return (out.withColumn(f"{prefix}valid", F.size(f"{prefix}errors") == 0)
            .withColumn(f"{prefix}extra_fields", F.size(unexpected_keys(v)).cast("int")))


def minimal_ok(v: Column) -> Column:
    """F8: boolean form of V1."""
    return F.size(contract_errors(v)) == 0


# ---------------------------------------------------------------- fallback
def normalize_steps(snippet: Column) -> Column:
    """P20: steps of a JSON snippet object (array<string> of step JSON);
    non-object steps are dropped but keep their numbering for the default
    label; absent fields default to ``fallback_step_{i+1}``, ``append_log``,
    ``{}``, ``{}``. Not an object / no list -> empty array."""
    v = F.try_parse_json(snippet)
    steps = F.when(is_object(vtype(v)), F.try_variant_get(v, "$.steps", "array<variant>"))

    def norm(x, i):
        keys = F.coalesce(object_keys(x), F.array().cast("array<string>"))

        def field(k, default_json):
            return F.when(F.array_contains(keys, k),
                          F.to_json(F.array(F.try_variant_get(x, f"$.{k}", "variant"))))\
                .otherwise(F.concat(F.lit("["), default_json, F.lit("]")))
        # each field as a one-element JSON array, so JSON null survives
        lab = field("step_label", F.concat(F.lit('"fallback_step_'), (i + 1).cast("string"), F.lit('"')))
        api = field("api_call", F.lit(f'"{FALLBACK_API}"'))
        args = field("args", F.lit("{}"))
        exp = field("expected_state", F.lit("{}"))
        strip = lambda a: F.regexp_replace(a, r"^\[|\]$", "")
        js = F.concat(F.lit('{"step_label":'), strip(lab), F.lit(',"api_call":'), strip(api),
                      F.lit(',"args":'), strip(args), F.lit(',"expected_state":'), strip(exp), F.lit("}"))
        return F.struct(is_object(vtype(x)).alias("ok"), js.alias("js"))
    normed = F.transform(steps, norm)
    return F.coalesce(F.transform(F.filter(normed, lambda s: s["ok"]), lambda s: s["js"]),
                      F.array().cast("array<string>"))


def fallback_plan(snippets: Column, query: Column, logs: Column | None = None) -> Column:
    """VARIANT fallback plan - steps from the top snippet, else one
    ``append_log`` step whose expected logs are ``logs + [query]``;
    confidence 0.4; sources = snippets."""
    logs = logs if logs is not None else F.array().cast("array<string>")
    top = F.element_at(snippets, 1)
    snip_steps = F.when(F.size(snippets) > 0, normalize_steps(top)).otherwise(F.array().cast("array<string>"))
    default_step = F.to_json(F.struct(
        F.lit(FALLBACK_STEP_LABEL).alias("step_label"), F.lit(FALLBACK_API).alias("api_call"),
        F.struct(query.alias("message")).alias("args"),
        F.struct(F.concat(logs, F.array(query)).alias("logs")).alias("expected_state")))
    steps_json = F.when(F.size(snip_steps) > 0, F.concat(F.lit("["), F.array_join(snip_steps, ","), F.lit("]")))\
        .otherwise(F.concat(F.lit("["), default_step, F.lit("]")))
    head = F.to_json(F.struct(query.alias("intent"), F.create_map().cast("map<string,string>").alias("slots")))
    tail = F.to_json(F.struct(snippets.alias("sources"), F.lit(FALLBACK_CONFIDENCE).alias("confidence")))
    js = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"steps":'), steps_json, F.lit(","),
                  F.regexp_replace(tail, r"^\{", ""))
    return F.try_parse_json(js)


def failure_plan(query: Column) -> Column:
    """Failure record (itself invalid under the contract: empty steps and an
    extra ``error`` key)."""
    return F.try_parse_json(F.to_json(F.struct(
        query.alias("intent"), F.create_map().cast("map<string,string>").alias("slots"),
        F.array().cast("array<string>").alias("steps"), F.array().cast("array<string>").alias("sources"),
        F.lit(0.0).alias("confidence"), F.lit(FAILURE_ERROR).alias("error"))))


def context_json(snippets: Column, state: Column, query: Column) -> Column:
    """One JSON context document per query."""
    return F.to_json(F.struct(query.alias("user_query"), snippets.alias("retrieval_snippets"),
                              state.alias("state_snapshot")))


def _confidence(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0))


def resolve_cascade(df: DataFrame, remote: str | None, local: str | None, snippets: str,
                    query: str, logs: str | None = None) -> DataFrame:
    """V2: remote (empty or invalid counts as absent) -> local -> fallback.

    An invalid chosen plan falls back; a fallback that is itself invalid
    gives the failure record; a valid non-fallback plan with confidence < 0.5
    is replaced by the fallback (checked again). Adds ``plan`` (VARIANT) and
    ``chosen_by`` in {remote, local, fallback, failure}."""
    rv = json_fragment(F.col(remote)) if remote else F.lit(None).cast("variant")
    lv = json_fragment(F.col(local)) if local else F.lit(None).cast("variant")
    fb = fallback_plan(F.col(snippets), F.col(query), F.col(logs) if logs else None)
    fail = failure_plan(F.col(query))
    d = df.withColumn("__rv", rv).withColumn("__lv", lv).withColumn("__fb", fb)
    r_obj_nonempty = is_object(vtype(F.col("__rv"))) & (F.size(object_keys(F.col("__rv"))) > 0)
    r_ok = r_obj_nonempty & minimal_ok(F.col("__rv"))
    fb_ok = minimal_ok(F.col("__fb"))
    # model plan: remote when it passed its own check, else local parse
    d = d.withColumn("__src", F.when(r_ok, F.lit("remote"))
                     .when(F.col("__lv").isNotNull(), F.lit("local")).otherwise(F.lit(None)))
    d = d.withColumn("__mv", F.when(r_ok, F.col("__rv")).otherwise(F.col("__lv")))
    m_ok = minimal_ok(F.col("__mv"))
    use_fb = F.col("__src").isNull() | ~m_ok | (_confidence(F.col("__mv")) < LOW_CONFIDENCE)
    chosen = F.when(~use_fb, F.col("__src")).when(fb_ok, F.lit("fallback")).otherwise(F.lit("failure"))
    d = d.withColumn("chosen_by", chosen)
    plan = (F.when(F.col("chosen_by") == "fallback", F.col("__fb"))
            .when(F.col("chosen_by") == "failure", fail).otherwise(F.col("__mv")))
    return d.withColumn("plan", plan).drop("__rv", "__lv", "__fb", "__src", "__mv")


def obedience_rollup(results: DataFrame, valid: str = "valid", extra: str = "extra_fields",
                     confidence: str = "confidence", keys: list[str] | None = None) -> DataFrame:
    """A3: total, valid count, valid rate (0 when empty), extra-field total and
    mean confidence (missing counts as 0); partial+final aggregation."""
    g = results.groupBy(*(keys or []))
    total = F.count(F.lit(1))
    return g.agg(
        total.cast("bigint").alias("total"),
        F.sum(F.when(F.col(valid), 1).otherwise(0)).cast("bigint").alias("valid_count"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col(valid), 1).otherwise(0)).cast("double"), total.cast("double")),
                   F.lit(0.0)).alias("valid_rate"),
        F.coalesce(F.sum(F.col(extra)), F.lit(0)).cast("bigint").alias("extra_field_count"),
        F.coalesce(F.try_divide(F.sum(F.coalesce(F.col(confidence), F.lit(0.0))), total.cast("double")),
                   F.lit(0.0)).alias("avg_confidence"))


def plan_fields(df: DataFrame, plan: str = "plan") -> DataFrame:
    """Typed view of the chosen plan (intent, confidence, step count)."""
    v = F.col(plan)
    return (df.withColumn("intent", F.try_variant_get(v, "$.intent", "string"))
            .withColumn("confidence", _confidence(v))
            .withColumn("n_steps", F.coalesce(F.size(F.try_variant_get(v, "$.steps", "array<variant>")), F.lit(0))))
