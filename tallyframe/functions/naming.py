"""Model-id parsing (P11) and source references (P27) as native expressions.

A model id ``org/name-part-part`` is split on ``-``; every part is tagged
(version, quant type, size label, finetune) by regular expressions, the
left-to-right basename rule runs as an ``aggregate`` fold and the trailing
version clean-up as a fold over the reversed parts. Everything stays in the
JVM; a table of ids parses in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import let

# Part patterns (full match, case-insensitive).
VERSION_RE = r"(?i)^(v|iter)?\d+([.]\d+)*$"
TYPE_RE = r"(?i)^(i?q\d(_\w)*|b?fp?(16|32))$"
SIZE_RE = r"(?i)^(([A]|\d+[x])?\d+([._]\d+)?[KMBT][\d]?|small|mini|medium|large|x?xl)$"
FINETUNE_RE = r"(?i)^(chat|instruct|vision|lora)$"
SIZE_UNITS = " KMBT"

_PART = "struct<p:string,v:boolean,ty:boolean,sz:boolean,ft:boolean,bn:boolean>"


def _n_tags(x: Column) -> Column:
    return sum(F.when(x[k], 1).otherwise(0) for k in ("v", "ty", "sz", "ft", "bn"))


def _size_text(p: Column) -> Column:
    """Normalise a size part: '_' -> '.', the 7b1 notation -> 7.1b, a
    lower-case unit after a digit upper-cased."""
    q = F.replace(p, F.lit("_"), F.lit("."))
    n = F.char_length(q)
    q = F.when(F.substring(q, -1, 1).rlike(r"^\d$"),
               F.concat(F.substring(q, F.lit(1), n - 2), F.lit("."), F.substring(q, -1, 1), F.substring(q, -2, 1))) \
        .otherwise(q)
    n = F.char_length(q)
    up = (n > 1) & F.substring(q, -2, 1).rlike(r"^\d$") & F.substring(q, -1, 1).isin("k", "m", "b", "t")
    return F.when(up, F.concat(F.substring(q, F.lit(1), n - 1), F.upper(F.substring(q, -1, 1)))).otherwise(q)


def _tag(p: Column, i: Column, total: Column) -> Column:
    """Tag one name part (position i, 0-based)."""
    is_v = p.rlike(VERSION_RE)
    is_ty = ~is_v & p.rlike(TYPE_RE)
    is_sz = ~is_v & ~is_ty & (i > 0) & p.rlike(SIZE_RE)
    is_ft_word = ~is_v & ~is_ty & ~is_sz & (i > 0) & p.rlike(FINETUNE_RE)
    lora_type = is_ft_word & (total < 0) & (F.lower(p) == "lora")

    def sized(q):
        unit = F.instr(F.lit(SIZE_UNITS), F.substring(q, -1, 1)) - 1
        label = F.substring(q, F.lit(1), F.char_length(q) - 1).try_cast("double") * F.pow(F.lit(1000.0), unit)
        ctx = label.isNotNull() & (total != 0) & (
            ((total < 0) & (label < F.floor(F.abs(total) / 8))) |
            ((total > 0) & (F.abs(label - total) > F.floor(total * 7 / 8))))
        ctx = F.coalesce(ctx, F.lit(False))
        text = F.when(ctx, F.concat(F.substring(q, F.lit(1), F.char_length(q) - 1), F.lower(F.substring(q, -1, 1)))).otherwise(q)
        return F.struct(text.alias("p"), F.lit(False).alias("v"), F.lit(False).alias("ty"), (~ctx).alias("sz"),
                        ctx.alias("ft"), F.lit(False).alias("bn"))

    plain = F.struct(F.when(is_ty, F.upper(p)).otherwise(p).alias("p"), is_v.alias("v"),
                     (is_ty | lora_type).alias("ty"), F.lit(False).alias("sz"),
                     (is_ft_word & ~lora_type).alias("ft"), F.lit(False).alias("bn"))
    return F.when(is_sz, let(_size_text(p), sized)).otherwise(plain)


def _with(x: Column, **kw) -> Column:
    fields = {k: x[k] for k in ("p", "v", "ty", "sz", "ft", "bn")}
    fields.update(kw)
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _components(parts: Column) -> Column:
    # word-only size labels are dropped when a numeric one exists
    has_num = F.exists(parts, lambda x: x["sz"] & x["p"].rlike(r"\d"))
    parts = F.transform(parts, lambda x: _with(x, sz=x["sz"] & ~(has_num & x["p"].rlike(r"^\p{L}+$"))))
    # basename: leading untagged alphabetic parts and versions
    init = F.struct(F.lit(True).alias("at_start"), F.array().cast(f"array<{_PART}>").alias("out"))

    def step(acc, x):
        start_ok = acc["at_start"] & (((_n_tags(x) == 0) & x["p"].rlike(r"^\p{L}")) | x["v"])
        nx = F.when(start_ok, _with(x, bn=F.lit(True))).otherwise(
            F.when(_n_tags(x) == 0, _with(x, ft=F.lit(True))).otherwise(x))
        return F.struct((acc["at_start"] & start_ok).alias("at_start"), F.concat(acc["out"], F.array(nx)).alias("out"))
    init2 = F.struct(F.lit(False).alias("stop"), F.array().cast(f"array<{_PART}>").alias("out"))

    # a trailing basename part that carries another tag loses the basename tag
    def back(acc, x):
        drop = ~acc["stop"] & x["bn"] & (_n_tags(x) > 1)
        nx = F.when(drop, _with(x, bn=F.lit(False))).otherwise(x)
        return F.struct((acc["stop"] | ~drop).alias("stop"), F.concat(acc["out"], F.array(nx)).alias("out"))

    def joined(final, pred, distinct=False):
        a = F.transform(F.filter(final, pred), lambda x: x["p"])
        if distinct:
            a = F.array_distinct(a)
        return F.nullif(F.array_join(a, "-"), F.lit(""))

    def result(final):
        raw = F.struct(joined(final, lambda x: x["bn"]).alias("basename"),
                       joined(final, lambda x: x["ft"]).alias("finetune"),
                       joined(final, lambda x: x["v"] & ~x["bn"]).alias("version"),
                       joined(final, lambda x: x["sz"], distinct=True).alias("size_label"))
        return let(raw, lambda r: F.struct(
            F.when(r["size_label"].isNull() & r["finetune"].isNull() & r["version"].isNull(),
                   F.lit(None).cast("string")).otherwise(r["basename"]).alias("basename"),
            r["finetune"].alias("finetune"), r["version"].alias("version"), r["size_label"].alias("size_label")))

    tagged = F.aggregate(parts, init, step)["out"]
    return let(F.reverse(F.aggregate(F.reverse(tagged), init2, back)["out"]), result)


def parse_artifact_name(model_id: Column, total_params: Column | None = None) -> Column:
    """``struct(full_name, org, basename, finetune, version,
    size_label)`` of a model id. A sentence (contains a space) is its own
    name with no components; ``org/`` prefixes starting with '.' are not
    organisations; ambiguous names give a null basename."""
    total = total_params if total_params is not None else F.lit(0).cast("bigint")
    has_org = model_id.contains("/")
    org = F.when(has_org, F.substring_index(model_id, "/", 1))
    org = F.when(org.isNotNull() & (F.char_length(org) > 0) & org.startswith("."), F.lit(None)).otherwise(org)
    full = F.when(has_org, F.substring(model_id, F.instr(model_id, "/") + 1, F.char_length(model_id))).otherwise(model_id)

    def parse(m):
        parts = F.filter(F.split(m["full"], "-"), lambda p: p != "")
        tagged = F.transform(parts, lambda p, i: _tag(p, i, total.cast("double")))
        return let(_components(tagged), lambda c: F.struct(
            m["full"].alias("full_name"), m["org"].alias("org"), c["basename"].alias("basename"),
            c["finetune"].alias("finetune"), c["version"].alias("version"), c["size_label"].alias("size_label")))
    nulls = [F.lit(None).cast("string").alias(k) for k in ("org", "basename", "finetune", "version", "size_label")]
    return F.when(model_id.isNull(), F.lit(None)).when(
        model_id.contains(" "), F.struct(model_id.alias("full_name"), *nulls)
    ).otherwise(let(F.struct(full.alias("full"), org.alias("org")), parse))


# URL schemes kept as repository links, and the hub id form.
URL_PREFIXES = ("http://", "https://", "ssh://")
HUB_ID_RE = r"^https?://huggingface\.co/([^/]+/[^/]+)$"
HUB_URL = "https://huggingface.co/"


def _ref_from_text(s: Column, total: Column) -> Column:
    from tallyframe.operators.catalog import title_case_id

    is_url = F.lit(False)
    for pre in URL_PREFIXES:
        is_url = is_url | s.startswith(pre)
    hub_id = F.regexp_extract(s, HUB_ID_RE, 1)

    own = F.when(~is_url, s).when(s.contains("huggingface.co") & (hub_id != ""), hub_id)

    def build(c):
        url = F.when(c["org"].isNotNull() & c["full_name"].isNotNull(), F.concat(F.lit(HUB_URL), c["org"], F.lit("/"), c["full_name"]))
        return F.struct(title_case_id(c["full_name"]).alias("name"), title_case_id(c["org"]).alias("organization"),
                        c["version"].alias("version"), F.when(is_url, s).otherwise(url).alias("repo_url"))
    return let(parse_artifact_name(own, total), build)


def source_refs(value: Column, total_params: Column | None = None) -> Column:
    """A model card's base-model / dataset value (VARIANT: a string or a
    list) -> ``array<struct<name, organization, version, repo_url>>``. URLs
    are kept as ``repo_url`` (hub URLs are also parsed), plain ids are parsed
    with P11 and titled with P12 and get a hub URL, objects keep their own
    fields, other entries become an empty record. Absent value -> null; a
    value that is neither a string nor a list -> an empty list."""
    total = total_params if total_params is not None else F.lit(0).cast("bigint")
    t = F.schema_of_variant(value)
    items = (F.when(t == "STRING", F.array(value))
             .when(t.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
             .when(value.isNotNull(), F.array().cast("array<variant>")))

    def one(x):
        xt = F.schema_of_variant(x)
        obj = F.struct(*[F.try_variant_get(x, f"$.{k}", "string").alias(k)
                         for k in ("name", "organization", "version", "repo_url")])
        return (F.when(xt == "STRING", _ref_from_text(F.try_variant_get(x, "$", "string"), total))
                .when(xt.startswith("OBJECT"), obj)
                .otherwise(F.struct(*[F.lit(None).cast("string").alias(k)
                                      for k in ("name", "organization", "version", "repo_url")])))
    return F.transform(items, one)
