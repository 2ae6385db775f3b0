"""Tensor-catalog operators over ``(model, pos, name, dtype, shape)`` rows
(P5, P8-P10, P12-P19, P25, P28, F4, J3-J5, J13, J16, J20, U1, A6-A8, A10,
A12-A14, A16, W3-W5, W8).

Only catalog metadata is processed here; tensor bytes are touched by the
vector codecs (``tallyframe.operators.vectors``).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.pyformat import py_fixed, py_fixed_dynamic
from tallyframe.functions.util import let, running_agg
from tallyframe.session import materialize

# Tensor element types (name, code, elements per block, bytes per block).
QUANT_TYPES = [
    ("F32", 0, 1, 4), ("F16", 1, 1, 2), ("Q4_0", 2, 32, 18), ("Q4_1", 3, 32, 20),
    ("Q5_0", 6, 32, 22), ("Q5_1", 7, 32, 24), ("Q8_0", 8, 32, 34), ("Q8_1", 9, 32, 40),
    ("Q2_K", 10, 256, 84), ("Q3_K", 11, 256, 110), ("Q4_K", 12, 256, 144), ("Q5_K", 13, 256, 176),
    ("Q6_K", 14, 256, 210), ("Q8_K", 15, 256, 292), ("IQ2_XXS", 16, 256, 66), ("IQ2_XS", 17, 256, 74),
    ("IQ3_XXS", 18, 256, 98), ("IQ1_S", 19, 256, 50), ("IQ4_NL", 20, 32, 18), ("IQ3_S", 21, 256, 110),
    ("IQ2_S", 22, 256, 82), ("IQ4_XS", 23, 256, 136), ("I8", 24, 1, 1), ("I16", 25, 1, 2),
    ("I32", 26, 1, 4), ("I64", 27, 1, 8), ("F64", 28, 1, 8), ("IQ1_M", 29, 256, 56),
    ("BF16", 30, 1, 2), ("TQ1_0", 34, 256, 54), ("TQ2_0", 35, 256, 66), ("MXFP4", 39, 32, 17),
]

# Tensor-name words and their expansions (report headings).
ABBREVIATIONS = {
    "token_embd": "Token embedding",
    "pos_embd": "Position embedding",
    "output_norm": "Output normalization",
    "output": "Output",
    "attn_norm": "Attention normalization",
    "attn_norm_2": "Attention normalization",
    "attn_qkv": "Attention query-key-value",
    "attn_q": "Attention query",
    "attn_k": "Attention key",
    "attn_v": "Attention value",
    "attn_output": "Attention output",
    "ffn_norm": "Feed-forward network normalization",
    "ffn_up": 'Feed-forward network "up"',
    "ffn_gate": 'Feed-forward network "gate"',
    "ffn_down": 'Feed-forward network "down"',
    "ffn_gate_inp": "Expert-routing layer for the Feed-forward network in Mixture of Expert models",
    "ffn_gate_exp": 'Feed-forward network "gate" layer per expert in Mixture of Expert models',
    "ffn_down_exp": 'Feed-forward network "down" layer per expert in Mixture of Expert models',
    "ffn_up_exp": 'Feed-forward network "up" layer per expert in Mixture of Expert models',
    "ssm_in": "State space model input projections",
    "ssm_conv1d": "State space model rolling/shift",
    "ssm_x": "State space model selective parametrization",
    "ssm_a": "State space model state compression",
    "ssm_d": "State space model skip connection",
    "ssm_dt": "State space model time step",
    "ssm_out": "State space model output projection",
    "blk": "Block",
    "enc": "Encoder",
    "dec": "Decoder",
}

# Names skipped by conversion and hashing.
SKIP_SUFFIXES = (".attention.masked_bias", ".attention.bias", ".rotary_emb.inv_freq")
# Suffixes tried when a name has no exact mapping.
MAP_TRY_SUFFIXES = (".weight", ".bias")
# Tensor roles always stored as F32, and embedding/output roles
# stored as F16 under the ternary file types.
F32_ROLES = ("blk.{bid}.ffn_gate_inp", "position_embd", "token_types", "blk.{bid}.ssm_conv1d",
             "blk.{bid}.shortconv.conv", "blk.{bid}.time_mix_first", "blk.{bid}.time_mix_w1",
             "blk.{bid}.time_mix_w2", "blk.{bid}.time_mix_decay_w1", "blk.{bid}.time_mix_decay_w2",
             "blk.{bid}.time_mix_lerp_fused", "posnet.{bid}.norm1", "posnet.{bid}.norm2",
             "v.position_embd", "a.position_embd", "blk.{bid}.altup_correct_coef",
             "blk.{bid}.altup_predict_coef")
EMBED_ROLES = ("token_embd", "per_layer_token_embd", "output", "blk.{bid}.altup_router",
               "blk.{bid}.laurel_l", "blk.{bid}.laurel_r")
QUANTIZABLE_SUFFIXES = (".weight", ".lora_a", ".lora_b")
TERNARY_TYPES = ("TQ1_0", "TQ2_0")
DATA_ALIGNMENT = 32


# ----------------------------------------------------------- type table
def type_table(spark) -> DataFrame:
    """The 32-row element-type table (a fixed-size dimension; broadcastable)."""
    return spark.createDataFrame(QUANT_TYPES, "dtype string, code int, block_size int, type_size int")


def _type_map(idx: int) -> Column:
    return F.create_map(*[x for t in QUANT_TYPES for x in (F.lit(t[0]), F.lit(t[idx]))])


def block_size(dtype: Column) -> Column:
    return _type_map(2)[dtype]


def type_size(dtype: Column) -> Column:
    return _type_map(3)[dtype]


# ----------------------------------------------------------- scalars
def whole_div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers in integer arithmetic (exact above 2^53)."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def n_elements(shape: Column) -> Column:
    """Product of dims (1 for a scalar shape)."""
    return F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, x: a * x.cast("bigint"))


def n_bytes(shape: Column, dtype: Column) -> Column:
    """Elements * type size // block size; null (invalid) when the last
    dim is not a multiple of the block size."""
    last = F.element_at(shape, -1).cast("bigint")
    ok = (last % block_size(dtype)) == 0
    return F.when(ok, whole_div(n_elements(shape) * type_size(dtype), block_size(dtype)))


def pad_to(n: Column, align: int = DATA_ALIGNMENT) -> Column:
    """Round up to a multiple of the alignment."""
    return whole_div(n + (align - 1), F.lit(align)) * align


def disk_dims(shape: Column) -> Column:
    """Dims as stored on disk (reversed)."""
    return F.reverse(shape)


def fixed_decimals(x: Column, digits: int | Column, max_digits: int = 3) -> Column:
    """Python-style ``f"{x:.{d}f}"`` text (see ``functions.pyformat``)."""
    if isinstance(digits, int):
        return py_fixed(x, digits)
    return py_fixed_dynamic(x, digits, max_digits)


def human_bytes(n: Column) -> Column:
    """Decimal units B/K/M/G with one decimal; 0 -> 'negligible - metadata
    only'; >= 1000 G -> T with a split recommendation."""
    def fmt(f):
        a = F.abs(f)
        scaled = (F.when(a < 1e3, f).when(a < 1e6, f / 1e3).when(a < 1e9, f / 1e6)
                  .when(a < 1e12, f / 1e9).otherwise(f / 1e12))
        unit = (F.when(a < 1e3, "").when(a < 1e6, "K").when(a < 1e9, "M").when(a < 1e12, "G")
                .otherwise("T - over 1TB, split recommended"))
        return F.when(f == 0, F.lit("negligible - metadata only")).otherwise(
            F.concat(fixed_decimals(scaled, 1), unit))
    return let(n.cast("double"), fmt)


def parse_size(s: Column, strict: bool = False) -> Column:
    """P9: '300M' -> 300 * 1000^2 (K/M/G are powers of 1000, plain digits are
    bytes); anything else -> null, or a task error when ``strict``."""
    m = F.regexp_extract(s, r"^([0-9]+)([KMG]?)$", 1)
    u = F.regexp_extract(s, r"^([0-9]+)([KMG]?)$", 2)
    mult = F.when(u == "K", 1000).when(u == "M", 1000 ** 2).when(u == "G", 1000 ** 3).otherwise(1)
    v = F.when(m != "", m.try_cast("bigint") * mult)
    if strict:
        return F.when(v.isNull(), F.raise_error(F.concat(F.lit("Invalid size: "), s))).otherwise(v)
    return v


def count_label(n: Column, min_digits: int = 2) -> Column:
    """P10: parameter-count label - T/B/M/K scaling (strict ``>``), with enough
    decimals for ``min_digits`` significant digits."""
    def fmt(x):
        scaled = (F.when(x > 1e12, x * 1e-12).when(x > 1e9, x * 1e-9).when(x > 1e6, x * 1e-6).otherwise(x * 1e-3))
        suffix = F.when(x > 1e12, "T").when(x > 1e9, "B").when(x > 1e6, "M").otherwise("K")

        def body(sc):
            int_digits = F.char_length(F.ltrim(F.bround(sc, 0).cast("bigint").cast("string"), F.lit("0")))
            fix = F.greatest(F.lit(min_digits) - int_digits, F.lit(0))
            return F.concat(fixed_decimals(sc, fix), suffix)
        return let(scaled, body)
    return let(n.cast("double"), fmt)


def size_label(total: Column, shared: Column, expert: Column, expert_count: Column) -> Column:
    """P10: ``{experts}x{label}`` for expert models, else the total's label."""
    return F.when(expert_count > 0, F.concat(expert_count.cast("string"), F.lit("x"),
                                              count_label(F.abs(shared) + F.abs(expert))))\
        .otherwise(count_label(F.abs(total)))


def element_count_label(n: Column) -> Column:
    """P10 report form: ``~`` + rounded scaled count (Q/T/B/M/K) above 1e3."""
    x = n.cast("double")
    scaled = (F.when(x > 1e15, x * 1e-15).when(x > 1e12, x * 1e-12).when(x > 1e9, x * 1e-9)
              .when(x > 1e6, x * 1e-6).when(x > 1e3, x * 1e-3).otherwise(x))
    suffix = (F.when(x > 1e15, "Q").when(x > 1e12, "T").when(x > 1e9, "B").when(x > 1e6, "M")
              .when(x > 1e3, "K").otherwise(""))
    return F.concat(F.when(x > 1e3, "~").otherwise(""), F.bround(scaled, 0).cast("bigint").cast("string"), suffix)


def title_case_id(s: Column) -> Column:
    """P12: '-' -> ' ', whitespace-split; words that are lower-case (have a
    cased letter, none upper) and are neither versions nor digit-first are
    title-cased the way Python's ``str.title`` does."""
    words = F.split(F.trim(F.replace(s, F.lit("-"), F.lit(" "))), r"\s+")
    fixed = F.transform(words, lambda w: F.when(
        (w == F.lower(w)) & w.rlike(r"\p{Ll}") & ~w.rlike(r"^(v\d+(?:\.\d+)*|\d.*)$"), _py_title(w)).otherwise(w))
    return F.array_join(fixed, " ")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def artifact_filename(base_name: Column, model_name: Column, size_label: Column, finetune: Column,
                      version: Column, output_type: Column, model_type: Column | None = None) -> Column:
    """P13 naming convention ``name[-size][-finetune][-version][-ENCODING][-kind]``:
    the name is the base name, else the model name, else ``ggml-model``
    (stripped; spaces and '/' -> '-'); every other part is added when it is
    not null (spaces -> '-', the encoding upper-cased)."""
    def nm(c):
        return F.replace(F.replace(_strip(c), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-"))

    def part(c, upper=False):
        v = F.replace(_strip(c), F.lit(" "), F.lit("-"))
        v = F.upper(v) if upper else v
        return F.when(c.isNotNull(), F.concat(F.lit("-"), v)).otherwise(F.lit(""))
    name = F.coalesce(nm(base_name), nm(model_name), F.lit("ggml-model"))
    size = F.when(size_label.isNotNull(), F.concat(F.lit("-"), size_label)).otherwise(F.lit(""))
    kind = part(model_type) if model_type is not None else F.lit("")
    return F.concat(name, size, part(finetune), part(version), part(output_type, upper=True), kind)


def shard_file_name(stem: Column, i: Column, n: Column, ext: str = ".gguf") -> Column:
    """``stem-00001-of-00005.gguf`` shard names; a single shard keeps
    ``stem`` + extension."""
    return F.when(n == 1, F.concat(stem, F.lit(ext))).otherwise(
        F.concat(stem, F.lit("-"), F.lpad(i.cast("string"), 5, "0"), F.lit("-of-"), F.lpad(n.cast("string"), 5, "0"),
                 F.lit(ext)))


def safe_name(s: Column) -> Column:
    """Characters outside ``[A-Za-z0-9_.-]`` -> ``_`` (package names)."""
    return F.regexp_replace(s, r"[^A-Za-z0-9_.\-]", "_")


def fill_type_template(name: Column, ftype: Column) -> Column:
    """``{ftype}``/``{outtype}`` -> lower case type, ``{FTYPE}``/``{OUTTYPE}`` -> upper."""
    lo, up = F.lower(ftype), F.upper(ftype)
    out = F.replace(name, F.lit("{ftype}"), lo)
    out = F.replace(out, F.lit("{outtype}"), lo)
    out = F.replace(out, F.lit("{FTYPE}"), up)
    return F.replace(out, F.lit("{OUTTYPE}"), up)


def block_id(name: Column) -> Column:
    """First all-digit dotted part of a name, as int; else null."""
    return F.try_element_at(F.filter(F.split(name, r"\."), lambda p: p.rlike(r"^[0-9]+$")), F.lit(1)).try_cast("int")


def group_key(name: Column) -> Column:
    """``blk.N``, ``enc.blk.N``/``dec.blk.N``, ``enc``/``dec``, else ``base``."""
    p = F.split(name, r"\.")
    p0, p1, p2 = F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))
    return (F.when((p0 == "blk") & p1.isNotNull(), F.concat_ws(".", p0, p1))
            .when(p0.isin("enc", "dec") & (p1 == "blk") & p2.isNotNull(), F.concat_ws(".", p0, p1, p2))
            .when(p0.isin("enc", "dec"), p0)
            .otherwise(F.lit("base")))


def _py_title(w: Column) -> Column:
    # str.title(): a letter is upper-cased when the previous char is not a
    # letter, lower-cased otherwise
    chars = F.split(w, "")
    n = F.size(chars)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(
        (i == 1) | ~F.element_at(chars, F.greatest(i - 1, F.lit(1))).rlike(r"^\p{L}$"),
        F.upper(F.element_at(chars, i))).otherwise(F.lower(F.element_at(chars, i)))), "")


def expand_abbrev(name: Column) -> Column:
    """Dotted words through the abbreviation dictionary (title-cased),
    other words title-cased, joined by spaces."""
    m = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v.title()))])
    return F.array_join(F.transform(F.split(name, r"\."), lambda w: F.coalesce(m[F.lower(F.trim(w))], _py_title(w))), " ")


# Added tokens that are control tokens although not marked special.
SPECIAL_LOOKING_TOKENS = ("<pad>", "<mask>", "<2mass>", "[@BOS@]")


def token_type(token: Column, is_special: Column | None = None) -> Column:
    """BYTE for ``<0xHH>``, CONTROL for special ids or special-looking
    text (starts ``<|`` and ends ``|>``, the fullwidth-bar form, starts
    ``<unused`` and ends ``>``, or a fixed set), else NORMAL."""
    looks = ((token.startswith("<|") & token.endswith("|>")) | (token.startswith("<｜") & token.endswith("｜>"))
             | (token.startswith("<unused") & token.endswith(">"))
             | token.isin(*SPECIAL_LOOKING_TOKENS))
    spec = looks if is_special is None else (is_special | looks)
    return (F.when(token.rlike(r"^<0x[0-9A-Fa-f]{2}>$"), F.lit("BYTE"))
            .when(spec, F.lit("CONTROL")).otherwise(F.lit("NORMAL")))


def _role_pattern(patterns: Sequence[str]) -> str:
    alts = [p.replace(".", r"\.").replace("{bid}", r"[0-9]+") for p in patterns]
    return "^(" + "|".join(alts) + r")\.[^.]+$"


def storage_type(name: Column, n_dims: Column, requested: Column, force: Column | None = None,
                 last_dim: Column | None = None) -> Column:
    """Ordered storage-type rules - a per-tensor force first; ndim <= 1 or
    ``_norm.weight`` -> F32 (even when forced); fixed F32 roles or a suffix
    other than .weight/.lora_a/.lora_b -> F32; embedding/output roles under a
    ternary type -> F16; else the requested type; a last dim not divisible by
    the type's block size falls back to F16."""
    force = force if force is not None else F.lit(None).cast("string")
    t = F.when(force.isNotNull(), force)
    t = F.when((n_dims <= 1) | name.endswith("_norm.weight"), F.lit("F32")).otherwise(t)
    quantizable_sfx = reduce(lambda a, b: a | b, [name.endswith(s) for s in QUANTIZABLE_SUFFIXES])
    f32 = name.rlike(_role_pattern(F32_ROLES)) | ~quantizable_sfx
    t = F.when(t.isNull() & f32, F.lit("F32")).otherwise(t)
    emb = name.rlike(_role_pattern(EMBED_ROLES)) & requested.isin(*TERNARY_TYPES)
    t = F.when(t.isNull() & emb, F.lit("F16")).otherwise(t)
    t = F.coalesce(t, requested)
    if last_dim is not None:
        t = F.when((last_dim % block_size(t)) != 0, F.lit("F16")).otherwise(t)
    return t


def first_key(v: Column, keys: Sequence[str], nested: str = "text_config") -> Column:
    """P25: first present key (as VARIANT) at top level, else under ``nested``."""
    cands = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
    cands += [F.try_variant_get(v, f"$.{nested}.{k}", "variant") for k in keys]
    return F.coalesce(*cands)


def preview(s: Column, limit: int = 60) -> Column:
    """P5: strings over ``limit`` -> first limit-3 chars + '...'."""
    return F.when(F.char_length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def preview_ends(s: Column, limit: int = 60) -> Column:
    """P5 markdown form: first and last ``limit // 2`` chars around '...'."""
    h = limit // 2
    return F.when(F.char_length(s) > limit,
                  F.concat(F.substring(s, 1, h), F.lit("..."), F.substring(s, -h, h))).otherwise(s)


def preview_array(a: Column, n: int = 6) -> Column:
    """P5: first n elements rendered, ``, ...`` when more exist."""
    shown = F.array_join(F.transform(F.slice(a, 1, n), lambda x: x.cast("string")), ", ")
    return F.concat(F.lit("[ "), shown, F.when(F.size(a) > n, F.lit(", ...")).otherwise(F.lit("")), F.lit(" ]"))


def inline_code(s: Column) -> Column:
    """A string as markdown code: one back-tick more around it than its
    longest run of them, and blanks inside where it begins or ends with one."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit("`+"), 0), F.char_length)), F.lit(0))
    pad = F.when(s.startswith("`") | s.endswith("`"), F.lit(" ")).otherwise(F.lit(""))
    return let(F.repeat(F.lit("`"), longest + 1), lambda mark: F.concat(mark, pad, s, pad, mark))


def preview_strings(a: Column, n: int = 5, limit: int = 30) -> Column:
    """P5: the first five strings as code, each cut to its first and last 15 characters."""
    h = limit // 2
    cut = lambda x: F.when(F.char_length(x) > limit, F.concat(
        inline_code(F.substring(x, 1, h)), F.lit("..."), inline_code(F.substring(x, -h, h)))).otherwise(inline_code(x))
    shown = F.transform(F.slice(a, 1, n), cut)
    return F.concat(F.lit("[ "), F.trim(F.array_join(shown, ", ")), F.when(F.size(a) > n, F.lit(", ...")).otherwise(F.lit("")), F.lit(" ]"))


def preview_numbers(a: Column) -> Column:
    """P5: the first seven numbers."""
    return preview_array(a, 7)


def skip_suffixes(df: DataFrame, name: str = "name") -> DataFrame:
    """drop names ending with a skipped suffix."""
    c = F.col(name)
    return df.filter(~reduce(lambda a, b: a | b, [c.endswith(s) for s in SKIP_SUFFIXES]))


# ----------------------------------------------------------- joins
def reconcile(index: DataFrame, actual: DataFrame, name: str = "name", file: str = "file") -> DataFrame:
    """Two-sided difference of the index (name -> file) and the names
    found in parts: one row per differing name with side ``missing`` (in the
    index only, with its file) or ``extra`` (in the parts only)."""
    a = index.select(name, file).withColumn("__i", F.lit(True))
    b = actual.select(name).distinct().withColumn("__a", F.lit(True))
    j = a.join(b, name, "full_outer").filter(F.col("__i").isNull() | F.col("__a").isNull())
    return j.select(name, F.when(F.col("__a").isNull(), F.lit("missing")).otherwise(F.lit("extra")).alias("side"),
                    F.when(F.col("__a").isNull(), F.col(file)).alias(file))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in exactly one side (set semantics)."""
    return a.subtract(b).union(b.subtract(a))


def expand_mapping(patterns: DataFrame, n_blocks: Column | int, src: str = "source",
                   dst: str = "target", priority: str = "priority") -> DataFrame:
    """``{bid}`` templates times block numbers 0..n-1 (``explode`` of a
    sequence per row, no join); non-block rows stay single; on a repeated
    source name the higher priority wins."""
    nb = F.lit(n_blocks) if isinstance(n_blocks, int) else n_blocks
    templ = F.col(src).contains("{bid}") | F.col(dst).contains("{bid}")
    e = patterns.withColumn("__bid", F.explode(F.when(templ, F.sequence(F.lit(0), nb - 1))
                                               .otherwise(F.array(F.lit(-1)))))
    b = F.col("__bid").cast("string")
    e = e.select(F.replace(F.col(src), F.lit("{bid}"), b).alias(src),
                 F.replace(F.col(dst), F.lit("{bid}"), b).alias(dst), F.col(priority))
    return e.groupBy(src).agg(F.max_by(F.col(dst), F.struct(F.col(priority), F.col(dst))).alias(dst))


def map_names(names: DataFrame, mapping: DataFrame, name: str = "name", src: str = "source",
              dst: str = "target", try_suffixes: Sequence[str] = MAP_TRY_SUFFIXES) -> DataFrame:
    """Exact key lookup, else strip the first matching suffix, look the
    stem up and re-append the suffix; unmapped -> null ``mapped`` (caller
    errors or reports them)."""
    m = mapping.select(F.col(src).alias("__k"), F.col(dst).alias("__v"))
    sfx = F.lit(None).cast("string")
    for s in reversed(try_suffixes):
        sfx = F.when(F.col(name).endswith(s), F.lit(s)).otherwise(sfx)
    d = names.withColumn("__sfx", sfx).withColumn(
        "__stem", F.when(F.col("__sfx").isNotNull(),
                         F.substring(F.col(name), F.lit(1), F.char_length(name) - F.char_length("__sfx"))))
    d = d.join(m.withColumnRenamed("__v", "__exact"), d[name] == m["__k"], "left").drop("__k")
    m2 = m.withColumnRenamed("__k", "__k2").withColumnRenamed("__v", "__viastem")
    d = d.join(m2, d["__stem"] == m2["__k2"], "left").drop("__k2")
    mapped = F.coalesce(F.col("__exact"), F.concat(F.col("__viastem"), F.col("__sfx")))
    return d.withColumn("mapped", mapped).drop("__sfx", "__stem", "__exact", "__viastem")


# Keys with rules of their own.
ARCHITECTURE_KEY, CHAT_TEMPLATE_KEY, VIRTUAL_PREFIX = "general.architecture", "tokenizer.chat_template", "GGUF."


def merge_metadata(base: DataFrame, new: DataFrame, removed: DataFrame | None = None,
                   keys: Sequence[str] = ("key",), key: str = "key", value: str = "value",
                   drop_keys: Sequence[str] = ()) -> DataFrame:
    """New metadata over old, per (entity..., key).

    Of the base, virtual (``GGUF.*``) and architecture keys, removed keys and,
    where the entity gets a new chat template, all old template keys are left
    out. A key that is in both has the new value, even a null one; a new key
    is added, also one that was removed from the base. Rows with a null value
    are dropped; ``origin`` tells kept / replaced / added."""
    ks = list(keys)
    entity = [k for k in ks if k != key]
    b = base.select(*ks, F.col(value).alias("__old")).filter((F.col(key) != ARCHITECTURE_KEY) & ~F.col(key).startswith(VIRTUAL_PREFIX))
    n = new.select(*ks, F.col(value).alias("__new"), F.lit(True).alias("__is_new"))
    if drop_keys:
        b = b.filter(~F.col(key).isin(*drop_keys))
        n = n.filter(~F.col(key).isin(*drop_keys))
    if removed is not None:
        b = b.join(removed.select(*ks), ks, "left_anti")
    fresh = n.filter(F.col(key) == CHAT_TEMPLATE_KEY).select(*[F.col(k).alias(f"__t_{k}") for k in entity], F.lit(CHAT_TEMPLATE_KEY).alias("__t")).distinct()
    template = F.when(F.col(key).startswith(CHAT_TEMPLATE_KEY), F.lit(CHAT_TEMPLATE_KEY))
    same = template == F.col("__t")
    for k in entity:
        same = same & (F.col(k) == F.col(f"__t_{k}"))
    b = b.join(fresh, same, "left_anti").withColumn("__is_old", F.lit(True))
    j = b.join(n, ks, "full_outer")
    j = j.withColumn(value, F.when(F.col("__is_new"), F.col("__new")).otherwise(F.col("__old"))) \
        .withColumn("origin", F.when(F.col("__is_new") & F.col("__is_old"), F.lit("replaced"))
                    .when(F.col("__is_new"), F.lit("added")).otherwise(F.lit("kept")))
    return j.filter(F.col(value).isNotNull()).drop("__new", "__old", "__is_new", "__is_old")


def resolve_special(types: DataFrame, added: DataFrame, n_vocab: int | Column,
                    type_col: str = "type", content: str = "content", tid: str = "id",
                    pos: str = "pos") -> DataFrame:
    """Per special type, the first added token (by position) whose
    content equals the type's content, and no later one: its id if that lies
    in [0, n_vocab), else null; a negative first id is reported as invalid."""
    nv = F.lit(n_vocab) if isinstance(n_vocab, int) else n_vocab
    a = added.select(F.col(content).alias("__c"), F.struct(F.col(tid).alias("v")).alias("__id"), F.col(pos).alias("__p"))
    j = types.join(a, types[content] == a["__c"], "left")
    r = j.groupBy(*types.columns).agg(F.min_by("__id", "__p").alias("__first"))
    first = F.col("__first.v")
    return r.withColumn(tid, F.when((first >= 0) & (first < nv), first)) \
        .withColumn("invalid", F.coalesce(first < 0, F.lit(False))).drop("__first")


# Hyper-parameter alias lists (first present alias wins).
HPARAM_ALIASES = {
    "context_length": ("max_position_embeddings", "n_ctx", "n_positions", "max_length"),
    "embedding_length": ("hidden_size", "n_embd", "dim"),
    "feed_forward_length": ("intermediate_size", "n_inner", "hidden_dim"),
    "head_count": ("num_attention_heads", "n_head", "n_heads"),
    "head_count_kv": ("num_key_value_heads", "n_kv_heads"),
    "layer_norm_rms_epsilon": ("rms_norm_eps", "norm_eps"),
    "layer_norm_epsilon": ("layer_norm_eps", "layer_norm_epsilon", "norm_epsilon"),
    "expert_gating_func": ("score_function", "scoring_func", "score_func"),
    "rope_freq_base": ("rope_theta",),
    "expert_count": ("num_local_experts",),
    "expert_used_count": ("num_experts_per_tok",),
    "expert_group_count": ("n_group",),
    "expert_group_used_count": ("topk_group",),
    "attention_key_length": ("head_dim",),
    "attention_value_length": ("head_dim",),
}
# Enumerated values of canonical keys.
HPARAM_VALUES = {"expert_gating_func": {"softmax": "1", "sigmoid": "2"}}


def alias_table(spark, aliases: dict | None = None):
    """(alias, canonical, priority) rows from an ordered alias mapping."""
    aliases = aliases or HPARAM_ALIASES
    rows = [(a, c, i) for c, al in aliases.items() for i, a in enumerate(al)]
    return spark.createDataFrame(rows, "alias string, canonical string, priority int")


def canonical_keys(config: DataFrame, aliases: DataFrame, entity: str = "entity", key: str = "key",
                   value: str = "value", value_maps: dict | None = None) -> DataFrame:
    """Ordered alias list -> one canonical key per entity; the first
    present alias (lowest priority number) wins; absent keys are omitted.
    ``aliases`` = (alias, canonical, priority) - a small dimension, broadcast,
    as few keys would make few and large tasks of a shuffle. Canonical keys with enumerated values are mapped
    (``value_maps``); an unknown value is flagged ``invalid``."""
    j = config.join(F.broadcast(aliases), config[key] == aliases["alias"], "inner")
    r = j.groupBy(entity, "canonical").agg(F.min_by(F.col(value), F.col("priority")).alias(value),
                                          F.min_by(F.col("alias"), F.col("priority")).alias("alias"))
    maps = value_maps if value_maps is not None else HPARAM_VALUES
    mapped, invalid = F.col(value), F.lit(False)
    for canon, vm in maps.items():
        m = F.create_map(*[x for k, v in vm.items() for x in (F.lit(k), F.lit(v))])
        is_c = F.col("canonical") == canon
        mapped = F.when(is_c, m[F.col(value)]).otherwise(mapped)
        invalid = invalid | (is_c & m[F.col(value)].isNull())
    others = [c for c in r.columns if c != value]
    return r.select(*others, mapped.alias(value), invalid.alias("invalid"))


# ----------------------------------------------------------- aggregations
def parameter_count(tensors: DataFrame, model: str = "model", name: str = "name",
                    shape: str = "shape", pos: str = "pos") -> DataFrame:
    """Per model total, shared, expert and mean expert count.

    Expert tensors (``_exps.`` in the name) count ``size // expert_count``
    with the expert dim at -2 for biases, -3 otherwise (last dim for low
    rank). A ``.lora_b`` takes the last dim of the last ``.lora_a`` before it,
    which must be its namesake; else the model counts as zero; any lora
    negates the total. Only lora tensors go through the ordered window."""
    t = tensors.select(model, pos, name, shape)
    is_a = F.col(name).endswith(".lora_a")
    is_b = F.col(name).endswith(".lora_b")
    before = Window.partitionBy(model).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(is_a, F.struct(F.col(name).alias("n"), F.element_at(shape, -1).alias("d"))), ignorenulls=True).over(before)
    lora = t.where(is_a | is_b).withColumn("__a", last)
    j = t.where(~(is_a | is_b)).unionByName(lora, allowMissingColumns=True)
    partner = F.concat(F.substring(F.col(name), F.lit(1), F.char_length(name) - 1), F.lit("a"))
    paired = is_b & F.coalesce(F.col("__a.n") == partner, F.lit(False))
    sh = F.when(paired, F.concat(F.slice(F.col(shape), 1, F.size(shape) - 1),
                                 F.array(F.col("__a.d")))).otherwise(F.col(shape))
    size = n_elements(sh)
    nd = F.size(sh)
    exp_cnt = F.when(F.col(name).contains(".bias"),
                     F.when(nd >= 2, F.element_at(sh, -2)).otherwise(F.element_at(sh, -1))) \
        .otherwise(F.when(nd >= 3, F.element_at(sh, -3)).otherwise(F.element_at(sh, -1))).cast("bigint")
    is_exp = F.col(name).contains("_exps.")
    counted = ~is_a
    r = j.groupBy(model).agg(
        F.sum(F.when(counted, size).otherwise(0)).alias("__total"),
        F.sum(F.when(counted & ~is_exp, size).otherwise(0)).alias("__shared"),
        F.sum(F.when(counted & is_exp, whole_div(size, exp_cnt)).otherwise(0)).alias("__expert"),
        F.sum(F.when(counted & is_exp, exp_cnt).otherwise(0)).alias("__esum"),
        F.sum(F.when(counted & is_exp, 1).otherwise(0)).alias("__en"),
        F.max(is_a.cast("int")).alias("__lora"),
        F.max((is_b & ~paired).cast("int")).alias("__bad"))
    bad = F.col("__bad") == 1
    total = F.when(F.col("__lora") == 1, -F.col("__total")).otherwise(F.col("__total"))
    return r.select(
        model,
        F.when(bad, 0).otherwise(total).cast("bigint").alias("total_params"),
        F.when(bad, 0).otherwise(F.col("__shared")).cast("bigint").alias("shared_params"),
        F.when(bad, 0).otherwise(F.col("__expert")).cast("bigint").alias("expert_params"),
        F.when(bad | (F.col("__en") == 0), 0).otherwise(whole_div(F.col("__esum"), F.col("__en"))).cast("bigint")
        .alias("expert_count"))


def group_rollup(tensors: DataFrame, model: str = "model", name: str = "name", pos: str = "pos",
                 elements: str = "n_elements", nbytes: str = "n_bytes") -> DataFrame:
    """Per model and group key - elements, share of the model total (%),
    bits per weight (null at 0 elements) and first-appearance order; the
    model total rows come from ``rollup`` (group = null)."""
    t = tensors.withColumn("group", group_key(F.col(name)))
    r = t.rollup(model, "group").agg(
        F.sum(elements).cast("bigint").alias("elements"), F.sum(nbytes).cast("bigint").alias("bytes"),
        F.min(pos).alias("first_pos"))
    r = r.filter(F.col(model).isNotNull())
    tot = r.filter(F.col("group").isNull()).select(model, F.col("elements").alias("__tot"))
    r = r.join(tot, model, "left")
    return r.select(model, "group", "elements", "bytes", "first_pos",
                    F.try_divide(F.col("elements") * 100.0, F.col("__tot")).alias("pct"),
                    F.when(F.col("elements") > 0, F.col("bytes") * 8.0 / F.col("elements")).alias("bits_per_weight"))


def share_of_total(df: DataFrame, value: str, out: str = "pct") -> DataFrame:
    """Value / grand total * 100. The total is a scalar subquery (one
    aggregate job, substituted as a value) - no global window, no join."""
    total = df.select(F.sum(F.col(value))).scalar()
    return df.withColumn(out, F.try_divide(F.col(value) * 100.0, total))


def content_hashes(df: DataFrame, data: str = "data") -> DataFrame:
    """sha1 and sha256 per tensor payload."""
    return df.withColumn("sha1", F.sha1(F.col(data))).withColumn("sha256", F.sha2(F.col(data), 256))


#: Positions of a model below which its digests are taken in one task.
WHOLE = 65_536


def model_digest(df: DataFrame, model: str, pos: str, digest: str = "sha256", fan: int = 4096) -> DataFrame:
    """A8 re-aimed: a tree digest per model. A level's digests fall into
    groups of ``fan`` positions, and each group becomes the sha-256 of its
    digests' texts in order; levels follow until the model has one digest, so
    a model of up to ``fan`` positions has one level and no step ever gathers
    more than ``fan`` digests. The number of levels of a model depends on its
    largest position (from 0) alone. Not byte-compatible with a sequential
    whole-file digest."""
    d = df.select(model, F.col(pos).cast("bigint").alias("__at"), F.col(digest).alias("__d")).where(F.col(model).isNotNull())
    largest, level = d.agg(F.max("__at")).first()[0] or 0, 0
    # models of few positions lie whole in a task, so every level follows in place after one shuffle by model
    whole = largest < WHOLE
    if whole:
        d = d.withColumn("__top", F.max("__at").over(Window.partitionBy(model)))
    else:
        d = d.join(d.groupBy(model).agg(F.max("__at").alias("__top")), model)
    while level == 0 or largest > 0:
        if level and not whole:
            d = materialize(d, "digest-level")
        unit = F.lit(1) if level == 0 else F.when(F.col("__top") > 0, F.lit(1)).otherwise(F.lit(0))
        group = F.floor(F.col("__at") / fan)
        one = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__d"))), lambda x: x["__d"]), ""), 256)
        d = d.withColumn("__open", unit == 1).groupBy(model, "__open", "__top", group.alias("__at")).agg(
            F.when(F.col("__open"), one).otherwise(F.max("__d")).alias("__d"))
        d = d.select(model, "__at", "__d", F.floor(F.col("__top") / fan).alias("__top"))
        largest, level = largest // fan, level + 1
    return d.select(model, F.col("__d").alias("model_sha256"))


def first_dtype(tensors: DataFrame, model: str = "model", pos: str = "pos", dtype: str = "dtype") -> DataFrame:
    """A10: default storage type from the first tensor: f16 -> F16 else BF16."""
    r = tensors.groupBy(model).agg(F.min_by(F.col(dtype), F.col(pos)).alias("first_dtype"))  # pos unique per model
    return r.withColumn("default_type", F.when(F.lower("first_dtype").isin("f16", "float16"), F.lit("F16"))
                        .otherwise(F.lit("BF16")))


def duplicates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Names repeated within a key (count > 1)."""
    return df.groupBy(*keys, name).agg(F.count(F.lit(1)).cast("bigint").alias("n")).filter(F.col("n") > 1)


def shard_totals(plan: DataFrame, shard_keys: list[str], nbytes: str = "n_bytes") -> DataFrame:
    """Tensors and bytes per output shard."""
    return plan.groupBy(*shard_keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_tensors"),
                                        F.sum(nbytes).cast("bigint").alias("bytes"))


def complete_groups(parts: DataFrame, n: int, projections: Sequence[str], block: str = "block", proj: str = "projection",
                    part: str = "part", shape: str = "shape") -> DataFrame:
    """A block is complete when all its ``projections`` have the parts
    0..n-1; only then is each projection merged (the shape of part 0 with a
    leading n). One row per (block, projection) with its distinct parts;
    everything of an incomplete block, and parts outside the range, is left
    over."""
    one = parts.groupBy(block, proj, part).agg(F.min(shape).alias("__shape"))
    wanted = F.col(proj).isin(*projections) & F.col(part).between(0, n - 1)
    g = one.groupBy(block, proj).agg(
        F.sort_array(F.collect_list(F.col(part))).alias("parts"), F.count(F.when(wanted, 1)).alias("__n"),
        F.min(F.when(F.col(part) == 0, F.col("__shape"))).alias("__shape"))
    whole = g.groupBy(block).agg(F.sum("__n").alias("__all")).where(F.col("__all") == n * len(projections)).select(block, F.lit(True).alias("__whole"))
    g = g.join(whole, block, "left").withColumn("complete", F.coalesce("__whole", F.lit(False)) & (F.col("__n") == n))
    return g.withColumn("merged_shape", F.when(F.col("complete"), F.concat(F.array(F.lit(n).cast("bigint")), F.col("__shape")))) \
        .drop("__n", "__shape", "__whole")


# ----------------------------------------------------------- windows
#: Ranks of a model that one window holds.
RANKS = 4096
#: Tensors of a model up to which its shards are folded in one row.
FOLD = 1024


def _next_starts(t: DataFrame, max_tensors: int, max_bytes: int) -> DataFrame:
    """``(m, s, t)``: where the shard that starts at rank ``s`` ends and the
    next one starts (rank ``t``), for every rank with such a successor.

    ``t`` holds ``m, rank, sum`` (bytes up to and with the rank) and ``bytes``.
    The successor is one more than the number of ranks whose sum is at most the
    sum before ``s`` plus the limit. Ranks come in blocks of ``RANKS``; sums
    and limits both grow with the rank, so a block of starts meets few blocks
    of sums, and only those pairs are merged, each in a window of its own.
    """
    block = F.floor((F.col("rank") - 1) / RANKS)
    t = t.withColumn("limit", F.col("sum") - F.col("bytes") + max_bytes)
    blocks = materialize(t.groupBy("m", block.alias("b")).agg(F.max("sum").alias("high"), F.min("limit").alias("low_limit"), F.max("limit").alias("high_limit")), "shard-blocks")

    # block of sums in which a limit lies: the number of blocks whose highest sum is at most the limit
    marks = blocks.select("m", F.explode(F.array(F.struct(F.col("high").alias("x"), F.lit(0).alias("kind"), "b"), F.struct(F.col("low_limit").alias("x"), F.lit(1).alias("kind"), "b"),
                                                 F.struct(F.col("high_limit").alias("x"), F.lit(2).alias("kind"), "b"))).alias("r")).select("m", "r.*")
    before = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(Window.partitionBy("m").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ends = marks.withColumn("e", before).where("kind > 0").groupBy("m", "b").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    pairs = materialize(ends.select("m", "b", "first", F.explode(F.sequence("first", "last")).alias("e")), "shard-pairs")

    sums = t.select("m", block.alias("e"), F.col("sum").alias("x")).join(pairs.select("m", "b", "e"), ["m", "e"])
    starts = t.select("m", block.alias("b"), F.col("limit").alias("x"), F.col("rank").alias("s")).join(pairs.select("m", "b", "e"), ["m", "b"])
    both = sums.select("m", "b", "e", "x", F.lit(None).cast("bigint").alias("s")).unionByName(starts.select("m", "b", "e", "x", "s"))
    up = Window.partitionBy("m", "b", "e").orderBy("x", F.col("s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("n", F.sum(F.when(F.col("s").isNull(), 1).otherwise(0)).over(up)).where("s is not null")
    counted = inside.groupBy("m", "b", "s").agg(F.sum("n").alias("n")).join(pairs.select("m", "b", "first").distinct(), ["m", "b"])
    after = F.greatest(F.col("first") * RANKS + F.col("n"), F.col("s")) + 1  # a tensor above the limit is a shard of its own
    if max_tensors:
        after = F.least(after, F.col("s") + max_tensors)
    size = t.groupBy("m").agg(F.max("rank").alias("size"))
    return counted.select("m", "s", after.alias("t")).join(size, "m").where("t <= size").select("m", "s", "t")


def plan_shards(tensors: DataFrame, model: str, pos: str, nbytes: str, max_tensors: int = 0,
                max_bytes: int = 0, small_first: bool = False) -> DataFrame:
    """Greedy split - a new shard opens when the current one is non-empty
    and its tensor count is reached or the next tensor would exceed the byte
    limit; ``small_first`` keeps shard 0 empty (metadata only). ``pos`` must be
    unique within a model; null sizes are 0.

    A model of up to ``FOLD`` tensors is folded in one row. For a larger one
    the fold is a chain of jumps: every rank has a successor, the start of the
    next shard if a shard started there, found by a merge of prefix sums with
    prefix sums plus the limit. The ranks that the chain from the first one
    visits are found by pointer doubling: in each round the starts known so far
    jump by twice as many shards as before, so the rounds are the logarithm of
    the number of shards, and one model spreads over many tasks. Count-only
    limits are arithmetic on the rank."""
    base = 1 if small_first else 0
    if not max_tensors and not max_bytes:
        return tensors.withColumn("shard", F.lit(base).cast("bigint"))
    slim = tensors.select(F.col(model).alias("m"), F.col(pos).alias("p"), F.col(nbytes).alias("bytes")).where("m is not null and p is not null")
    slim = materialize(slim, "shard-tensors")
    large = materialize(slim.groupBy("m").count().where(F.col("count") > FOLD).select("m"), "shard-models")  # few: each has many rows
    if not large.take(1):
        numbered = _folded_shards(slim, max_tensors, max_bytes)
    else:
        some = slim.join(large, "m", "left_semi")
        jumped = some.join(_jumped_shards(some, max_tensors, max_bytes), ["m", "p"])
        numbered = _folded_shards(slim.join(large, "m", "left_anti"), max_tensors, max_bytes).unionByName(jumped)
    numbered = numbered.select(F.col("m").alias(model), F.col("p").alias(pos), F.col("bytes").alias(nbytes), (F.col("shard") + base).cast("bigint").alias("shard"))
    if set(tensors.columns) == {model, pos, nbytes}:
        return numbered.select(*tensors.columns, "shard")
    return tensors.join(numbered.drop(nbytes), [model, pos], "inner")


def _folded_shards(slim: DataFrame, max_tensors: int, max_bytes: int) -> DataFrame:
    """Shards from 0 of models of few tensors: the greedy rule itself, as a
    fold over a model's sorted sizes."""
    def step(acc, x):
        size = F.coalesce(x["bytes"], F.lit(0)).cast("bigint")
        full = F.lit(False)
        if max_tensors:
            full = full | (acc["n"] >= max_tensors)
        if max_bytes:
            full = full | (acc["sum"] + size > max_bytes)
        opens = (acc["n"] > 0) & full
        shard = acc["shard"] + F.when(opens, 1).otherwise(0)
        return F.struct(shard.alias("shard"), F.when(opens, 1).otherwise(acc["n"] + 1).alias("n"),
                        F.when(opens, size).otherwise(acc["sum"] + size).alias("sum"), F.concat(acc["out"], F.array(shard)).alias("out"))

    rows = slim.groupBy("m").agg(F.array_sort(F.collect_list(F.struct("p", "bytes"))).alias("rows"))
    none = F.struct(F.lit(0).alias("shard"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"), F.array().cast("array<int>").alias("out"))
    numbered = F.zip_with("rows", F.aggregate("rows", none, step, lambda acc: acc["out"]), lambda r, k: F.struct(r["p"].alias("p"), r["bytes"].alias("bytes"), k.alias("shard")))
    # a plain explode would be preceded by a filter on its array, and so by the fold once more
    return rows.select("m", F.explode_outer(numbered).alias("r")).select("m", "r.p", "r.bytes", F.col("r.shard").cast("bigint").alias("shard"))


def _jumped_shards(slim: DataFrame, max_tensors: int, max_bytes: int) -> DataFrame:
    """``(m, p, shard)`` from 0 for models of any number of tensors."""
    slim = slim.select("m", "p", F.coalesce(F.col("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.lit(1).alias("one"))
    by = F.floor(F.col("p") / RANKS)
    ranked = running_agg(slim, ["m"], ["p"], "one", by, "rank", "sum")
    if not max_bytes:
        return ranked.select("m", "p", F.floor((F.col("rank") - 1) / max_tensors).alias("shard"))
    t = materialize(running_agg(ranked, ["m"], ["p"], "bytes", by, "sum", "sum").drop("one"), "shard-ranks")
    jump = materialize(_next_starts(t, max_tensors, max_bytes), "shard-jumps")
    found = [t.where("rank = 1").select("m", F.col("rank").alias("s"))]
    while True:
        known = reduce(DataFrame.unionAll, found)
        new = materialize(known.join(jump, ["m", "s"]).select("m", F.col("t").alias("s")), "shard-starts")
        if not new.take(1):
            break
        found.append(new)
        twice = jump.select("m", F.col("s").alias("t"), F.col("t").alias("u"))
        jump = materialize(jump.join(twice, ["m", "t"]).select("m", "s", F.col("u").alias("t")), "shard-jumps")
    starts = reduce(DataFrame.unionAll, found).select("m", F.col("s").alias("rank"), F.lit(1).alias("start"))
    opened = t.join(starts, ["m", "rank"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    return running_agg(opened, ["m"], ["rank"], "start", F.floor(F.col("rank") / RANKS), "k", "sum").select("m", "p", (F.col("k") - 1).alias("shard"))


def aligned_offsets(tensors: DataFrame, keys: list[str], pos: str, nbytes: str,
                    align: int = DATA_ALIGNMENT, bucket_rows: int = 4096) -> DataFrame:
    """Data offset = running sum of the earlier tensors' sizes padded to
    the alignment (skew-safe two-level running sum; buckets of positions)."""
    t = tensors.withColumn("__padded", pad_to(F.col(nbytes), align))
    r = running_agg(t, keys, [pos], "__padded", F.floor(F.col(pos) / bucket_rows), "offset", "sum",
                    include_current=False)
    return r.withColumn("offset", F.coalesce(F.col("offset"), F.lit(0)).cast("bigint")).drop("__padded")


def shard_numbering(plan: DataFrame, model: str, shard: str) -> DataFrame:
    """Shard number (dense, 0-based), shard count and total tensors of
    the model on every row. The windows run over the per-shard aggregate
    (one row per shard), never over a model's tensors; one join brings the
    numbers back."""
    per_shard = plan.groupBy(model, shard).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(model).orderBy(shard)
    wm = Window.partitionBy(model)
    info = per_shard.select(model, shard, (F.dense_rank().over(w) - 1).alias("split_no"),
                            F.count(F.lit(1)).over(wm).cast("int").alias("split_count"),
                            F.sum("__n").over(wm).cast("bigint").alias("split_tensors_count"))
    return plan.join(info, [model, shard], "left")


def flatten_kv(df: DataFrame, entity: str, record: str) -> DataFrame:
    """A JSON object -> long ``(entity, key, value)`` rows (value as
    JSON text), nulls dropped; an array of objects gives a ``key.count`` row
    plus ``key.i.field`` rows for its elements' non-null fields."""
    m = F.try_variant_get(F.try_parse_json(F.col(record)), "$", "map<string,variant>")
    ex = df.select(entity, F.explode(m).alias("key", "__val"))
    t = F.schema_of_variant(F.col("__val"))
    is_obj_arr = F.coalesce(t.startswith("ARRAY<OBJECT"), F.lit(False))
    scalars = ex.filter(~is_obj_arr & (t != "VOID")).select(
        entity, "key", F.to_json(F.col("__val")).alias("value"))
    arrs = ex.filter(is_obj_arr).withColumn("__arr", F.try_variant_get(F.col("__val"), "$", "array<variant>"))
    counts = arrs.select(entity, F.concat(F.col("key"), F.lit(".count")).alias("key"),
                         F.size("__arr").cast("string").alias("value"))
    elems = arrs.select(entity, "key", F.posexplode("__arr").alias("__i", "__e"))
    fields = elems.select(entity, "key", "__i",
                          F.explode(F.try_variant_get(F.col("__e"), "$", "map<string,variant>")).alias("__f", "__fv"))
    fields = fields.filter(F.schema_of_variant(F.col("__fv")) != "VOID").select(
        entity, F.concat_ws(".", F.col("key"), F.col("__i").cast("string"), F.col("__f")).alias("key"),
        F.to_json(F.col("__fv")).alias("value"))
    return scalars.unionByName(counts).unionByName(fields)


# Token type codes and default scores.
TOKTYPE = {"NORMAL": 1, "UNKNOWN": 2, "CONTROL": 3, "USER_DEFINED": 4, "UNUSED": 5, "BYTE": 6}
SCORE_ABSENT = -10000.0
SCORE_ADDED = -1000.0


def densify_vocab(spark, tokens: DataFrame, n_vocab: int, tid: str = "id", token: str = "token",
                  priority: str = "priority", score: str | None = None, bytes_by_look: bool = False) -> DataFrame:
    """Ids 0..n-1 - layered token sources override by id (highest
    priority wins), out-of-range ids are dropped; an absent id becomes
    ``[PAD{i}]`` of type UNUSED with score -10000. A base token is NORMAL,
    whatever it looks like. An added (priority > 0) token scores -1000; it is
    CONTROL if it looks special (P17) and else USER_DEFINED with the space
    mark U+2581 as a space. ``bytes_by_look`` is the sentence-piece form, in
    which tokens of either layer that look like bytes are BYTE."""
    sc = F.col(score) if score else F.lit(0.0)
    t = tokens.filter((F.col(tid) >= 0) & (F.col(tid) < n_vocab)).select(
        F.col(tid).alias("id"), F.struct(F.col(priority).alias("p"), F.col(token).alias("t"),
                                         sc.cast("double").alias("s")).alias("__x"))
    best = t.groupBy("id").agg(F.max_by(F.col("__x"), F.col("__x.p")).alias("__b"))
    ids = spark.range(n_vocab).withColumnRenamed("id", "id")
    j = ids.join(best, "id", "left")
    kind = token_type(F.col("__b.t"))
    ttype = (F.when(F.col("__b").isNull(), F.lit(TOKTYPE["UNUSED"]))
             .when(F.lit(bytes_by_look) & (kind == "BYTE"), F.lit(TOKTYPE["BYTE"]))
             .when(F.col("__b.p") <= 0, F.lit(TOKTYPE["NORMAL"]))
             .when(kind == "CONTROL", F.lit(TOKTYPE["CONTROL"]))
             .otherwise(F.lit(TOKTYPE["USER_DEFINED"])))
    text = F.when(ttype == TOKTYPE["USER_DEFINED"], F.replace(F.col("__b.t"), F.lit("\u2581"), F.lit(" "))).otherwise(F.col("__b.t"))
    return j.select("id",
                    F.coalesce(text, F.concat(F.lit("[PAD"), F.col("id").cast("string"), F.lit("]"))).alias("token"),
                    ttype.cast("int").alias("toktype"),
                    F.when(F.col("__b").isNull(), F.lit(SCORE_ABSENT))
                    .when(F.col("__b.p") > 0, F.lit(SCORE_ADDED)).otherwise(F.col("__b.s")).alias("score"))


def distinct_ordered(a: Column) -> Column:
    """Remove repeats, keeping first-occurrence order."""
    return F.array_distinct(a)


def layered_metadata(sources: DataFrame, entity: str = "entity", key: str = "key", value: str = "value",
                     priority: str = "priority", append_keys: Sequence[str] = ("tags", "languages")) -> DataFrame:
    """One value per (entity, key) from layered sources - the highest
    priority wins (``max_by``); list keys (``append_keys``, values as
    ``array<string>`` JSON) concatenate all layers in priority order (lowest
    first) without repeats."""
    s = sources.select(entity, key, value, priority)
    scal = s.filter(~F.col(key).isin(*append_keys)).groupBy(entity, key).agg(
        F.max_by(F.col(value), F.col(priority)).alias(value))
    lists = s.filter(F.col(key).isin(*append_keys)).groupBy(entity, key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(priority), F.from_json(F.col(value), "array<string>").alias("v"))))
        .alias("__l"))
    lists = lists.select(entity, key, F.to_json(F.array_distinct(F.flatten(F.transform("__l", lambda x: x["v"])))).alias(value))
    return scal.unionByName(lists)


# Companion tensor suffixes and the kinds of merged tensors they form, first match wins.
COMPANION_SUFFIXES = (".weight", ".weight_scale", ".weight_scale_inv", ".qweight", ".qzeros", ".scales",
                      ".weight_packed", ".weight_shape", ".weight_zero_point", ".g_idx")
COMPANION_KINDS = (("fp8_scale_inv", (".weight", ".weight_scale_inv")), ("scaled", (".weight", ".weight_scale")),
                   ("gptq", (".qweight", ".qzeros", ".scales")), ("packed", (".weight_packed", ".weight_shape", ".weight_scale")))
#: Parts that a kind uses when they are there.
COMPANION_EXTRAS = {"gptq": (".g_idx",), "packed": (".weight_zero_point",)}


def companions(catalog: DataFrame, model: str = "model", name: str = "name") -> DataFrame:
    """Group tensors by base name (name minus a companion suffix) and
    classify each group: weight + scale_inv, weight + scale, qweight + qzeros
    + scales (+ g_idx), or packed + shape + scale (+ zero point) form one
    dequantizable tensor; a group with other parts keeps its parts. One flag
    per suffix, so the aggregate combines before the shuffle."""
    alts = "|".join(s.replace(".", r"\.") for s in COMPANION_SUFFIXES)
    sfx = F.regexp_extract(F.col(name), f"({alts})$", 1)
    base = F.when(sfx != "", F.substring(F.col(name), F.lit(1), F.char_length(name) - F.char_length(sfx))).otherwise(F.col(name))
    known = ("", *COMPANION_SUFFIXES)
    flags = [F.max(F.when(F.col("part") == p, F.lit(p))).alias(f"__p{i}") for i, p in enumerate(known)]
    g = catalog.select(model, base.alias("base"), sfx.alias("part")).groupBy(model, "base").agg(*flags)
    has = {p: F.col(f"__p{i}").isNotNull() for i, p in enumerate(known)}
    kind = F.lit("plain")
    for label, parts in reversed(COMPANION_KINDS):
        whole = has[parts[0]]
        for p in parts[1:]:
            whole = whole & has[p]
        kind = F.when(whole, F.lit(label)).otherwise(kind)
    g = g.withColumn("parts", F.array_sort(F.array_compact(F.array(*[F.col(f"__p{i}") for i in range(len(known))])))).withColumn("kind", kind)
    return g.select(model, "base", "parts", "kind", (F.col("kind") != "plain").alias("merged"))


def merge_companions(catalog: DataFrame, model: str = "model", name: str = "name") -> DataFrame:
    """J11 result: the tensor names after merging. The parts that a merged
    tensor uses go and ``<base>.weight`` takes their place (``origin`` is its
    kind); all other parts stay (``kept``)."""
    g = companions(catalog, model, name)
    used = F.array().cast("array<string>")
    for label, parts in COMPANION_KINDS:
        used = F.when(F.col("kind") == label, F.array(*[F.lit(p) for p in (*parts, *COMPANION_EXTRAS.get(label, ()))])).otherwise(used)
    rest = F.transform(F.array_except("parts", used), lambda p: F.struct(F.concat(F.col("base"), p).alias("name"), F.lit("kept").alias("origin")))
    new = F.struct(F.concat(F.col("base"), F.lit(".weight")).alias("name"), F.col("kind").alias("origin"))
    rows = F.when(F.col("merged"), F.concat(F.array(new), rest)).otherwise(rest)
    return g.select(model, F.explode(rows).alias("r")).select(model, F.col("r.name").alias(name), "r.origin")
