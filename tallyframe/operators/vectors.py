"""Vector-column block formats (Q0-Q12, J18), all as column expressions.

The formats themselves are in ``tallyframe.functions.blocks``; here are the
column operators over them: packing with a fallback, unpacking by a row's own
type, round-trip errors, block comparison, and the unpacking dequantizers of
foreign layouts (Q9, Q10, Q12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import blocks as B
from tallyframe.functions.util import let

FALLBACK_TYPE = "F16"


def packed_type(col: Column, qtype: str) -> Column:
    """The type a row is packed with: ``qtype``, or F16 where the width is no
    multiple of its block."""
    if qtype not in B.LAYOUT:
        raise NotImplementedError(f"no format {qtype}")
    return F.when(col.isNull(), F.lit(None)).when(F.size(col) % B.LAYOUT[qtype][0] == 0, qtype).otherwise(FALLBACK_TYPE)


def packed_bytes(col: Column, qtype: str) -> Column:
    """Bytes of the row under ``qtype``, null where its width does not fit."""
    if qtype in ("F16", "BF16"):
        b = B.pack_plain(col, qtype)
    elif qtype == "F32":
        b = F.unhex(F.array_join(F.transform(col, lambda v: let(B.grid_bits(v, 23, 127), lambda x: F.concat(
            *[F.lpad(F.hex(F.pmod(F.shiftright(x, 8 * k), F.lit(256))), 2, "0") for k in range(4)]))), ""))
    else:
        b = B.pack(B.encode(col, qtype), qtype)
    fits = F.size(col) % B.LAYOUT[qtype][0] == 0
    return F.when(fits & (F.size(col) == 0), F.unhex(F.lit(""))).when(fits, b)


def quantize_column(df: DataFrame, col: str, qtype: str, out: str = "packed") -> DataFrame:
    """Q0-Q8: pack an ``ARRAY<FLOAT>`` column with ``qtype``; rows whose width
    is not a multiple of the block size fall back to F16. Adds ``out``
    (BINARY) and ``{out}_type`` (the type actually used); null rows stay null."""
    c = F.col(col)
    data = packed_bytes(c, qtype)
    if qtype != FALLBACK_TYPE and B.LAYOUT[qtype][0] > 1:
        data = F.coalesce(data, packed_bytes(c, FALLBACK_TYPE))
    return df.withColumn(out, data).withColumn(f"{out}_type", packed_type(c, qtype))


def unpacked(data: Column, qtype: str) -> Column:
    """The float values of packed bytes of one type."""
    if qtype in ("F16", "BF16"):
        return B.unpack_plain(data, qtype)
    if qtype == "F32":
        n = (F.length(data) / 4).cast("int")
        return F.when(n == 0, F.array().cast("array<float>")).otherwise(let(B.byte_values(data), lambda x: F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: B.from_bits(sum((F.get(x, i * 4 + k).cast("bigint") * (1 << 8 * k) for k in range(4)), F.lit(0)), 23, 127))))
    return B.decode(B.unpack(data, qtype), qtype)


def dequantize_column(df: DataFrame, col: str, type_col: str, out: str = "values", types=tuple(B.LAYOUT)) -> DataFrame:
    """Unpack a BINARY column whose type is named per row in ``type_col``; a
    type outside ``types`` gives null."""
    value = F.lit(None).cast("array<float>")
    for t in types:
        value = F.when(F.col(type_col) == t, unpacked(F.col(col), t)).otherwise(value)
    return df.withColumn(out, value)


def _round_trip(col: Column, qtype: str) -> Column:
    """The values that ``col`` comes back with from ``qtype``: from the codes,
    as the bytes hold the same; null where the width does not fit."""
    if qtype == "F32":
        return col
    if qtype in ("F16", "BF16"):
        return F.transform(col, B.half if qtype == "F16" else B.bfloat)
    return B.decode(B.encode(col, qtype), qtype)


def quant_errors(df: DataFrame, col: str, qtypes: list[str]) -> DataFrame:
    """Q11: round trip of every row through every one of ``qtypes`` in one
    scan: one row per row and type with ``requested``, the type used
    (``qtype``: F16 where the width does not fit), ``n_bytes``, RMSE and
    maximum absolute error, and the number of values that come back as NaN
    (``n_nan``) and infinite (``n_inf``). NaN and infinite errors count in the
    two errors as they are. A null row has nulls."""
    c = F.col(col)

    def one(q: str) -> Column:
        size, width = B.LAYOUT[q]
        fits = F.size(c) % size == 0
        values = _round_trip(c, q)
        if size > 1:
            empty = F.array().cast("array<float>")
            values = F.when(F.size(c) == 0, empty).when(fits, values).otherwise(_round_trip(c, FALLBACK_TYPE))
        n_bytes = F.when(fits, (F.size(c) / size).cast("int") * width).otherwise(F.size(c) * 2)
        return F.struct(F.lit(q).alias("requested"), packed_type(c, q).alias("qtype"), F.when(c.isNotNull(), n_bytes).alias("n_bytes"), values.alias("w"))

    d = df.withColumn("__t", F.explode(F.array(*[one(q) for q in qtypes]))).select(*df.columns, "__t.*")
    d = d.withColumn("__e", F.zip_with("w", c, lambda w, v: w.cast("double") - v.cast("double")))
    total = F.aggregate("__e", F.lit(0.0), lambda a, e: a + e * e)
    most = F.aggregate("__e", F.lit(0.0), lambda a, e: F.greatest(a, F.abs(e)))
    n = F.size("__e")

    def number(pred) -> Column:
        return F.size(F.filter("w", pred))

    return d.select(*df.columns, "requested", "qtype", "n_bytes",
                    F.when(n > 0, F.sqrt(total / n)).when(n == 0, 0.0).alias("rmse"), F.when(n >= 0, most).alias("max_abs_err"),
                    F.when(n >= 0, number(F.isnan)).alias("n_nan"), F.when(n >= 0, number(lambda w: F.abs(w) == float("inf"))).alias("n_inf"))


def quant_error(df: DataFrame, col: str, qtype: str) -> DataFrame:
    """Q11 for one type: the type used, packed bytes, RMSE and max absolute
    error per row (totals via ordinary aggregation)."""
    return quant_errors(df, col, [qtype]).drop("requested", "n_nan", "n_inf")


def compare_blocks(df: DataFrame, a: str, b: str, block_bytes: int) -> DataFrame:
    """XOR two packed encodings block by block: blocks, bad (differing)
    blocks, differing bits, and the worst block with its bit count. The last
    block may be short; a byte that only one side has differs in all 8 bits.
    Bit-identical blocks are equal even when they hold NaN; a null side gives
    nulls."""
    def result(x: Column, y: Column) -> Column:
        n = F.greatest(F.size(x), F.size(y))
        bits = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.bit_count(F.get(x, i).bitwiseXOR(F.get(y, i))), F.lit(8))))
        blocks = F.ceil(n / block_bytes).cast("int")
        sums = let(bits, lambda v: F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(
            F.sequence(F.lit(0), blocks - 1), lambda k: F.aggregate(F.slice(v, k * block_bytes + 1, block_bytes), F.lit(0), lambda s, w: s + w))))
        return let(sums, lambda s: F.struct(
            blocks.alias("n_blocks"), F.size(F.filter(s, lambda v: v > 0)).alias("bad_blocks"),
            F.aggregate(s, F.lit(0).cast("bigint"), lambda t, v: t + v).alias("diff_bits"),
            F.when(F.array_max(s) > 0, (F.array_position(s, F.array_max(s)) - 1).cast("int")).alias("worst_block"),
            F.coalesce(F.array_max(s), F.lit(0)).alias("worst_bits")))

    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    c = F.when(both, let(B.byte_values(F.col(a)), lambda x: let(B.byte_values(F.col(b)), lambda y: result(x, y))))
    return df.withColumn("__c", c).select("*", "__c.*").drop("__c")


# ------------------------------------------------------------------ native forms
def q8_0_codes(col: Column, block: int = 32) -> Column:
    """Q2 as a native expression: per block ``struct(d FLOAT, codes
    ARRAY<INT>)`` with d = max|x| / 127 and codes = round-half-away(x / d)
    in float32 arithmetic (divisions computed in double and rounded to
    float, which equals float32 division). Widths not divisible -> null."""
    n = F.size(col)

    def blocks(x):
        def one(b):
            vals = F.slice(x, b * block + 1, block)

            def with_d(d):
                inv = F.when(d == 0, F.lit(0.0).cast("float")).otherwise((F.lit(1.0) / d).cast("float"))
                codes = F.transform(vals, lambda v: B.round_away((v * inv).cast("float")))
                return F.struct(d.alias("d"), codes.alias("codes"))
            amax = F.array_max(F.transform(vals, lambda v: F.abs(v)))
            return let((amax / F.lit(127.0)).cast("float"), with_d)
        return F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int") - 1), one)
    return F.when((n % block == 0) & (n > 0), let(col, blocks))


def dequant_scaled(values: Column, scales: Column, block: int) -> Column:
    """Q10: repeat each scale over its block, trim to the row width, multiply."""
    rep = F.flatten(F.transform(scales, lambda s: F.array_repeat(s, block)))
    return F.zip_with(values, F.slice(rep, 1, F.size(values)), lambda v, s: (v * s).cast("float"))


def unpack_words(words: Column, bits: int) -> Column:
    """Q9: little fields of ``bits`` width from 32-bit words, lowest first.
    Words may be signed INT or unsigned values in BIGINT; fields come from
    exact integer arithmetic on the unsigned 32-bit value."""
    per = 32 // bits
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(per - 1)),
        lambda i: F.call_function("shiftrightunsigned", w.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)), i * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))))


def dequant_packed_int(words: Column, scales: Column, bits: int, group: int, width: Column,
                       zeros: Column | None = None) -> Column:
    """Q9: unpack, subtract the zero point (default half range; for 2-bit
    the ternary offset 1), multiply by the group scale, trim padding."""
    q = F.slice(unpack_words(words, bits), 1, width)
    default_zero = 1 if bits == 2 else (1 << (bits - 1))
    z = zeros if zeros is not None else F.array_repeat(F.lit(default_zero), F.size(scales))

    def one(v, i):
        g = F.floor(i / group).cast("int") + 1
        return ((v - F.element_at(z, g)).cast("float") * F.element_at(scales, g)).cast("float")
    return let(q, lambda codes: F.transform(codes, one))


def dequant_grouped(codes: Column, zeros_words: Column, scales: Column, group_index: Column, bits: int,
                    width: Column, format_v1: bool = False) -> Column:
    """Q12: unpack 2/4/8-bit codes and per-group zero points (+1 for format
    v1), gather scale and zero by each element's group index, then
    (code - zero) * scale. 3-bit packing is rejected."""
    if bits not in (2, 4, 8):
        raise ValueError("dequant_grouped supports 2, 4 or 8 bits")
    q = F.slice(unpack_words(codes, bits), 1, width)
    z = unpack_words(zeros_words, bits)
    if format_v1:
        z = F.transform(z, lambda v: v + 1)
    return let(z, lambda zero: F.transform(q, lambda v, i: (
        (v - F.element_at(zero, F.element_at(group_index, i + 1) + 1)).cast("float")
        * F.element_at(scales, F.element_at(group_index, i + 1) + 1)).cast("float")))
