"""Block formats of float vectors as column expressions.

A block format cuts an ``ARRAY<FLOAT>`` into blocks of ``size`` values and
stores each as one or two half-precision parameters and one small code per
value. ``encode`` yields the blocks as structs (``d`` scale, ``m`` offset,
``codes``), ``pack`` their bytes, ``unpack`` the structs from bytes and
``decode`` the values. All arithmetic is float32 (products and sums of floats;
quotients are computed in double and rounded, which gives the same), so bytes
agree with other writers of the public formats.

Every float has a code. NaN is stored as the quiet NaN without a sign, too
large values as infinite, subnormal values on the grid. A block with a NaN or
an infinite value, or whose span overflows, gets a NaN or infinite parameter,
and what then has no whole number (NaN, infinite) takes the number 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.util import let

# Format name -> (values per block, bytes per block).
LAYOUT = {
    "F32": (1, 4), "F16": (1, 2), "BF16": (1, 2),
    "Q4_0": (32, 18), "Q4_1": (32, 20), "Q5_0": (32, 22), "Q5_1": (32, 24), "Q8_0": (32, 34),
    "TQ1_0": (256, 54), "TQ2_0": (256, 66), "MXFP4": (32, 17),
}
# Twice the e2m1 code points.
E2M1_DOUBLED = (0, 1, 2, 3, 4, 6, 8, 12, 0, -1, -2, -3, -4, -6, -8, -12)


def f32(x: Column) -> Column:
    return x.cast("float")


def whole(x: Column) -> Column:
    """The whole-number part; 0 for NaN and what is beyond 31 bits."""
    return let(x, lambda v: F.when(F.abs(v) < 2.0 ** 31, v.cast("int")).otherwise(F.lit(0)))  # NaN is above all numbers


def round_away(x: Column) -> Column:
    """Nearest whole number, halves away from zero; 0 for NaN and what is
    beyond 31 bits."""
    def parts(a: Column) -> Column:
        return F.when(a < 2.0 ** 31, F.floor(a) + F.floor((a - F.floor(a)) * 2)).otherwise(F.lit(0))

    return let(x, lambda v: (F.when(v < 0, -1).otherwise(1) * let(F.abs(v).cast("double"), parts)).cast("int"))


def _binade(a: Column, least: int) -> Column:
    """Exponent of a positive value, not below ``least``."""
    return F.greatest(F.floor(F.log2(a)), F.lit(least))


def to_grid(x: Column, mantissa: int, least: int) -> Column:
    """``x`` (a float) rounded half to even to ``mantissa`` bits after the
    leading one, with subnormals below exponent ``least``; as a double."""
    def one(a: Column) -> Column:
        step = F.pow(F.lit(2.0), _binade(a, least) - mantissa)
        return F.when(a == 0, F.lit(0.0)).when(a >= float("inf"), a).otherwise(F.rint(a / step) * step)

    return F.signum(x) * let(F.abs(x).cast("double"), one)


def half(x: Column) -> Column:
    """``x`` rounded to half precision, as a float; too large values become infinite."""
    return f32(let(to_grid(x, 10, -14), lambda r: F.when(F.abs(r) > 65504, F.signum(r) * float("inf")).otherwise(r)))


def bfloat(x: Column) -> Column:
    return f32(to_grid(x, 7, -126))


def grid_bits(x: Column, mantissa: int, bias: int) -> Column:
    """Bit pattern of a value that lies on the grid of ``to_grid``."""
    top = (2 * bias + 1) << mantissa

    def one(a: Column) -> Column:
        e = _binade(a, 1 - bias)
        scaled = (a / F.pow(F.lit(2.0), e - mantissa)).cast("bigint")  # holds the leading one unless subnormal
        return (F.when(a == 0, F.lit(0)).when(F.isnan(a), F.lit(top + (1 << mantissa - 1))).when(a == float("inf"), F.lit(top))
                .otherwise((e + bias - 1) * (1 << mantissa) + scaled))

    sign = F.when(x.cast("string").startswith("-"), F.lit((2 * bias + 2) << mantissa)).otherwise(F.lit(0))  # also of -0.0
    return let(F.abs(x).cast("double"), one).cast("bigint") + sign


def from_bits(bits: Column, mantissa: int, bias: int) -> Column:
    """Inverse of ``grid_bits``, as a float (infinite or NaN for the top exponent)."""
    one = 1 << mantissa

    def magnitude(b: Column) -> Column:
        e, f = F.floor(b / one), F.pmod(b, F.lit(one))
        normal = (f + one) * F.pow(F.lit(2.0), e - bias - mantissa)
        return F.when(e == 2 * bias + 1, F.when(f == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(e == 0, f * F.lit(2.0 ** (1 - bias - mantissa))).otherwise(normal)

    sign_bit = (2 * bias + 2) << mantissa
    return f32(let(bits.cast("bigint"), lambda b: let(magnitude(F.pmod(b, F.lit(sign_bit))), lambda v: F.when(b >= sign_bit, -v).otherwise(v))))


@dataclass(frozen=True)
class Rule:
    """How a format finds its parameters, codes a value and reads a code.

    ``scale(vals)`` and ``offset(vals)`` are floats of the block before they
    are stored; ``code(v, inverse scale, offset)``; ``value(code, d, m)``.
    """

    scale: Callable[[Column], Column]
    code: Callable[[Column, Column, Column], Column]
    value: Callable[[Column, Column, Column], Column]
    offset: Callable[[Column], Column] | None = None


def _absmax(vals: Column) -> Column:
    return F.array_max(F.transform(vals, F.abs))


def _extreme(vals: Column) -> Column:
    """The first value of the largest magnitude, with its sign."""
    return let(_absmax(vals), lambda a: F.get(F.filter(vals, lambda v: F.abs(v) == a), F.lit(0)))


def _least(vals: Column) -> Column:
    """The smallest value, NaN if one is."""
    return let(F.array_max(vals), lambda top: F.when(F.isnan(top), top).otherwise(F.array_min(vals)))


def _const(x: float) -> Column:
    return F.lit(x).cast("float")


def _by_extreme(levels: int) -> Rule:
    """The extreme value takes the lowest code; codes run to ``levels - 1``."""
    middle = levels // 2
    return Rule(lambda v: f32(_extreme(v) / -middle),
                lambda v, inv, _: F.least(whole(f32(v * inv) + _const(middle + 0.5)), F.lit(levels - 1)),
                lambda q, d, _: f32(d * f32(q - middle)))


def _by_range(levels: int) -> Rule:
    """Codes divide the span from the smallest to the largest value."""
    return Rule(lambda v: f32((F.array_max(v) - F.array_min(v)) / (levels - 1)),
                lambda v, inv, lo: F.least(whole(f32(f32(v - lo) * inv) + _const(0.5)), F.lit(levels - 1)),
                lambda q, d, m: f32(f32(d * f32(q)) + m), _least)


def _by_absmax(divisor: int, shift: int) -> Rule:
    return Rule(lambda v: f32(_absmax(v) / divisor), lambda v, inv, _: round_away(f32(v * inv)) + shift, lambda q, d, _: f32(d * f32(q - shift)))


RULES = {
    "Q8_0": _by_absmax(127, 0), "Q4_0": _by_extreme(16), "Q5_0": _by_extreme(32), "Q4_1": _by_range(16), "Q5_1": _by_range(32),
    "TQ1_0": _by_absmax(1, 1), "TQ2_0": _by_absmax(1, 1),
}


def _shared_exponent(vals: Column) -> Column:
    """Stored exponent byte: that of the largest magnitude, two below it; 0 if that is no number."""
    return let(_absmax(vals).cast("double"), lambda a: F.when((a > 0) & (a < float("inf")), F.pmod((F.floor(F.log2(a)) + 125).cast("int"), F.lit(256))).otherwise(0))


def _e2m1_points() -> Column:
    return F.array(*[_const(x) for x in E2M1_DOUBLED])


def encode(col: Column, fmt: str) -> Column:
    """``ARRAY<STRUCT<d, m, codes>>``, one per block; null where the width is
    no multiple of the block. ``d`` and ``m`` are as stored (half precision;
    for MXFP4 ``d`` is the scale of the doubled code points)."""
    size = LAYOUT[fmt][0]
    n = F.size(col)

    def plain(vals: Column) -> Column:
        rule = RULES[fmt]
        m = rule.offset(vals) if rule.offset else _const(0.0)
        inverse = lambda d: F.when(d == 0, _const(0.0)).otherwise(f32(F.lit(1.0) / d))
        return let(F.struct(rule.scale(vals).alias("d"), m.alias("m")), lambda p: let(inverse(p["d"]), lambda inv: F.struct(
            half(p["d"]).alias("d"), half(p["m"]).alias("m"), F.transform(vals, lambda v: rule.code(v, inv, p["m"])).alias("codes"))))

    def shared(vals: Column) -> Column:
        def codes(d: Column) -> Column:
            def nearest(v: Column) -> Column:
                return let(F.transform(_e2m1_points(), lambda k: F.abs(f32(f32(d * k) - v))), lambda e: (F.array_position(e, F.array_min(e)) - 1).cast("int"))
            return F.struct(d.alias("d"), _const(0.0).alias("m"), F.transform(vals, nearest).alias("codes"))
        return let(f32(F.pow(F.lit(2.0), _shared_exponent(vals) - 128)), codes)

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (n / size).cast("int") - 1), lambda b: let(F.slice(x, b * size + 1, size), shared if fmt == "MXFP4" else plain))

    return F.when((n > 0) & (n % size == 0), let(col, blocks))


def decode(blocks: Column, fmt: str) -> Column:
    """The values that encoded blocks stand for."""
    if fmt == "MXFP4":
        return F.flatten(F.transform(blocks, lambda b: F.transform(b["codes"], lambda q: f32(b["d"] * F.get(_e2m1_points(), q)))))
    rule = RULES[fmt]
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["codes"], lambda q: rule.value(q, b["d"], b["m"]))))


# ------------------------------------------------------------------- bytes
def _hex(byte: Column) -> Column:
    return F.lpad(F.hex(byte.cast("bigint")), 2, "0")


def _joined(count: int, byte: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: _hex(byte(i))), "")


def _half_hex(x: Column) -> Column:
    return let(grid_bits(x, 10, 15), lambda b: F.concat(_hex(F.pmod(b, F.lit(256))), _hex(F.floor(b / 256))))


def _nibbles(q: Column) -> Column:
    """The block's first half in the low, its second half in the high nibbles."""
    return _joined(16, lambda i: F.pmod(F.get(q, i), F.lit(16)) + F.pmod(F.get(q, i + 16), F.lit(16)) * 16)


def _digits(q: Column, start: int, groups: int, width: int, weights: tuple[int, ...]) -> Callable[[Column], Column]:
    """Byte ``i``: the digits at ``start + width * k + i`` for every group ``k``, weighed."""
    def byte(i: Column) -> Column:
        total = F.lit(0)
        for k in range(groups):
            total = total + F.get(q, i + (start + width * k)) * weights[k]
        return total
    return byte


# Base-3 and base-4 place values of the ternary formats.
PLACES_3, PLACES_4 = (81, 27, 9, 3, 1), (1, 4, 16, 64)
#: TQ1_0's three runs: first value, groups, bytes.
RUNS_3 = ((0, 5, 32), (160, 5, 16), (240, 4, 4))


def pack(blocks: Column, fmt: str) -> Column:
    """Bytes of encoded blocks."""
    def one(b: Column) -> Column:
        d, m, q = _half_hex(b["d"]), _half_hex(b["m"]), b["codes"]
        if fmt == "Q8_0":
            return F.concat(d, _joined(32, lambda i: F.pmod(F.get(q, i), F.lit(256))))
        if fmt in ("Q4_0", "Q4_1"):
            return F.concat(*([d] if fmt == "Q4_0" else [d, m]), _nibbles(q))
        if fmt in ("Q5_0", "Q5_1"):
            high = _joined(4, lambda k: sum((F.floor(F.get(q, k * 8 + j) / 16) * (1 << j) for j in range(8)), F.lit(0)))
            return F.concat(*([d] if fmt == "Q5_0" else [d, m]), high, _nibbles(q))
        if fmt == "TQ2_0":
            return F.concat(*[_joined(32, _digits(q, h, 4, 32, PLACES_4)) for h in (0, 128)], d)
        if fmt == "TQ1_0":  # five digits as a fraction of a byte, rounded up
            return F.concat(*[_joined(w, lambda i, s=s, g=g, w=w: F.floor((_digits(q, s, g, w, PLACES_3)(i) * 256 + 242) / 243)) for s, g, w in RUNS_3], d)
        exponent = (F.log2(b["d"].cast("double")) + 128).cast("int")
        return F.concat(_hex(exponent), _nibbles(q))

    return F.unhex(F.array_join(F.transform(blocks, one), ""))


def byte_values(data: Column) -> Column:
    """``BINARY`` as ``ARRAY<INT>`` of unsigned bytes."""
    def split(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("int"))
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(let(F.hex(data), split))


def _pair(x: Column, at: int) -> Column:
    return F.get(x, F.lit(at)) + F.get(x, F.lit(at + 1)) * 256


def unpack(data: Column, fmt: str) -> Column:
    """Encoded blocks from their bytes."""
    size, width = LAYOUT[fmt]

    def one(x: Column) -> Column:
        def codes(count: int, of: Callable[[Column], Column]) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: of(i).cast("int"))

        def nibble(at: int) -> Callable[[Column], Column]:
            return lambda i: let(F.get(x, F.pmod(i, F.lit(16)) + at), lambda v: F.when(i < 16, F.pmod(v, F.lit(16))).otherwise(F.floor(v / 16)))

        def fifth(at: int) -> Callable[[Column], Column]:
            bit = lambda i: F.pmod(F.floor(F.get(x, F.floor(i / 8).cast("int") + at) / F.pow(F.lit(2.0), F.pmod(i, F.lit(8)))), F.lit(2)) * 16
            return lambda i: nibble(at + 4)(i) + bit(i)

        d_at = {"TQ1_0": 52, "TQ2_0": 64}.get(fmt, 0)
        d = from_bits(_pair(x, d_at), 10, 15)
        m = from_bits(_pair(x, 2), 10, 15) if fmt in ("Q4_1", "Q5_1") else _const(0.0)
        if fmt == "Q8_0":
            q = codes(32, lambda i: let(F.get(x, i + 2), lambda v: F.when(v > 127, v - 256).otherwise(v)))
        elif fmt in ("Q4_0", "Q4_1"):
            q = codes(32, nibble(2 if fmt == "Q4_0" else 4))
        elif fmt in ("Q5_0", "Q5_1"):
            q = codes(32, fifth(2 if fmt == "Q5_0" else 4))
        elif fmt == "TQ2_0":
            q = codes(256, lambda i: F.pmod(F.floor(F.get(x, (F.floor(i / 128) * 32 + F.pmod(i, F.lit(32))).cast("int")) / F.pow(F.lit(4.0), F.floor(F.pmod(i, F.lit(128)) / 32))), F.lit(4)))
        elif fmt == "TQ1_0":
            parts, at = [], 0
            for start, groups, w in RUNS_3:  # digit k of a byte: shift k digits out to the left, then take the next
                parts.append(codes(groups * w, lambda i, at=at, w=w: F.floor(F.pmod(
                    F.get(x, F.pmod(i, F.lit(w)) + at) * F.pow(F.lit(3.0), F.floor(i / w)), F.lit(256.0)) * 3 / 256)))
                at += w
            q = F.concat(*parts)
        else:
            d, q = f32(F.pow(F.lit(2.0), F.get(x, F.lit(0)) - 128)), codes(32, nibble(1))
        return F.struct(d.alias("d"), m.alias("m"), q.alias("codes"))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.size(x) / width).cast("int") - 1), lambda b: let(F.slice(x, b * width + 1, width), one))

    return F.when(F.length(data) >= width, let(byte_values(data), blocks)).otherwise(F.array())


def pack_plain(col: Column, fmt: str) -> Column:
    """Bytes of the formats without blocks: F16 and BF16 (little-endian)."""
    if fmt == "F16":
        return F.unhex(F.array_join(F.transform(col, lambda v: _half_hex(half(v))), ""))
    bits = lambda v: grid_bits(bfloat(v), 7, 127)
    return F.unhex(F.array_join(F.transform(col, lambda v: let(bits(v), lambda b: F.concat(_hex(F.pmod(b, F.lit(256))), _hex(F.floor(b / 256))))), ""))


def unpack_plain(data: Column, fmt: str) -> Column:
    mantissa, bias = (10, 15) if fmt == "F16" else (7, 127)
    pairs = F.sequence(F.lit(0), (F.length(data) / 2).cast("int") - 1)
    return F.when(F.length(data) == 0, F.array().cast("array<float>")).otherwise(let(byte_values(data), lambda x: F.transform(
        pairs, lambda i: from_bits(F.get(x, i * 2) + F.get(x, i * 2 + 1) * 256, mantissa, bias))))
