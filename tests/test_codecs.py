"""Block formats: bytes and values against plain Python arithmetic on them."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import blocks as B
from tallyframe.functions.pyformat import py_fixed
from tallyframe.operators import vectors as VQ

BLOCKED = [q for q, (size, _) in B.LAYOUT.items() if size > 1]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(24, 256)) * 10.0 ** rng.integers(-6, 4, size=(24, 1))).astype(np.float32)
    x[0] = 0.0                                     # a zero block
    x[1, :32] = np.float32(3.0)                    # a constant block
    x[2] = np.linspace(-1, 1, 256, dtype=np.float32)
    return x


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, e array<float>").cache()


def read_bytes(qtype, block):
    """(scale, offset, codes) of one block's bytes, by the public layout."""
    size = B.LAYOUT[qtype][0]
    half = lambda at: struct.unpack("<e", block[at:at + 2])[0]
    nib = lambda b: [x & 15 for x in b] + [x >> 4 for x in b]
    if qtype == "MXFP4":
        return 2.0 ** (block[0] - 128), 0.0, nib(block[1:])
    if qtype == "Q8_0":
        return half(0), 0.0, [x - 256 if x > 127 else x for x in block[2:]]
    if qtype in ("TQ1_0", "TQ2_0"):
        q = [0] * size
        if qtype == "TQ2_0":
            for i in range(256):
                q[i] = block[i // 128 * 32 + i % 32] >> (2 * (i % 128 // 32)) & 3
        else:
            at = 0
            for start, groups, width in ((0, 5, 32), (160, 5, 16), (240, 4, 4)):
                for j in range(width):
                    b = block[at + j]
                    for k in range(groups):
                        q[start + width * k + j], b = b * 3 // 256, b * 3 % 256
                at += width
        return half(len(block) - 2), 0.0, q
    two = qtype.endswith("1")
    at = 4 if two else 2
    if qtype.startswith("Q5"):
        high = int.from_bytes(block[at:at + 4], "little")
        q = [n | (high >> i & 1) << 4 for i, n in enumerate(nib(block[at + 4:]))]
    else:
        q = nib(block[at:])
    return half(0), half(2) if two else 0.0, q


def value(qtype, d, m, q):
    shift = {"Q4_0": 8, "Q5_0": 16, "TQ1_0": 1, "TQ2_0": 1}.get(qtype, 0)
    if qtype == "MXFP4":
        return d * B.E2M1_DOUBLED[q]
    return d * (q - shift) + m


@pytest.mark.parametrize("qtype", BLOCKED)
def test_bytes_hold_the_nearest_codes(table, rows, qtype):
    size, width = B.LAYOUT[qtype]
    e = B.encode(F.col("e"), qtype)
    got = table.select("i", B.pack(e, qtype).alias("p")).select("i", "p", VQ.unpacked(F.col("p"), qtype).alias("w")).collect()
    for r in got:
        p = bytes(r.p)
        assert len(p) == 256 // size * width
        back = np.array(r.w)
        for b in range(256 // size):
            x = rows[r.i][b * size:(b + 1) * size].astype(float)
            d, m, codes = read_bytes(qtype, p[b * width:(b + 1) * width])
            mine = np.array([value(qtype, d, m, q) for q in codes])
            top = np.abs(x).max()
            assert np.allclose(back[b * size:(b + 1) * size], mine, rtol=1e-6, atol=1e-30)
            if qtype in ("Q4_1", "Q5_1"):
                span, levels = x.max() - x.min(), 15 if qtype == "Q4_1" else 31
                assert np.isclose(d, np.float16(span / levels), rtol=2e-3, atol=1e-7) and np.isclose(m, np.float16(x.min()), rtol=2e-3, atol=1e-7)
            elif qtype != "MXFP4":
                parts = {"Q8_0": 127, "Q4_0": 8, "Q5_0": 16}.get(qtype, 1)
                assert np.isclose(abs(d), top / parts, rtol=2e-3, atol=1e-7)
            # no code is farther off than half a step; the stored half precision and the clipped end may add to it
            step = 2 * abs(d) if qtype == "MXFP4" else abs(d)
            slack = {"Q4_0": 0.5, "Q5_0": 0.5, "MXFP4": 1.6}.get(qtype, 0.0) * step + np.abs(x).max() * 2e-3 + 5e-6  # and the scale may underflow
            assert (np.abs(mine - x) <= step / 2 + slack).all()


def test_ternary_is_exact_on_ternary_input(spark):
    x = (np.random.default_rng(5).integers(-1, 2, size=(4, 256)) * 0.5).astype(np.float32)
    x[:, 0] = 0.5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, e array<float>")
    for q in ("TQ1_0", "TQ2_0"):
        for r in VQ.dequantize_column(VQ.quantize_column(df, "e", q, "p"), "p", "p_type", "w").collect():
            assert r.p_type == q and r.w == x[r.i].tolist()


def test_plain_types_against_struct(spark, table, rows):
    edge = [0.0, -0.0, 1.0, -2.5, 65504.0, 65520.0, -1e6, 6e-8, 2.0 ** -24, 2.0 ** -25, 1.00390625, 1.01171875, 3.4e38, 1e-40, 0.1]
    df = table.unionByName(spark.createDataFrame([(1000, edge)], "i int, e array<float>"))
    for r in df.select("i", "e", VQ.packed_bytes(F.col("e"), "F16").alias("h"), VQ.packed_bytes(F.col("e"), "BF16").alias("b"),
                       VQ.packed_bytes(F.col("e"), "F32").alias("f")).collect():
        x = np.array(r.e, np.float32)
        with np.errstate(over="ignore"):
            assert bytes(r.h) == x.astype(np.float16).tobytes()
        assert bytes(r.f) == x.tobytes()
        for k, v in enumerate(x):
            u = struct.unpack("<I", struct.pack("<f", v))[0]
            low, high = u & 0xFFFF, u >> 16
            want = high + (low > 0x8000 or (low == 0x8000 and high & 1))
            assert bytes(r.b)[2 * k:2 * k + 2] == struct.pack("<H", want)
    back = df.select("e", VQ.unpacked(VQ.packed_bytes(F.col("e"), "F32"), "F32").alias("w")).collect()
    assert all(r.e == r.w for r in back)


def test_native_q8_codes_equal_packed_codes(table):
    for r in table.select(VQ.q8_0_codes(F.col("e")).alias("b"), B.encode(F.col("e"), "Q8_0").alias("x")).collect():
        assert [b.codes for b in r.b] == [b.codes for b in r.x]


def test_quant_error_is_that_of_the_values(table, rows):
    for r in VQ.quant_error(table, "e", "Q5_1").join(VQ.dequantize_column(VQ.quantize_column(table, "e", "Q5_1", "p"), "p", "p_type", "w"), "i").collect():
        diff = np.array(r.w, float) - rows[r.i].astype(float)
        assert r.qtype == "Q5_1" and r.n_bytes == 8 * 24
        assert np.isclose(r.rmse, np.sqrt((diff ** 2).mean())) and np.isclose(r.max_abs_err, np.abs(diff).max())


def test_quantize_column_fallback_and_dequantize(spark):
    df = spark.createDataFrame([([1.0] * 64,), ([0.5] * 48,), (None,)], "e array<float>")
    q = VQ.quantize_column(df, "e", "Q4_0", "p")
    d = VQ.dequantize_column(q, "p", "p_type", "back").collect()
    assert [r.p_type for r in d] == ["Q4_0", "F16", None]
    assert d[0].back == [1.0] * 64 and d[1].back == [0.5] * 48 and d[2].back is None


def test_compare_blocks(spark):
    a = bytes(range(34)) * 2
    b = a[:34] + bytes([a[34] ^ 0xFF]) + a[35:]
    df = spark.createDataFrame([(a, b), (a, a)], "a binary, b binary")
    r = VQ.compare_blocks(df, "a", "b", 34).collect()
    assert (r[0].n_blocks, r[0].bad_blocks, r[0].diff_bits, r[0].worst_block, r[0].worst_bits) == (2, 1, 8, 1, 8)
    assert (r[1].bad_blocks, r[1].diff_bits, r[1].worst_block) == (0, 0, None)


def test_compare_blocks_counts_the_short_last_block(spark):
    a = bytes(40)
    rows = [(a, a[:34] + b"\xff" * 6), (a, a[:36]), (a, None), (b"", b"")]
    r = VQ.compare_blocks(spark.createDataFrame(rows, "a binary, b binary"), "a", "b", 34).collect()
    assert [(x.n_blocks, x.bad_blocks, x.diff_bits, x.worst_block) for x in r] == [(2, 1, 48, 1), (2, 1, 32, 1), (None,) * 4, (0, 0, 0, None)]


def test_python_style_fixed_point(spark):
    vals = [2.675, 0.065, 1.25, 0.125, 2.5, 999.95, -1.25, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1, 2):
        got = [r.t for r in df.select(py_fixed(F.col("x"), d).alias("t")).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]


def test_fixed_point_beside_a_tie(spark):
    ties = [k + 0.5 for k in (0, 1, 2, 7, 1234567)]
    vals = [0.05, 0.005, 0.15, 0.25, 0.35, 1.005, 0.5 - 2**-54, 0.5 + 2**-53, 1e-300]
    vals += [v for k in ties for d in (1, 10, 100) for v in (k / d, math.nextafter(k / d, 9e9), math.nextafter(k / d, 0))]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (0, 1, 2):
        got = [r.t for r in df.select(py_fixed(F.col("x"), d).alias("t")).collect()]
        assert got == [f"{v:.{d}f}" for v in vals]


@pytest.mark.parametrize("qtype", ["F32", "F16", "BF16", "Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1", "MXFP4", "TQ1_0", "TQ2_0"])
def test_special_floats_have_bytes_that_read_back_as_the_codes(spark, qtype):
    nan, inf = float("nan"), float("inf")
    rows = []
    for x in (nan, inf, -inf, -0.0, 1e-45, -1e-45, 1e-42, 3.4e38, -3.4e38, 65520.0, 6e-8):
        rows += [[x] + [0.25 * i for i in range(255)], [x] + [0.0] * 255, [x, -x] * 128]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, v array<float>")
    q = VQ.dequantize_column(VQ.quantize_column(df, "v", qtype), "packed", "packed_type", "back")
    codes = {r.id: r for r in VQ.quant_errors(df, "v", [qtype]).collect()}
    for r in q.select("id", "packed", "packed_type", "back", VQ._round_trip(F.col("v"), qtype).alias("short")).collect():
        assert r.packed_type == qtype and len(r.packed) == codes[r.id].n_bytes and len(r.back) == 256
        assert str(r.back) == str(r.short)
        assert codes[r.id].n_nan == sum(np.isnan(r.back)) and codes[r.id].n_inf == sum(np.isinf(r.back))
