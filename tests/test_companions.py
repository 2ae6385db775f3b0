"""Companion tensors with payloads: kinds, bit widths, scales and padding."""

import pytest

from tallyframe.operators.companions import CONFIG, dequantize_companions

PARTS = "model bigint, name string, row bigint, values array<double>"


def rows_of(spark, parts, config):
    d = dequantize_companions(spark.createDataFrame([(m, n, r, [float(x) for x in v]) for m, n, r, v in parts], PARTS), spark.createDataFrame(config, CONFIG))
    out = {}
    for x in d.collect():
        out.setdefault((x.model, x.name, x.origin), {})[x.row] = x["values"]
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def pack(fields, bits):
    return [sum((x & (2 ** bits - 1)) << bits * i for i, x in enumerate(fields[a:a + 32 // bits])) for a in range(0, len(fields), 32 // bits)]


def signed(words):
    return [w - 2 ** 32 if w >= 2 ** 31 else w for w in words]


def test_scales_by_row_by_block_and_for_all(spark):
    w = [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12, 13, 14, 15]]
    parts = [(m, n, i, v) for m, n in ((1, "a.weight"), (2, "a.weight"), (3, "a.weight")) for i, v in enumerate(w)]
    parts += [(1, "a.weight_scale", i, [s]) for i, s in enumerate((2, 4, 8))] + [(2, "a.weight_scale", 0, [0.5])]
    parts += [(3, "a.weight_scale_inv", i, s) for i, s in enumerate(([1, 10], [100, 1000]))] + [(1, "b.bias", 0, [7])]
    got = rows_of(spark, parts, [(1, None, None, None, None, None, None), (2, None, None, None, None, None, None), (3, None, None, None, 2, 3, None)])
    assert got[(1, "a.weight", "scaled")] == [[x * s for x in v] for v, s in zip(w, (2, 4, 8))]
    assert got[(2, "a.weight", "scaled")] == [[x / 2 for x in v] for v in w]
    assert got[(3, "a.weight", "fp8_scale_inv")] == [[1, 2, 3, 40, 50], [6, 7, 8, 90, 100], [1100, 1200, 1300, 14000, 15000]]
    assert got[(1, "b.bias", "kept")] == [[7]] and len(got) == 4


def test_two_bit_rows(spark):
    parts = [(1, "a.weight", r, [sum(((r + c + k) % 3) << 2 * k for k in range(4)) for c in range(6)]) for r in range(2)] + [(1, "a.weight_scale", 0, [4])]
    got = rows_of(spark, parts, [(1, "bitnet", None, None, None, None, None)])
    assert got == {(1, "a.weight", "scaled"): [[((r + c + k) % 3 - 1) / 4 for c in range(6)] for k in range(4) for r in range(2)]}


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_packed_and_grouped_of_every_width(spark, bits):
    top, rows, width = 2 ** bits - 1, 11, 21
    code = [[(r * 7 + c * 5) % (top + 1) for c in range(width)] for r in range(rows)]
    zero = [[(r + 2 * g) % (top + 1) for g in range(3)] for r in range(rows)]
    scale = [[(r + 1) / 2 ** g for g in range(3)] for r in range(rows)]
    parts = []
    for m in (1, 2):
        parts += [(m, "p.weight_packed", r, signed(pack(code[r] + [0] * 3, bits))) for r in range(rows)] + [(m, "p.weight_scale", r, scale[r]) for r in range(rows)]
        parts += [(m, "p.weight_shape", 0, [rows, width])]
    by_group = [pack([zero[r][g] for r in range(rows)], bits) for g in range(3)]
    parts += [(2, "p.weight_zero_point", k, [by_group[g][k] for g in range(3)]) for k in range(len(by_group[0]))]
    # grouped: inputs are packed down the rows, outputs lie across; groups in any order
    per, order = 32 // bits, [(i * 5) % 3 for i in range(width)]
    down = [pack([code[o][i] for i in range(width)], bits) for o in range(rows)]
    for m in (3, 4):
        parts += [(m, "g.qweight", p, [down[o][p] for o in range(rows)]) for p in range(-(-width // per))]
        parts += [(m, "g.scales", g, [scale[o][g] for o in range(rows)]) for g in range(3)]
        parts += [(m, "g.qzeros", g, pack([zero[o][g] for o in range(rows)], bits)) for g in range(3)] + [(m, "g.g_idx", 0, order)]
    got = rows_of(spark, parts, [(m, None, bits, 8, None, None, m == 4) for m in (1, 2, 3, 4)])
    middle = 2 ** (bits - 1)
    assert got[(1, "p.weight", "packed")] == [[(code[r][c] - middle) * scale[r][c // 8] for c in range(width)] for r in range(rows)]
    assert got[(2, "p.weight", "packed")] == [[(code[r][c] - zero[r][c // 8]) * scale[r][c // 8] for c in range(width)] for r in range(rows)]
    for m in (3, 4):
        assert got[(m, "g.weight", "gptq")] == [[(code[o][i] - zero[o][order[i]] - (m == 4)) * scale[o][order[i]] for i in range(width)] for o in range(rows)]
