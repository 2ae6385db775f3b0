"""VEC plans over ``embeddings`` (64 float32 per row: two 32-blocks; four
rows joined make the 256-wide rows of the ternary formats)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.blocks import E2M1_DOUBLED, LAYOUT
from tallyframe.functions.util import let
from tallyframe.operators import companions as CO
from tallyframe.operators import vectors as VQ
from tallyframe.plans.common import t

ROUNDTRIP_TYPES = ("F32", "F16", "BF16", "Q8_0", "Q4_0", "Q4_1", "Q5_0", "Q5_1", "MXFP4", "TQ1_0", "TQ2_0")


def q8_codes(spark: SparkSession, sf_dir: str):
    e = t(spark, sf_dir, "embeddings").select("vec_id", VQ.q8_0_codes(F.col("embedding")).alias("b"))
    x = e.select("vec_id", F.posexplode("b").alias("block", "blk"))
    return x.select("vec_id", "block", F.round(F.col("blk.d").cast("double"), 9).alias("d"),
                    F.array_join(F.col("blk.codes").cast("array<string>"), ",").alias("codes"))


def wide_rows(spark, sf_dir):
    """Rows of up to 256 values: the vectors of four consecutive ids."""
    e = t(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("g"), F.struct("vec_id", "embedding").alias("x"))
    return e.groupBy("g").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["embedding"])).alias("embedding"))


def roundtrip(spark, sf_dir):
    """Every format over the 256-wide rows, and a ternary one over the 64-wide
    rows, which it does not fit."""
    wide = VQ.quant_errors(wide_rows(spark, sf_dir).select("embedding"), "embedding", list(ROUNDTRIP_TYPES))
    narrow = VQ.quant_errors(t(spark, sf_dir, "embeddings").select("embedding"), "embedding", ["TQ2_0"])
    u = wide.unionByName(narrow.withColumn("requested", F.lit("TQ2_0 narrow")))
    return u.groupBy("requested", "qtype").agg(
        F.count(F.lit(1)).cast("bigint").alias("rows"), F.sum("n_bytes").cast("bigint").alias("bytes"),
        F.round(F.avg("rmse"), 9).alias("avg_rmse"), F.round(F.max("max_abs_err"), 9).alias("max_abs_err"))


# Special floats and what stands around them in a row (the vector's values or zeros).
SPECIALS = (("nan", "NaN", False), ("inf", "Infinity", False), ("-inf", "-Infinity", False), ("-0", "-0.0", False), ("least", "1e-45", False),
            ("most", "3.4e38", False), ("tiny alone", "1e-42", True), ("least alone", "1e-45", True), ("zero alone", "0.0", True), ("two most", "3e38", False))


def special_values(spark, sf_dir):
    """Q0-Q8: every special float in a 256-wide row through every format: the
    bytes of the plain formats' first value, and NaN and infinite values that
    come back. The last case has a value of the other sign beside it."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    k = F.pmod("vec_id", F.lit(len(SPECIALS))).cast("int") + 1
    first = F.element_at(F.array(*[F.lit(v).cast("float") for _, v, _ in SPECIALS]), k)
    zeros = F.element_at(F.array(*[F.lit(z) for *_, z in SPECIALS]), k)
    name = F.element_at(F.array(*[F.lit(n) for n, *_ in SPECIALS]), k)
    row = F.transform(F.flatten(F.array_repeat("embedding", 4)), lambda v, i: F.when(i == 0, F.col("first"))
                      .when((i == 1) & (F.col("special") == "two most"), -F.col("first")).when(F.col("zeros"), F.lit(0.0).cast("float")).otherwise(v))
    rows = e.select("embedding", name.alias("special"), first.alias("first"), zeros.alias("zeros")).select("special", row.alias("embedding"))
    r = VQ.quant_errors(rows, "embedding", list(ROUNDTRIP_TYPES))
    one = F.slice("embedding", 1, 1)
    head = F.lit(None).cast("string")
    for q in ("F32", "F16", "BF16"):
        head = F.when(F.col("requested") == q, F.hex(VQ.packed_bytes(one, q))).otherwise(head)
    return r.groupBy("requested", "special", head.alias("head")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n_nan").cast("bigint").alias("n_nan"), F.sum("n_inf").cast("bigint").alias("n_inf"))


def compare(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding",
        F.transform("embedding", lambda v: F.round(v.cast("double"), 2).cast("float")).alias("coarse"))
    a = VQ.quantize_column(e, "embedding", "Q8_0", "pa")
    b = VQ.quantize_column(a, "coarse", "Q8_0", "pb")
    c = VQ.compare_blocks(b, "pa", "pb", 34)
    a = c.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
              F.sum("n_blocks").cast("bigint").alias("blocks"),
              F.sum("bad_blocks").cast("bigint").alias("bad_blocks"),
              F.sum("diff_bits").cast("bigint").alias("diff_bits"),
              F.max_by(F.struct("vec_id", "worst_block", "worst_bits"),
                       F.struct("worst_bits", F.col("vec_id") * -1)).alias("w"))
    return a.select("rows", "blocks", "bad_blocks", "diff_bits", F.col("w.vec_id").alias("worst_vec_id"),
                    F.col("w.worst_block").alias("worst_block"), F.col("w.worst_bits").alias("worst_bits"))


def roundtrip_values(spark, sf_dir):
    """Decoded values of the Q4_1 round trip, checked element-wise in tests."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = VQ.quantize_column(e, "embedding", "Q4_1", "p")
    d = VQ.dequantize_column(q, "p", "p_type", "back")
    return d.select("vec_id", "p_type", F.length("p").alias("n_bytes"),
                    F.round(F.aggregate(F.zip_with("embedding", "back", lambda x, y: F.abs(x - y).cast("double")),
                                        F.lit(0.0), lambda acc, v: F.greatest(acc, v)), 9).alias("max_abs_err"))


def scaled(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", VQ.q8_0_codes(F.col("embedding")).alias("b"))
    s = e.select("vec_id", "embedding", F.transform("b", lambda x: x["d"]).alias("scales"))
    v = VQ.dequant_scaled(F.col("embedding"), F.col("scales"), 32)
    return s.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("checksum"),
                    F.size(v).alias("n"))


def _codes4(col):
    """4-bit codes of an embedding: clip(round(x * 7) + 8, 0, 15)."""
    return F.transform(col, lambda v: F.least(F.greatest(F.round(v.cast("double") * 7, 0).cast("int") + 8, F.lit(0)), F.lit(15)))


def _pack4(codes):
    """Pack 4-bit codes, 8 per 32-bit word (lowest field first), as unsigned
    values in BIGINT."""
    nw = F.floor((F.size(codes) + 7) / 8).cast("int")
    return let(codes, lambda c: F.transform(F.sequence(F.lit(0), nw - 1), lambda w: F.aggregate(
        F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"),
        lambda acc, j: acc + F.coalesce(F.get(c, w * 8 + j), F.lit(0)).cast("bigint") * F.pow(F.lit(16.0), j).cast("bigint"))))


def packed_int(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = e.select("vec_id", F.size("embedding").alias("width"), _pack4(_codes4(F.col("embedding"))).alias("words"))
    deq = VQ.dequant_packed_int(F.col("words"), F.array(F.lit(0.125).cast("float"), F.lit(0.25).cast("float")),
                                4, 32, F.col("width"))
    return p.select("vec_id", F.round(F.aggregate(deq, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("checksum"),
                    F.size(deq).alias("n"))


def grouped(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    width = F.size("embedding")
    zeros = F.array(*[((F.col("label") + k) % 16) for k in range(4)])
    p = e.select("vec_id", width.alias("width"), _pack4(_codes4(F.col("embedding"))).alias("codes"),
                 _pack4(zeros).alias("zw"),
                 F.array(*[F.lit(s).cast("float") for s in (0.5, 0.25, 0.125, 0.0625)]).alias("scales"),
                 F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.floor(i / 16).cast("int")).alias("gidx"))
    deq = VQ.dequant_grouped(F.col("codes"), F.col("zw"), F.col("scales"), F.col("gidx"), 4, F.col("width"),
                             format_v1=True)
    return p.select("vec_id", F.round(F.aggregate(deq, F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("checksum"))


#: Rows of a stand-in tensor; its kind follows from its number.
TENSOR_ROWS = 5
TENSOR_KINDS = ("fp8", "channel", "bitnet", "gptq", "packed", "packed zeros", "plain")


def companion_parts(spark, sf_dir):
    """``(parts, config)``: five vectors each are one tensor, stored as its
    kind's parts; packed and grouped ones hold four-bit codes, 61 to a row."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    k = F.pmod(F.floor(F.col("vec_id") / TENSOR_ROWS), F.lit(len(TENSOR_KINDS))).cast("int")
    e = e.select(F.floor(F.col("vec_id") / TENSOR_ROWS).alias("model"), (F.col("vec_id") % TENSOR_ROWS).alias("r"), "label", "embedding",
                 F.element_at(F.array(*[F.lit(x) for x in TENSOR_KINDS]), k + 1).alias("kind"), F.slice(_codes4(F.col("embedding")), 1, 61).alias("codes"))
    double = lambda c: c.cast("array<double>")

    def row(name, row_no, values):
        return F.struct(F.lit(f"blk.0.ffn{name}").alias("name"), row_no.cast("bigint").alias("row"), double(values).alias("values"))

    r = F.col("r")
    own = (F.when(F.col("kind") == "fp8", F.array(row(".weight", r, F.col("embedding"))))
           .when(F.col("kind") == "channel", F.array(row(".weight", r, F.col("embedding")), row(".weight_scale", r, F.array((r + 1) / 8))))
           .when(F.col("kind") == "bitnet", F.array(row(".weight", r, F.transform("codes", lambda c: sum(F.pmod(c + j, F.lit(3)) * 4 ** j for j in range(4))))))
           .when(F.col("kind").startswith("packed"), F.array(row(".weight_packed", r, _pack4(F.col("codes"))),
                                                             row(".weight_scale", r, F.array(*[(r + g + 1) / 16 for g in range(4)]))))
           .when(F.col("kind") == "plain", F.array(row(".weight", r, F.col("embedding")))).otherwise(F.array()))
    parts = e.select("model", F.explode(own).alias("x")).select("model", "x.*")

    # what belongs to the tensor as a whole: gathered from its few rows
    whole = e.groupBy("model", "kind").agg(F.sort_array(F.collect_list(F.struct("r", "label", _pack4(F.col("codes")).alias("words")))).alias("v"))
    fp8 = [row(".weight_scale_inv", F.lit(i), F.array(*[F.lit(0.5 * (i + 1) + 0.25 * j) for j in range(2)])) for i in range(3)]

    def each(of):
        return lambda n: F.transform("v", lambda x: of(x, n))

    zero = each(lambda x, g: F.pmod(x["label"] + x["r"] + g, F.lit(16)))
    stored = each(lambda x, g: F.pmod(x["label"] + x["r"] + g, F.lit(15)))
    scale = each(lambda x, g: (x["r"] + g + 1) / 16)
    word = each(lambda x, w: x["words"][w])
    grouped = [row(".scales", F.lit(g), scale(g)) for g in range(4)] + [row(".qzeros", F.lit(g), _pack4(stored(g))) for g in range(4)]
    grouped += [row(".qweight", F.lit(w), word(w)) for w in range(8)]
    grouped += [row(".g_idx", F.lit(0), F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.pmod(i * 3, F.lit(4))))]
    shape = row(".weight_shape", F.lit(0), F.array(F.size("v"), F.lit(61)))
    more = (F.when(F.col("kind") == "fp8", F.array(*fp8)).when(F.col("kind") == "bitnet", F.array(row(".weight_scale", F.lit(0), F.array(F.lit(4.0)))))
            .when(F.col("kind") == "gptq", F.array(*grouped)).when(F.col("kind") == "packed", F.array(shape))
            .when(F.col("kind") == "packed zeros", F.array(shape, row(".weight_zero_point", F.lit(0), F.flatten(F.array(*[_pack4(zero(g)) for g in range(4)]))))).otherwise(F.array()))
    parts = parts.unionByName(whole.select("model", F.explode(more).alias("x")).select("model", "x.*"))
    config = whole.select("model", F.col("kind").alias("method"), F.lit(4).alias("bits"), F.lit(16).alias("group_size"),
                          F.when(F.col("kind") == "fp8", 2).alias("block_rows"), F.when(F.col("kind") == "fp8", 48).alias("block_cols"), F.lit(True).alias("format_v1"))
    return parts, config


def companion_values(spark, sf_dir):
    """J11 with Q9, Q10, Q12: from stored parts to float rows, every kind."""
    d = CO.dequantize_companions(*companion_parts(spark, sf_dir))
    total = F.aggregate(F.transform("values", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("model", "name", "row", "origin", F.size("values").alias("n"), F.round(total, 4).alias("checksum"))


_SQL_CODE = "least(greatest(CAST(round(embedding[i + 1]::DOUBLE * 7) AS INTEGER) + 8, 0), 15)"
SQL_COMPANION_VALUES = f"""
WITH e AS (
  SELECT vec_id // {TENSOR_ROWS} AS model, vec_id % {TENSOR_ROWS} AS r, label, embedding, {list(TENSOR_KINDS)}[(vec_id // {TENSOR_ROWS}) % {len(TENSOR_KINDS)} + 1] AS kind,
    count(*) OVER (PARTITION BY vec_id // {TENSOR_ROWS}) AS n_rows FROM embeddings),
x AS (SELECT *, unnest(range(CASE WHEN kind IN ('fp8', 'channel', 'plain') THEN 64 ELSE 61 END)) AS i FROM e),
c AS (SELECT *, CASE WHEN i < 61 THEN {_SQL_CODE} END AS code FROM x),
v AS (
  SELECT model, r AS row, 'fp8_scale_inv' AS origin, i, CAST(embedding[i + 1] * CAST(0.5 * (r // 2 + 1) + 0.25 * (i // 48) AS FLOAT) AS FLOAT) AS v FROM c WHERE kind = 'fp8'
  UNION ALL SELECT model, r, 'scaled', i, CAST(embedding[i + 1] * CAST((r + 1) / 8 AS FLOAT) AS FLOAT) FROM c WHERE kind = 'channel'
  UNION ALL SELECT model, j * n_rows + r, 'scaled', i, ((code + j) % 3 - 1) / 4 FROM c, range(4) t(j) WHERE kind = 'bitnet'
  UNION ALL SELECT model, r, 'gptq', i, (code - ((label + r + (i * 3) % 4) % 15) - 1) * (r + (i * 3) % 4 + 1) / 16 FROM c WHERE kind = 'gptq'
  UNION ALL SELECT model, r, 'packed', i, (code - CASE WHEN kind = 'packed' THEN 8 ELSE (label + r + i // 16) % 16 END) * (r + i // 16 + 1) / 16 FROM c WHERE starts_with(kind, 'packed')
  UNION ALL SELECT model, r, 'kept', i, embedding[i + 1] FROM c WHERE kind = 'plain')
SELECT model, 'blk.0.ffn.weight' AS name, row, origin, CAST(count(*) AS INTEGER) AS n, round(sum(v::DOUBLE * (i + 1)), 4) AS checksum
FROM v GROUP BY model, row, origin"""

SQL_Q8_CODES = """
WITH x AS (SELECT vec_id, b AS block, embedding[b * 32 + 1: b * 32 + 32] AS v FROM embeddings, range(0, 2) r(b)),
d AS (SELECT vec_id, block, v, CAST(list_max(list_transform(v, lambda y: abs(y)))::DOUBLE / 127.0 AS FLOAT) AS d FROM x),
i AS (SELECT *, CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE CAST(1.0 / d::DOUBLE AS FLOAT) END AS inv FROM d)
SELECT vec_id, CAST(block AS INTEGER) AS block, round(d::DOUBLE, 9) AS d,
       array_to_string(list_transform(v, lambda y: CAST(sign(CAST(y * inv AS FLOAT)) * (floor(abs(CAST(y * inv AS FLOAT)))
             + floor(2 * (abs(CAST(y * inv AS FLOAT)) - floor(abs(CAST(y * inv AS FLOAT)))))) AS INTEGER)), ',') AS codes
FROM i"""

SQL_SCALED = """
WITH x AS (SELECT vec_id, b AS block, embedding[b * 32 + 1: b * 32 + 32] AS v FROM embeddings, range(0, 2) r(b)),
d AS (SELECT vec_id, block, v, CAST(list_max(list_transform(v, lambda y: abs(y)))::DOUBLE / 127.0 AS FLOAT) AS d FROM x),
p AS (SELECT vec_id, block, list_transform(v, lambda y: CAST(y * d AS FLOAT)::DOUBLE) AS w FROM d)
SELECT vec_id, round(list_reduce(flatten(list(w ORDER BY block)), lambda a, b: a + b), 6) AS checksum, 64 AS n
FROM p GROUP BY vec_id"""

_SQL_CODES4 = "list_transform(embedding, lambda v: least(greatest(CAST(round_half_away(v::DOUBLE * 7) AS INTEGER) + 8, 0), 15))"

SQL_PACKED_INT = f"""
WITH c AS (SELECT vec_id, {_SQL_CODES4.replace('round_half_away', 'round')} AS q FROM embeddings)
SELECT vec_id, round(list_reduce(list_transform(range(1, len(q) + 1), lambda i: CAST((q[i] - 8)
       * CASE WHEN (i - 1) // 32 = 0 THEN 0.125 ELSE 0.25 END AS FLOAT)::DOUBLE), lambda a, b: a + b), 6) AS checksum,
       CAST(len(q) AS INTEGER) AS n
FROM c"""

SQL_GROUPED = f"""
WITH c AS (SELECT vec_id, label, {_SQL_CODES4.replace('round_half_away', 'round')} AS q FROM embeddings)
SELECT vec_id, round(list_reduce(list_transform(range(1, len(q) + 1), lambda i: CAST(CAST(q[i] - (((label + (i - 1) // 16) % 16) + 1) AS FLOAT)
       * CAST([0.5, 0.25, 0.125, 0.0625][(i - 1) // 16 + 1] AS FLOAT) AS FLOAT)::DOUBLE), lambda a, b: a + b), 6) AS checksum
FROM c"""

# Q4_1 round trip in SQL: float32 arithmetic via FLOAT casts, the stored
# scale and minimum rounded to float16 (round-half-even on the binade grid).
SQL_Q4_1 = """
WITH x AS (SELECT vec_id, b AS block, embedding[b * 32 + 1: b * 32 + 32] AS v FROM embeddings, range(0, 2) r(b)),
s AS (SELECT vec_id, block, v, list_max(v) AS hi, list_min(v) AS lo FROM x),
d AS (SELECT *, CAST((hi - lo)::DOUBLE / 15.0 AS FLOAT) AS d FROM s),
i AS (SELECT *, CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE CAST(1.0 / d::DOUBLE AS FLOAT) END AS id FROM d),
h AS (
  SELECT *,
    list_transform([d::DOUBLE, lo::DOUBLE], lambda a:
      CASE WHEN a = 0 THEN 0.0 ELSE sign(a) * (
        CASE WHEN abs(a) < pow(2.0, -14) THEN round_even(abs(a) / pow(2.0, -24), 0) * pow(2.0, -24)
        ELSE round_even(abs(a) / pow(2.0, (floor(log2(abs(a)))
                 - CASE WHEN pow(2.0, floor(log2(abs(a)))) > abs(a) THEN 1 ELSE 0 END
                 + CASE WHEN pow(2.0, floor(log2(abs(a))) + 1) <= abs(a) THEN 1 ELSE 0 END) - 10), 0)
             * pow(2.0, (floor(log2(abs(a)))
                 - CASE WHEN pow(2.0, floor(log2(abs(a)))) > abs(a) THEN 1 ELSE 0 END
                 + CASE WHEN pow(2.0, floor(log2(abs(a))) + 1) <= abs(a) THEN 1 ELSE 0 END) - 10) END) END) AS f16
  FROM i),
q AS (
  SELECT vec_id, block, v, CAST(f16[1] AS FLOAT) AS d16, CAST(f16[2] AS FLOAT) AS m16,
         list_transform(v, lambda y: CAST(least(greatest(trunc(CAST(CAST((y - lo) AS FLOAT) * id AS FLOAT) + CAST(0.5 AS FLOAT)), 0), 15) AS FLOAT)) AS qs
  FROM h),
e AS (
  SELECT vec_id, list_max(list_transform(range(1, 33), lambda k:
           abs(CAST(v[k] - CAST(CAST(d16 * qs[k] AS FLOAT) + m16 AS FLOAT) AS FLOAT))::DOUBLE)) AS err
  FROM q)
SELECT vec_id, 'Q4_1' AS p_type, CAST(40 AS INTEGER) AS n_bytes, round(max(err), 9) AS max_abs_err FROM e GROUP BY vec_id"""

# Block comparison in SQL: Q8_0 blocks rebuilt as float16 scale bits plus
# int8 code bytes, then XOR popcounts per block.
SQL_COMPARE_BLOCKS = """
WITH src AS (
  SELECT vec_id, embedding AS a, list_transform(embedding, lambda v: CAST(round(v::DOUBLE, 2) AS FLOAT)) AS c FROM embeddings),
sides AS (SELECT vec_id, 0 AS side, a AS e FROM src UNION ALL SELECT vec_id, 1, c FROM src),
x AS (SELECT vec_id, side, b AS block, e[b * 32 + 1: b * 32 + 32] AS v FROM sides, range(0, 2) r(b)),
d AS (SELECT *, CAST(list_max(list_transform(v, lambda y: abs(y)))::DOUBLE / 127.0 AS FLOAT) AS d FROM x),
i AS (SELECT *, CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE CAST(1.0 / d::DOUBLE AS FLOAT) END AS inv,
             CASE WHEN d = 0 THEN 0 ELSE floor(log2(d::DOUBLE))
                  - CASE WHEN pow(2.0, floor(log2(d::DOUBLE))) > d::DOUBLE THEN 1 ELSE 0 END
                  + CASE WHEN pow(2.0, floor(log2(d::DOUBLE)) + 1) <= d::DOUBLE THEN 1 ELSE 0 END END AS ex
      FROM d),
h AS (
  SELECT *, CASE WHEN d = 0 THEN 0.0
                 WHEN ex < -14 THEN round_even(d::DOUBLE / pow(2.0, -24), 0) * pow(2.0, -24)
                 ELSE round_even(d::DOUBLE / pow(2.0, ex - 10), 0) * pow(2.0, ex - 10) END AS r16
  FROM i),
b AS (
  SELECT vec_id, side, block,
         CASE WHEN r16 = 0 THEN 0
              WHEN r16 < pow(2.0, -14) THEN CAST(r16 / pow(2.0, -24) AS BIGINT)
              ELSE (CAST(floor(log2(r16)) + 15 AS BIGINT) << 10)
                   + CAST((r16 / pow(2.0, floor(log2(r16))) - 1) * 1024 AS BIGINT) END AS dbits,
         list_transform(v, lambda y: CAST(sign(CAST(y * inv AS FLOAT)) * (floor(abs(CAST(y * inv AS FLOAT)))
             + floor(2 * (abs(CAST(y * inv AS FLOAT)) - floor(abs(CAST(y * inv AS FLOAT)))))) AS BIGINT) & 255) AS codes
  FROM h),
j AS (
  SELECT p.vec_id, p.block,
         bit_count(xor(p.dbits, q.dbits)) + list_sum(list_transform(range(1, 33),
             lambda k: bit_count(xor(p.codes[k], q.codes[k])))) AS bits
  FROM b p JOIN b q ON p.vec_id = q.vec_id AND p.block = q.block AND p.side = 0 AND q.side = 1),
r AS (
  SELECT vec_id, sum(CASE WHEN bits > 0 THEN 1 ELSE 0 END) AS bad, sum(bits) AS bits, max(bits) AS worst_bits,
         arg_min(block, (-bits, block)) AS wb FROM j GROUP BY vec_id)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(2 * count(*) AS BIGINT) AS blocks, CAST(sum(bad) AS BIGINT) AS bad_blocks,
       CAST(sum(bits) AS BIGINT) AS diff_bits,
       arg_max(vec_id, (worst_bits, -vec_id)) AS worst_vec_id,
       CAST(arg_max(CASE WHEN worst_bits > 0 THEN wb END, (worst_bits, -vec_id)) AS INTEGER) AS worst_block,
       CAST(max(worst_bits) AS INTEGER) AS worst_bits
FROM r"""


def _sql_grid(x: str, mantissa: int, least: int) -> str:
    """``x`` rounded half to even on a floating grid."""
    step = f"pow(2.0, greatest(floor(log2(abs({x}::DOUBLE))), {least}) - {mantissa})"
    return f"CAST(CASE WHEN {x} = 0 THEN 0 ELSE round_even({x}::DOUBLE / {step}, 0) * {step} END AS FLOAT)"


def _sql_half(x: str) -> str:
    return _sql_grid(x, 10, -14)


def _sql_round_away(x: str) -> str:
    return f"sign({x}) * (floor(abs({x}::DOUBLE)) + floor(2 * (abs({x}::DOUBLE) - floor(abs({x}::DOUBLE)))))"


def _sql_roundtrip() -> str:
    """One SELECT per format: parameters per block, decoded values, errors."""
    absmax = "list_max(list_transform(v, lambda y: abs(y)))"
    extreme = f"list_filter(v, lambda y: abs(y) = {absmax})[1]"
    inv = "CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE CAST(1.0 / d::DOUBLE AS FLOAT) END"
    f = "CAST({} AS FLOAT)".format
    trunc = lambda x, top: f"CAST(least(trunc({x}), {top}) AS FLOAT)"
    points = "[" + ", ".join(f"CAST({k} AS FLOAT)" for k in E2M1_DOUBLED) + "]"
    err = f"list_transform({points}, lambda k: abs({f(f('d * k') + ' - y')}))"
    rules = {  # scale, offset, decoded value of y
        "Q8_0": (f(f"{absmax}::DOUBLE / 127"), "0", f(f"{_sql_half('d')} * CAST({_sql_round_away(f('y * i'))} AS FLOAT)")),
        "TQ1_0": (absmax, "0", f(f"{_sql_half('d')} * CAST({_sql_round_away(f('y * i'))} AS FLOAT)")),
        "TQ2_0": (absmax, "0", f(f"{_sql_half('d')} * CAST({_sql_round_away(f('y * i'))} AS FLOAT)")),
        "MXFP4": (f(f"CASE WHEN {absmax} > 0 THEN pow(2.0, floor(log2({absmax}::DOUBLE)) - 3) ELSE pow(2.0, -128) END"), "0",
                  f(f"d * {points}[list_position({err}, list_min({err}))]")),
    }
    for name, mid in (("Q4_0", 8), ("Q5_0", 16)):
        rules[name] = (f(f"{extreme}::DOUBLE / -{mid}"), "0",
                       f(f"{_sql_half('d')} * ({trunc(f(f('y * i') + f' + CAST({mid}.5 AS FLOAT)'), 2 * mid - 1)} - {mid})"))
    for name, top in (("Q4_1", 15), ("Q5_1", 31)):
        rules[name] = (f(f"(list_max(v) - list_min(v))::DOUBLE / {top}"), "list_min(v)",
                       f(f("%s * %s" % (_sql_half("d"), trunc(f(f(f("y - m") + " * i") + " + CAST(0.5 AS FLOAT)"), top))) + " + " + _sql_half("m")))
    plain = {"F32": "y", "F16": _sql_half("y"), "BF16": _sql_grid("y", 7, -126)}
    selects = []
    for label, source in [*[(q, "wide") for q in ROUNDTRIP_TYPES], ("TQ2_0 narrow", "narrow")]:
        q = label.split()[0]
        size, width = LAYOUT[q]
        fits = f"len(e) % {size} = 0"
        if q in plain:
            values = f"SELECT r, e, list_transform(e, lambda y: {plain[q]}) AS w FROM {source}"
        else:
            d, m, value = rules[q]
            values = f"""SELECT r, any_value(e) AS e, flatten(list(w ORDER BY b)) AS w FROM (
  SELECT r, b, e, list_transform(v, lambda y: {value}) AS w FROM (
    SELECT *, {inv} AS i FROM (SELECT r, b, e, v, {d} AS d, {f(m)} AS m FROM (
      SELECT r, e, b, e[b * {size} + 1 : b * {size} + {size}] AS v FROM (SELECT r, e, unnest(range(len(e) // {size})) AS b FROM {source} WHERE {fits}))))) GROUP BY r
UNION ALL SELECT r, e, list_transform(e, lambda y: {plain["F16"]}) FROM {source} WHERE NOT {fits}"""
        selects.append(f"""SELECT '{label}' AS requested, CASE WHEN {fits} THEN '{q}' ELSE 'F16' END AS qtype,
  CASE WHEN {fits} THEN len(e) // {size} * {width} ELSE len(e) * 2 END AS n_bytes,
  list_transform(list_zip(w, e), lambda p: p[1]::DOUBLE - p[2]::DOUBLE) AS err FROM ({values})""")
    return """WITH wide AS MATERIALIZED (SELECT vec_id // 4 AS r, flatten(list(embedding ORDER BY vec_id)) AS e FROM embeddings GROUP BY 1),
narrow AS (SELECT vec_id AS r, embedding AS e FROM embeddings),
u AS (""" + "\nUNION ALL\n".join(selects) + """)
SELECT requested, qtype, count(*) AS rows, CAST(sum(n_bytes) AS BIGINT) AS bytes,
  round(avg(sqrt(list_sum(list_transform(err, lambda x: x * x)) / len(err))), 9) AS avg_rmse,
  round(max(list_max(list_transform(err, lambda x: abs(x)))), 9) AS max_abs_err
FROM u GROUP BY requested, qtype"""


# Bytes of a special float in the plain formats (F32, F16, BF16), and per format the NaN
# and infinite values of a row that come back (where there are any).
_SQL_HEADS = {"nan": ("0000C07F", "007E", "C07F"), "inf": ("0000807F", "007C", "807F"), "-inf": ("000080FF", "00FC", "80FF"), "-0": ("00000080", "0080", "0080"),
              "least": ("01000000", "0000", "0000"), "most": ("9EC97F7F", "007C", "807F"), "tiny alone": ("CA020000", "0000", "0000"),
              "least alone": ("01000000", "0000", "0000"), "zero alone": ("00000000", "0000", "0000"), "two most": ("E6B1617F", "007C", "627F")}
_SQL_LOST = {
    "nan": {"F32": (1, 0), "F16": (1, 0), "BF16": (1, 0), "Q8_0": (32, 0), "Q4_0": (32, 0), "Q4_1": (32, 0), "Q5_0": (32, 0), "Q5_1": (32, 0), "TQ1_0": (256, 0), "TQ2_0": (256, 0)},
    "inf": {"F32": (0, 1), "F16": (0, 1), "BF16": (0, 1), "Q8_0": (32, 0), "Q4_0": (31, 1), "Q4_1": (32, 0), "Q5_0": (31, 1), "Q5_1": (32, 0), "TQ1_0": (256, 0), "TQ2_0": (256, 0)},
    "most": {"F16": (0, 1), "BF16": (0, 1), "Q8_0": (31, 1), "Q4_0": (31, 1), "Q4_1": (31, 1), "Q5_0": (31, 1), "Q5_1": (31, 1), "TQ1_0": (255, 1), "TQ2_0": (255, 1)},
    "two most": {"F16": (0, 2), "Q8_0": (30, 2), "Q4_0": (30, 2), "Q4_1": (32, 0), "Q5_0": (30, 2), "Q5_1": (32, 0), "TQ1_0": (254, 2), "TQ2_0": (254, 2)},
}
_SQL_LOST["-inf"] = _SQL_LOST["inf"]


def _sql_special() -> str:
    rows = []
    for i, (name, *_) in enumerate(SPECIALS):
        for q in ROUNDTRIP_TYPES:
            head = f"'{_SQL_HEADS[name][('F32', 'F16', 'BF16').index(q)]}'" if q in ("F32", "F16", "BF16") else "NULL"
            rows.append(f"({i}, '{name}', '{q}', {head}, {', '.join(map(str, _SQL_LOST.get(name, {}).get(q, (0, 0))))})")
    return f"""WITH g(i, special, requested, head, nans, infs) AS (VALUES {', '.join(rows)})
SELECT requested, special, head, count(*) AS rows, CAST(sum(nans) AS BIGINT) AS n_nan, CAST(sum(infs) AS BIGINT) AS n_inf
FROM embeddings e JOIN g ON e.vec_id % {len(SPECIALS)} = g.i GROUP BY requested, special, head"""


QUERIES = {
    "vec_dequant_companions": (companion_values, SQL_COMPANION_VALUES),
    "vec_quant_special": (special_values, _sql_special()),
    "vec_q8_0_codes": (q8_codes, SQL_Q8_CODES),
    "vec_quant_roundtrip": (roundtrip, _sql_roundtrip()),
    "vec_compare_blocks": (compare, SQL_COMPARE_BLOCKS),
    "vec_dequantize_q4_1": (roundtrip_values, SQL_Q4_1),
    "vec_dequant_scaled": (scaled, SQL_SCALED),
    "vec_dequant_packed_int": (packed_int, SQL_PACKED_INT),
    "vec_dequant_grouped": (grouped, SQL_GROUPED),
}
