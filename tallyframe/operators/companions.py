"""J11 -> Q9, Q10, Q12: companion tensors with their payloads, merged into
float values by kind.

Tensors come as rows: ``(model, name, row, values)``, one per first-axis index,
so no tensor is ever one cell. The names are grouped and classified
(``companions``), and each kind joins the rows of its parts that belong
together: a weight row with its scale row (or block of rows), a packed row with
its scale, shape and the packed zero points of its row. Grouped (GPTQ) weights
are packed along their second axis, so they come out transposed; there the
elements are exploded once and gathered per output row, which is as wide as the
tensor. Everything is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.catalog import COMPANION_SUFFIXES, companions
from tallyframe.session import materialize

CONFIG = "model bigint, method string, bits int, group_size int, block_rows int, block_cols int, format_v1 boolean"


def _field(word: Column, at: Column, bits: Column) -> Column:
    """Field ``at`` of ``bits`` width of a 32-bit word (signed or not)."""
    shifted = F.call_function("shiftrightunsigned", word.cast("bigint").bitwiseAND(F.lit((1 << 32) - 1)), (at * bits).cast("int"))
    return shifted.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)


def _times(values: Column, factor) -> Column:
    return F.transform(values, lambda v, i: (v.cast("float") * factor(i).cast("float")).cast("float"))


def dequantize_companions(parts: DataFrame, config: DataFrame) -> DataFrame:
    """``(model, name, row, values, origin)``: every merged tensor's float rows
    under ``<base>.weight`` with its kind as ``origin``, and the rows of all
    other tensors as they are (``kept``).

    ``parts`` has ``model, name, row, values`` (``ARRAY<DOUBLE>``; packed words
    signed or unsigned); ``config`` one row per model: ``bits`` and
    ``group_size`` of packed and grouped weights, ``block_rows`` and
    ``block_cols`` of block scales (null: a scale per row, or one for all),
    ``method`` (``bitnet``: two-bit rows under ``scaled``, divided by the
    scale), ``format_v1`` (stored zero points are one less). Widths need not
    fill their words, groups or blocks; padding is trimmed. 3-bit grouped
    weights have no rows. Parts that a kind does not use are kept.
    """
    parts = materialize(parts, "companion-parts")
    names = parts.select("model", "name").distinct()
    kinds = companions(names).select("model", "base", "kind")
    alts = "|".join(s.replace(".", r"\.") for s in COMPANION_SUFFIXES)
    part = F.regexp_extract("name", f"({alts})$", 1)
    p = parts.withColumn("part", part).withColumn("base", F.when(part != "", F.substring("name", F.lit(1), F.length("name") - F.length(part))).otherwise(F.col("name")))
    p = materialize(p.join(kinds, ["model", "base"]), "companions")  # every kind reads its own rows of it
    cfg = config.select("model", "method", "bits", "group_size", "block_rows", "block_cols", F.coalesce("format_v1", F.lit(False)).alias("format_v1"))

    def rows(kind: str, suffix: str, values: str, row: str = "row") -> DataFrame:
        return p.where((F.col("kind") == kind) & (F.col("part") == suffix)).select("model", "base", F.col("row").alias(row), F.col("values").alias(values))

    def whole(d: DataFrame) -> DataFrame:
        return d.join(cfg, "model")

    def merged(d: DataFrame, row: Column, values: Column, kind: str) -> DataFrame:
        return d.select("model", F.concat("base", F.lit(".weight")).alias("name"), row.cast("bigint").alias("row"), values.cast("array<float>").alias("values"), F.lit(kind).alias("origin"))

    out = []
    for kind, suffix in (("fp8_scale_inv", ".weight_scale_inv"), ("scaled", ".weight_scale")):
        scale = rows(kind, suffix, "s", "s_row")
        n_scale = scale.groupBy("model", "base").agg(F.count(F.lit(1)).alias("n_scale"))
        w = whole(rows(kind, ".weight", "w")).join(n_scale, ["model", "base"])
        at = F.when(F.col("n_scale") == 1, F.lit(0)).when(F.col("block_rows").isNotNull(), F.floor(F.col("row") / F.col("block_rows"))).otherwise(F.col("row"))
        w = w.withColumn("s_row", at.cast("bigint")).join(scale, ["model", "base", "s_row"])
        column = lambda i: F.when(F.size("s") == 1, F.lit(0)).when(F.col("block_cols").isNotNull(), F.floor(i / F.col("block_cols"))).otherwise(i).cast("int")
        plain = w.where(~F.coalesce(F.col("method") == "bitnet", F.lit(False)))
        out.append(merged(plain, F.col("row"), _times(F.col("w"), lambda i: F.get("s", column(i))), kind))
        if kind == "scaled":  # four rows in one, the scale divides
            bits = w.where(F.col("method") == "bitnet")
            size = rows(kind, ".weight", "w").groupBy("model", "base").agg(F.count(F.lit(1)).alias("n_rows"))
            bits = bits.join(size, ["model", "base"]).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
            ternary = F.transform("w", lambda v, i: ((_field(v, F.col("k"), F.lit(2)) - 1).cast("float") / F.get("s", column(i)).cast("float")).cast("float"))
            out.append(merged(bits, F.col("k") * F.col("n_rows") + F.col("row"), ternary, kind))

    per = F.floor(F.lit(32) / F.col("bits")).cast("int")
    shape = rows("packed", ".weight_shape", "shape", "__none").drop("__none")
    zero = rows("packed", ".weight_zero_point", "z", "z_row")
    d = whole(rows("packed", ".weight_packed", "w")).join(rows("packed", ".weight_scale", "s"), ["model", "base", "row"]).join(shape, ["model", "base"])
    d = d.withColumn("z_row", F.floor(F.col("row") / per)).join(zero, ["model", "base", "z_row"], "left").where(F.col("row") < F.get("shape", F.lit(0)))

    def unpacked(i: Column) -> Column:
        group = F.floor(i / F.col("group_size")).cast("int")
        code = _field(F.get("w", F.floor(i / per).cast("int")), F.pmod(i, per), F.col("bits"))
        given = _field(F.get("z", group), F.pmod(F.col("row"), per), F.col("bits"))
        middle = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits") - 1)
        return ((code - F.when(F.col("z").isNotNull(), given).otherwise(middle)).cast("float") * F.get("s", group).cast("float")).cast("float")

    width = F.get("shape", F.lit(1)).cast("int")
    out.append(merged(d, F.col("row"), F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), unpacked)).otherwise(F.array()), "packed"))

    # grouped: input ``i`` lies in word row i / per; its group's scales and zero points are rows as well
    g = whole(rows("gptq", ".qweight", "w", "w_row")).where(F.col("bits").isin(2, 4, 8)).withColumn("i", F.explode(F.transform(
        F.sequence(F.lit(0), per - 1), lambda j: F.col("w_row") * per + j)))
    index = rows("gptq", ".g_idx", "index", "__row").select("model", "base", F.posexplode("index").alias("i", "g_row"))
    g = g.join(index.select("model", "base", F.col("i").cast("bigint").alias("i"), F.col("g_row").cast("bigint").alias("g_row")), ["model", "base", "i"])
    g = g.join(rows("gptq", ".scales", "s", "g_row"), ["model", "base", "g_row"]).join(rows("gptq", ".qzeros", "z", "g_row"), ["model", "base", "g_row"])

    def grouped(s: Column, o: Column) -> Column:
        code = _field(F.get("w", o), F.pmod(F.col("i"), per), F.col("bits"))
        stored = _field(F.get("z", F.floor(o / per).cast("int")), F.pmod(o, per), F.col("bits"))
        return (s.cast("float") * (code - stored - F.when(F.col("format_v1"), 1).otherwise(0)).cast("float")).cast("float")

    cells = g.select("model", "base", "i", F.posexplode(F.transform("s", grouped)).alias("o", "v"))
    cells = cells.groupBy("model", "base", "o").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("line"))
    out.append(merged(cells, F.col("o"), F.transform("line", lambda x: x["v"]), "gptq"))

    used = {"fp8_scale_inv": (".weight", ".weight_scale_inv"), "scaled": (".weight", ".weight_scale"), "gptq": (".qweight", ".qzeros", ".scales", ".g_idx"),
            "packed": (".weight_packed", ".weight_shape", ".weight_scale", ".weight_zero_point")}
    gone = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("part").isin(*v) for k, v in used.items()])
    out.append(p.where(~gone).select("model", "name", F.col("row").cast("bigint").alias("row"), F.col("values").cast("array<float>").alias("values"), F.lit("kept").alias("origin")))
    return reduce(DataFrame.unionByName, out)
