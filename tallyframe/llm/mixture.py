"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source is clamped at its cap
(``max_epochs`` times its size), and what it cannot take goes to the others
in proportion to their weights until no target lies above its cap. A target
is met by whole repetitions of the source and a seeded fractional one: the
documents come in the order of a hash, and the part of that order whose words
fill the rest of the target is taken once more. Where that order is cut
follows from word sums per hash bucket, refined until the bucket that holds the
cut is small; no source is sorted as a whole. Equal rows share one hash: where
the cut falls among them, as many are taken as the rest needs, counted per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import space_words, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: The draw has 60 bits; each look names the bucket by 12 more of them, until
#: a bucket has at most so many rows.
BITS, STEP, SMALL = 60, 12, 50_000


def size_of(text: Column) -> Column:
    return F.size(space_words(text_of(text))).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Seeded 60-bit draw of a document, the same on every run and for equal
    ids and texts."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text_of(text)))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def water_fill(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``(source, total)``, one row per source.

    Weights repeat over the sources in code point order, null last. With the
    sources in the order of cap per weight, the water level is the largest of
    (budget - caps before) / (weights from here on). The windows run over one
    row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = totals.withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1))
    w = w.withColumn("cap", F.col("total") * max_epochs)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    w = w.withColumn("level", (F.sum("total").over(every) * share - before) / rest)
    w = w.withColumn("level", F.max("level").over(every))
    return w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).select("source", "total", "target")


def plan(narrow: DataFrame, **rule) -> DataFrame:
    """Per source: ``total``, ``target``, whole repetitions ``whole``, the
    largest draw ``cut`` that is taken once more as a whole (-1: none), and the
    draw ``split`` of which ``split_n`` rows are (null: none).

    ``narrow`` holds ``source, size, draw`` and is read several times (a
    written table). A row is taken where its middle lies below the target.
    """
    def summed(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
        bucket = F.shiftright("draw", shift).alias("bucket")
        return written(rows.groupBy(*keys, bucket).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-buckets")

    shift = BITS - STEP
    buckets = summed(narrow, ["source"], shift)
    targets = water_fill(buckets.groupBy("source").agg(F.sum("words").alias("total")), **rule)
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    t = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("total"))
    t = written(t.withColumnRenamed("source", "t_source"), "mix-targets")
    edge = t.select(F.col("t_source").alias("e_source"), "rest", F.lit(0).cast("long").alias("before"))
    while True:
        up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        inner = buckets.withColumn("inner", F.coalesce(F.sum("words").over(up), F.lit(0)))
        here = inner.join(edge, F.col("source").eqNullSafe(F.col("e_source"))).withColumn("before", F.col("before") + F.col("inner"))
        edge = written(here.where("rest > before and rest <= before + words").select("e_source", F.col("bucket").alias("e_bucket"), "before", "rest", "n"), "mix-edges")
        inside = narrow.join(edge.drop("n"), F.col("source").eqNullSafe(F.col("e_source")) & (F.shiftright("draw", shift) == F.col("e_bucket")))
        if shift == 0 or not edge.where(F.col("n") > SMALL).take(1):
            break
        shift -= STEP
        buckets = summed(inside, ["source"], shift)
        edge = edge.select("e_source", "rest", "before")
    inside = inside.groupBy("e_source", "before", "rest", "draw").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("e_source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    each = F.col("words") / F.col("n")  # rows of one draw have one size
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("words").over(up), F.lit(0))
    fits = F.when(each > 0, F.least(F.col("n"), F.greatest(F.lit(0), F.ceil(left / each - 0.5)))).otherwise(F.when(left > 0, F.col("n")).otherwise(0))
    inside = inside.withColumn("fits", fits)
    last = inside.groupBy("e_source").agg(F.max(F.when(F.col("fits") == F.col("n"), F.col("draw"))).alias("last"),
                                          F.max(F.when((F.col("fits") > 0) & (F.col("fits") < F.col("n")), F.struct("draw", "fits"))).alias("part"))
    start = edge.select(F.col("e_source").alias("s_source"), (F.shiftleft("e_bucket", shift) - 1).alias("start"))
    out = t.join(start, F.col("t_source").eqNullSafe(F.col("s_source")), "left").join(last, F.col("t_source").eqNullSafe(F.col("e_source")), "left")
    return out.select(F.col("t_source").alias("source"), "total", "target", "whole", F.coalesce("last", "start", F.lit(-1)).alias("cut"),
                      F.col("part.draw").alias("split"), F.col("part.fits").alias("split_n"))


def _planned(docs: DataFrame, text_col: str, id_col: str, source_col: str, rule: dict) -> tuple[DataFrame, DataFrame]:
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(text).alias("size"),
                         draw(F.col(f"`{id_col}`"), text).alias("draw"))
    narrow = written(narrow, "mix-rows")
    return narrow, written(plan(narrow, **rule), "mix-plan")


def _timed(rows: DataFrame, planned: DataFrame, source: str, draw_col: str) -> DataFrame:
    """``rows`` with ``__mix_times``. Rows of a split draw are numbered within
    the task that reads them, after the tasks before it; the others need no
    shuffle."""
    p = planned.select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("cut").alias("__mix_cut"),
                       F.col("split").alias("__mix_split"), F.col("split_n").alias("__mix_n"))
    rows = rows.join(p, F.col(source).eqNullSafe(F.col("__mix_source")))
    names = [c for c in rows.columns if c not in p.columns]
    at_split = F.coalesce(F.col(draw_col) == F.col("__mix_split"), F.lit(False))
    once = F.when(F.col(draw_col) <= F.col("__mix_cut"), 1).otherwise(0)
    plain = rows.where(~at_split).select(*[f"`{c}`" for c in names], (F.col("__mix_whole") + once).alias("__mix_times"))
    if not planned.where("split is not null").take(1):
        return plain
    tied = written(rows.where(at_split).withColumn("__mix_part", F.spark_partition_id()), "mix-ties")
    counts = written(tied.groupBy("__mix_split", "__mix_part").agg(F.count(F.lit(1)).alias("__mix_c")), "mix-ties")
    before = (F.sum("__mix_c").over(Window.partitionBy("__mix_split").orderBy("__mix_part")) - F.col("__mix_c")).alias("__mix_before")
    own = F.row_number().over(Window.partitionBy("__mix_split", "__mix_part").orderBy(F.lit(0)))
    some = tied.join(counts.select("__mix_split", "__mix_part", before), ["__mix_split", "__mix_part"])
    some = some.withColumn("__mix_times", F.col("__mix_whole") + F.when(own + F.col("__mix_before") <= F.col("__mix_n"), 1).otherwise(0))
    return plain.unionByName(some.select(*[f"`{c}`" for c in names], "__mix_times"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``source``, ``size`` (words),
    ``source_size``, ``target`` (of the source), ``times`` and ``taken``
    (words taken, repetitions counted).

    Null and empty texts have size 0 and take nothing; a null source is a
    source of its own, the last one; rows of equal id and text are
    interchangeable, and as many of them are taken as the target needs; an
    empty table gives an empty result. Extra columns are not read.
    """
    narrow, p = _planned(docs, text_col, id_col, source_col, rule)
    out = _timed(narrow, p, "source", "draw")
    t = p.select(F.col("source").alias("p_source"), "total", "target")
    out = out.join(t, F.col("source").eqNullSafe(F.col("p_source")))
    return out.select("id", "source", "size", F.col("total").alias("source_size"), "target", F.col("__mix_times").alias("times"), (F.col("size") * F.col("__mix_times")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **rule) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (none, one
    or more times). All columns stay; names that begin with ``__mix_`` are
    reserved."""
    _, p = _planned(docs, text_col, id_col, source_col, rule)
    d = docs.withColumn("__mix_draw", draw(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    d = _timed(d, p, f"`{source_col}`", "__mix_draw")
    d = d.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("__mix_times").cast("int"))))
    return d.select(*[f"`{c}`" for c in docs.columns])
