"""Benchmark decontamination by word windows.

Benchmark items are cut into windows of ten words (an item of fewer words is
one window). The distinct windows' hashes form the set that every document
window is looked up in; hits are verified on the words themselves. Only
DataFrame functions run: a scan generates the windows of a document inside
whole-stage code and lets go of all but the hits, so nothing but hits is
shuffled. The hash set is broadcast in parts of about ``BROADCAST_WINDOWS``
windows, one scan each, so a broadcast is bounded whatever the benchmark's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of, written

WINDOW = 10
#: About 60 MB as a hash relation.
BROADCAST_WINDOWS = 1_000_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: One word of the text as it stands (capitals are word characters there), with the gap before it.
_PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words after lower-casing A-Z only; all-ASCII texts take the short way."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _GAP + "+"), "")


def _hash(w: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(w), at + j) for j in range(k)])


def benchmark_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int]]:
    """``(windows, items, lengths)``: the distinct windows ``(k, h, win)``, the
    items of every window ``(win, item)``, and the window lengths that occur
    (at most ``window`` values)."""
    b = bench.select(F.col(f"`{id_col}`").cast("string").alias("item"), words(text_of(F.col(f"`{text_col}`"))).alias("w"))
    b = b.withColumn("n", F.size("w")).where("n > 0").withColumn("k", F.least("n", F.lit(window)))
    b = b.select("item", "w", "k", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("pos"))
    b = b.select("item", "k", F.slice("w", F.col("pos") + 1, F.col("k")).alias("x"))
    items = written(b.select("item", "k", F.array_join("x", " ").alias("win"), "x").distinct(), "leak-items")
    lengths = [r[0] for r in items.select("k").distinct().collect()]
    h = F.lit(None).cast("bigint")
    for k in lengths:
        h = F.when(F.col("k") == k, _hash("x", F.lit(0), k)).otherwise(h)
    windows = written(items.select("k", "win", h.alias("h")).distinct(), "leak-windows")
    return windows, items.select("win", "item").distinct(), sorted(lengths)


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, hits, items)``, all keyed by ``(id, text_hash)``.

    ``texts`` has every distinct key with ``n_words`` and the number of equal
    rows ``copies``; ``hits`` one verified window occurrence ``(pos, k, win)``
    per row; ``items`` the benchmark items of every window.
    """
    windows, items, lengths = benchmark_windows(bench, window=window)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("t"))
    d = d.select("id", F.xxhash64("t").alias("text_hash"), words(F.col("t")).alias("w")).withColumn("n_words", F.size("w"))
    # position -1 is the document itself: it passes without a hit, so one scan serves both
    d = d.withColumn("pos", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.col("n_words") - min(lengths, default=window)))))
    # plain generators and filters only, so that the words are never copied per position
    first = lengths[0] if lengths else window
    d = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in lengths or [window]])))
    d = d.where(((F.col("pos") < 0) & (F.col("k") == first)) | ((F.col("pos") >= 0) & (F.col("pos") + F.col("k") <= F.col("n_words"))))
    h = F.xxhash64("id", "text_hash")
    for k in lengths:
        h = F.when((F.col("k") == k) & (F.col("pos") >= 0), _hash("w", F.col("pos"), k)).otherwise(h)
    d = d.withColumn("h", h)
    known = written(windows.select(F.col("h").alias("wh"), F.col("k").alias("wk"), F.lit(True).alias("known")).distinct(), "leak-hashes")
    parts = max(1, -(-known.count() // BROADCAST_WINDOWS))

    def hits_of(part: int) -> DataFrame:
        some = F.broadcast(known.where(F.pmod("wh", F.lit(parts)) == part))
        mine = (F.col("pos") < 0) if part == 0 else F.lit(False)
        hit = d.where(mine | (F.col("pos") >= 0)).join(some, (F.col("h") == F.col("wh")) & (F.col("k") == F.col("wk")), "left").where(mine | F.col("known"))
        return hit.select("id", "text_hash", "n_words", "pos", "k", F.when(F.col("pos") >= 0, F.array_join(F.expr("slice(w, pos + 1, k)"), " ")).alias("win"))

    found = reduce(DataFrame.unionByName, [written(hits_of(part), "leak-found") for part in range(parts)])
    texts = found.where("pos < 0").groupBy("id", "text_hash", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    hits = found.where("pos >= 0").join(windows.select("k", "win"), ["k", "win"]).select("id", "text_hash", "pos", "k", "win").distinct()
    return texts, hits, items


def _spans(hits: DataFrame) -> DataFrame:
    """Hits with ``fresh``, the words that no earlier hit of the text covers."""
    before = Window.partitionBy("id", "text_hash").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.col("pos") + F.col("k")).over(before), F.lit(0))
    return hits.select("id", "text_hash", "pos", "k").distinct().withColumn(
        "fresh", F.greatest(F.lit(0), F.col("pos") + F.col("k") - F.greatest(F.col("pos"), end)))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text_hash``, ``n_words``,
    ``n_hit`` (words inside any occurrence of a window), ``n_items`` (items
    with an occurring window), ``items_sha256`` (of their ids, sorted as
    strings, comma-joined) and ``contaminated``.

    Null and empty texts have no words and no hits; repeated rows and null ids
    are kept row by row; items without words give no window; an empty
    benchmark contaminates nothing. Items with a null id hit but are not
    listed. Columns other than the id and the text are not read.
    """
    texts, hits, items = scan(docs, bench, id_col, text_col, window)
    covered = _spans(hits).groupBy("id", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = (hits.select("id", "text_hash", "win").distinct().join(items.where("item is not null"), "win")
             .select("id", "text_hash", "item").distinct()
             .groupBy("id", "text_hash").agg(F.sort_array(F.collect_list("item")).alias("item_ids")))
    for right, names in ((covered, ["n_hit"]), (named, ["item_ids"])):
        r = right.select(F.col("id").alias("r_id"), F.col("text_hash").alias("r_hash"), *names)
        texts = texts.join(r, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left").drop("r_id", "r_hash")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    out = texts.select("id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                       F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy").withColumn("contaminated", F.col("n_hit") > 0)


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "document", id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``mode="document"``), or with
    the covered words and the gaps before them cut from their texts
    (``mode="span"``). Other rows and all columns stay as they are; names that
    begin with ``__leak_`` are reserved."""
    _, hits, _ = scan(docs, bench, id_col, text_col, window)
    t = text_of(F.col(f"`{text_col}`"))
    d = docs.withColumn("__leak_hash", F.xxhash64(t))
    here = F.col(f"`{id_col}`").eqNullSafe(F.col("__leak_id")) & (F.col("__leak_hash") == F.col("__leak_text"))
    if mode == "document":
        keys = written(hits.select(F.col("id").alias("__leak_id"), F.col("text_hash").alias("__leak_text")).distinct(), "leak-keys")
        return d.join(keys, here, "left_anti").drop("__leak_hash")
    # a text's own spans: at most as many as it has words
    spans = _spans(hits).where("fresh > 0").groupBy("id", "text_hash").agg(
        F.collect_list(F.struct((F.col("pos") + F.col("k") - F.col("fresh")).alias("a"), (F.col("pos") + F.col("k")).alias("b"))).alias("__leak_spans"))
    spans = spans.withColumnsRenamed({"id": "__leak_id", "text_hash": "__leak_text"})
    d = d.join(written(spans, "leak-spans"), here, "left")
    pieces = F.regexp_extract_all(t, F.lit(_PIECE), 0)
    kept = F.filter(pieces, lambda p, i: ~F.exists(F.col("__leak_spans"), lambda s: (i >= s["a"]) & (i < s["b"])))
    cut = F.when(F.col("__leak_spans").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(kept, ""))
    return d.withColumn(text_col, cut).select(*[f"`{c}`" for c in docs.columns])
