"""N-gram Jaccard self-join by MinHash banding.

Documents become sets of five-word shingles (lower-cased word characters; a
text of fewer words is one shingle). Documents with equal sets are copies and
are joined as one. MinHash signatures of the distinct sets are cut into bands;
number and width of the bands follow from the wanted recall at the threshold.
Sets that share a band hash are candidates, and every candidate pair is
verified on the full sets.

Pairs of sets are never emitted. Buckets yield star edges to their smallest
member, whose components bundle the sets that can meet at all. The sets of a
component come in the order of their largest buckets and are cut into cells of
about ``BLOCK`` sets, so sets that share many bands share a cell. Two cells are
compared, in a task, if any bucket holds sets of both: in a component that
chance collisions have chained together the unrelated cells are not read
together, and each pair of sets meets at most once. A comparison emits, for
every member, how many links it has and one edge to the smallest member it is
linked with there. So a task holds at most two cells, and the output is linear
in the documents however large a group is. Classes grow from verified links.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import connected_components, text_of, written

SHINGLE_WORDS = 5
BLOCK = 256
#: Bits of the broadcast table that keeps other texts out of a shuffle.
MAX_BITS = 1 << 26
_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, max_hashes: int = 200) -> tuple[int, int]:
    """(bands, rows): the widest rows for which a pair at the threshold shares
    a band with probability ``recall``, within ``max_hashes`` hash functions."""
    best = None
    for rows in range(1, 64):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix generator: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's ``k``-word shingles."""
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    m = min(n, k)
    h = np.full(n - m + 1, m, np.uint64)
    for j in range(m):
        h = h * _PRIME + w[j:n - m + 1 + j]
    return np.unique(_mix(h))


class Signer:
    """MinHash band hashes under a fixed seed."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2 ** 63, bands * rows, dtype=np.uint64)

    def bands_of(self, h: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 512):  # a slice of the products stays in cache, whatever the text's length
            part = self.a[:, None] * h[None, i:i + 512] + self.b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        m = low.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for r in range(self.rows):
            out = _mix(out * _PRIME + m[:, r])
        return out.view(np.int64)


def _sign(bands: int, rows: int, k: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows, seed)
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), k)
                sizes.append(len(h))
                keys.append(xxhash.xxh128_hexdigest(h.tobytes()) if len(h) else None)
                sigs.append(signer.bands_of(h) if len(h) else np.empty(0, np.int64))
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["id", "text_hash", "set_key", "n_shingles", "bands"])
    return run


def _compare(sets: list[np.ndarray], side: np.ndarray, same: bool, t: Fraction) -> np.ndarray:
    """Boolean link matrix of the sets: all pairs of one block, or the pairs
    across two blocks. Only shingles of two sets or more count; their
    incidence matrix is multiplied slice by slice, so memory stays bounded."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    shared = count[col] > 1
    owner, col = owner[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    inter = np.zeros((m, m), np.float64)
    width, start = 4096, 0
    while start < len(col):
        end = np.searchsorted(col, col[start] + width)
        x = np.zeros((m, width), np.float32)
        x[owner[start:end], col[start:end] - col[start]] = 1
        inter += x @ x.T
        start = end
    both = inter.astype(np.int64)
    union = size[:, None] + size[None, :] - both
    link = both * t.denominator >= union * t.numerator
    np.fill_diagonal(link, False)
    return link if same else link & (side[:, None] != side[None, :])


def _verify(k: int, t: Fraction):
    names = ["set_key", "root_key", "text_links", "doc_links"]

    def finish(group: list[tuple], i: int, j: int) -> list[tuple]:
        group = sorted({g[0]: g for g in group}.values(), key=lambda g: g[0])  # the first of a component is its smallest
        if len(group) < 2:
            return []
        link = _compare([g[3] for g in group], np.array([g[1] for g in group]), i == j, t)
        lab = np.arange(len(group))
        while True:
            low = np.minimum(lab, np.where(link, lab[None, :], len(group)).min(axis=1))
            if (low == lab).all():
                break
            lab = low
        copies = np.array([g[2] for g in group], np.int64)
        n = link.sum(axis=1)
        return [(group[x][0], group[lab[x]][0], int(n[x]), int(copies[link[x]].sum())) for x in np.flatnonzero(n)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, out = None, [], []
        for batch in batches:
            for i, j, key, cell, copies, text in zip(*[batch.column(c) for c in ("i", "j", "set_key", "cell", "n_copies", "text")], strict=True):
                here = (i.as_py(), j.as_py())
                if here != at:
                    out += finish(group, *at) if at else []
                    at, group = here, []
                    if len(out) >= 10_000:
                        yield table(out)
                        out = []
                group.append((key.as_py(), cell.as_py(), copies.as_py(), shingle_hashes(text.as_py(), k)))
        yield table(out + (finish(group, *at) if at else []))
    return run


def _only(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` whose hash ``key`` may be among the wanted ones, before they are
    shuffled: a table of bits, 16 for each wanted key but at most ``MAX_BITS``,
    is broadcast. What it lets through by chance the join drops."""
    bits = 1 << 16
    n = wanted.count()
    while bits < 16 * n and bits < MAX_BITS:
        bits *= 2

    def slot(c: str):
        return F.pmod(F.xxhash64(c, F.lit(2)), F.lit(bits))

    words = wanted.groupBy(F.shiftright(slot(wanted_key), 6).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot(wanted_key) % 64).cast("int"))).alias("__bits"))
    words = F.broadcast(written(words, "ngram-bits"))
    bit = F.call_function("shiftrightunsigned", F.col("__bits"), (slot(key) % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return rows.join(words, (F.shiftright(slot(key), 6) == F.col("__word")) & (bit == 1), "left_semi")


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                       recall: float = 0.9999, k: int = SHINGLE_WORDS, max_hashes: int = 200, seed: int = 20240) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``text_hash``, ``class_key``,
    ``class_id`` (smallest id of all documents reachable over links),
    ``n_copies`` (documents with the same shingle set, itself included),
    ``n_links`` (other documents at ``threshold`` or more, copies counted) and
    ``n_text_links`` (different shingle sets among them).

    Null and empty texts and texts without a word have no shingle: they link
    to nothing and are their own class (``class_key`` null). Repeated rows are
    copies like any others. Null ids take part; a class without any id has a
    null ``class_id``. Extra columns are not read. A pair at the threshold is
    found with probability ``recall``, a closer one with a higher one; no pair
    below the threshold is ever linked.
    """
    t = Fraction(str(threshold))
    bands, rows = choose_bands(threshold, recall, max_hashes)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text")) \
              .withColumn("text_hash", F.xxhash64("text"))
    id_type = src.schema["id"].dataType.simpleString()
    sig = written(src.mapInArrow(_sign(bands, rows, k, seed), f"id {id_type}, text_hash bigint, set_key string, n_shingles int, bands array<bigint>"), "ngram-sig")

    sets = sig.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct("id", "text_hash")).alias("rep"), F.min("id").alias("min_id"), F.count(F.lit(1)).alias("n_copies"), F.any_value("bands").alias("bands"))
    sets = written(sets.withColumn("u", F.xxhash64("set_key")), "ngram-sets")

    # cells: a 64-bit name of a set is enough here, as a clash only makes a cell larger
    entry = sets.select("u", F.explode("bands").alias("h"))
    shared = entry.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("v")).where("n > 1")
    member = written(entry.join(shared, "h"), "ngram-buckets")
    comp = connected_components(member.where("u <> v").select("u", "v"))
    home = member.groupBy("u").agg(F.max(F.struct("n", "h")).alias("home")).join(comp.withColumnRenamed("node", "u"), "u")
    home = written(home, "ngram-homes")
    sizes = home.groupBy("root", "home").agg(F.count(F.lit(1)).alias("size"))
    first = F.sum("size").over(Window.partitionBy("root").orderBy("home")) - F.col("size")  # one row per bucket of a component
    place = F.col("first") + F.pmod(F.xxhash64("u", F.lit(1)), F.col("size"))
    cells = home.join(sizes.withColumn("first", first), ["root", "home"]).select("u", F.xxhash64("root", F.floor(place / BLOCK)).alias("cell"))
    cells = written(cells, "ngram-cells")
    met = member.select("u", "h").join(cells, "u").groupBy("h").agg(F.sort_array(F.collect_set("cell")).alias("c"))
    pairs = met.select("c", F.explode("c").alias("i")).select("i", F.explode(F.filter("c", lambda x: x >= F.col("i"))).alias("j")).distinct()
    pairs = written(pairs, "ngram-pairs")

    cand = sets.join(cells, "u").select(F.col("rep.id").alias("c_id"), F.col("rep.text_hash").alias("c_hash"), "set_key", "n_copies", "cell")
    cand = written(cand, "ngram-candidates")
    text = _only(src, "text_hash", cand, "c_hash")
    text = text.join(cand, (F.col("text_hash") == F.col("c_hash")) & F.col("id").eqNullSafe(F.col("c_id"))).drop("c_hash", "c_id", "id", "text_hash")
    text = text.dropDuplicates(["set_key"])
    sides = pairs.select(F.col("i").alias("cell"), "i", "j").unionAll(pairs.where("i <> j").select(F.col("j").alias("cell"), "i", "j"))
    blocks = text.join(sides, "cell").select("i", "j", "set_key", "cell", "n_copies", "text")
    blocks = blocks.repartition("i", "j").sortWithinPartitions("i", "j")
    found = written(blocks.mapInArrow(_verify(k, t), "set_key string, root_key string, text_links bigint, doc_links bigint"), "ngram-links")

    links = found.groupBy("set_key").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    classes = connected_components(found.select(F.col("set_key").alias("u"), F.col("root_key").alias("v")))
    known = (sets.select("set_key", "n_copies", "min_id").join(links, "set_key", "left")
             .join(classes.withColumnRenamed("node", "set_key"), "set_key", "left")
             .where("n_copies > 1 or root is not null")
             .select("set_key", "min_id", "n_copies", F.coalesce("root", "set_key").alias("class_key"),
                     (F.col("n_copies") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"),
                     F.coalesce("text_links", F.lit(0)).alias("n_text_links")))
    known = written(known, "ngram-classes")
    first = known.groupBy("class_key").agg(F.min("min_id").alias("class_id"))
    known = written(known.join(first, "class_key").drop("min_id"), "ngram-classes")
    out = sig.select("id", "text_hash", "set_key").join(known, "set_key", "left")
    return out.select("id", "text_hash", F.coalesce("class_key", "set_key").alias("class_key"),
                      F.when(F.col("class_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each similarity class: that with the smallest
    id (null first), ties by text. Of rows equal in id and text one stays.
    Texts without a word stay. All columns are returned as they are."""
    c = written(similarity_classes(docs, id_col, text_col, **options).where("n_links > 0").select("id", "text_hash", "class_key"), "ngram-members")
    best = c.groupBy("class_key").agg(F.min(F.struct("id", "text_hash")).alias("best"))
    members = c.groupBy("class_key", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    members = members.join(best, "class_key").withColumn("stays", F.struct("id", "text_hash").eqNullSafe(F.col("best")))
    members = written(members.where("not stays or n > 1").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "ngram-losers")
    # rows of a document that has equal rows beside it: only then is a second pass over them needed
    twins = members.where("stays")
    d = docs.withColumn("__text_hash", F.xxhash64(text_of(F.col(f"`{text_col}`"))))
    same = (F.col("__text_hash") == F.col("__hash")) & F.col(f"`{id_col}`").eqNullSafe(F.col("__id"))
    # the rows to drop grow with the documents: one plan for all sizes, no broadcast
    out = d.join(members.hint("merge"), same, "left_anti").drop("__text_hash")
    if twins.isEmpty():
        return out
    one = d.join(twins, same, "left_semi").dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")
    return out.unionByName(one)
