"""Retrieval operators: exact k-NN (J1), metadata attach (J2), top-k (T1),
substring search (F1).

Exact k-NN design (both sides are DataFrames of any size, one plan for all):

* a bounded sample of the corpus serves as pivots (broadcast); every corpus
  vector goes to the cell of its nearest pivot with its distance to it, and
  neighbouring cells form groups of about ``CORPUS_SLICE`` rows (a larger cell
  is split). Corpus rows are shuffled once, whatever the number of queries;
* from its distances to the pivots and each cell's smallest radii a query knows
  a bound on its k-th neighbour; the triangle inequality rules out the cells
  that lie beyond it, and the query goes to the groups of the others;
* a ``mapInArrow`` pass holds one group's corpus rows, sorted by distance to
  their pivots, and streams a block of the group's queries past them, a few at
  a time. A cell is skipped, and within a cell only the rows in the ring that
  the bound allows are compared, and the bound shrinks as neighbours are found;
  a matrix product with a bound on its rounding tells which pairs to compare by
  the exact formula;
* a final ``row_number`` window per query merges the partial lists, at most
  ``k`` narrow rows per query and group.

The bounds only leave out what cannot be a neighbour, ties included, so the
answer is exact. Ties are broken by the corpus key (insertion position), as the
reference does with its stable sort.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import materialize

#: Cells of one distance matrix inside a task, and queries compared at once.
_CELLS, _TOGETHER = 4_000_000, 64
#: Corpus rows of a group (more rows, more groups), and the most pivots.
CORPUS_SLICE, MAX_PIVOTS = 65_536, 256
#: Corpus rows and queries below which a task is not made smaller.
_LEAST_SLICE, _QUERY_BLOCK = 8_192, 2_048
#: Smallest distances to the pivot that are kept per cell for the bound.
_NEAREST = 16
#: Relative slack of every bound, far above rounding errors.
_SLACK = 1e-9


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """First ``width`` entries of the vectors as a matrix."""
    n = len(col)
    return np.asarray(col.flatten(), dtype=np.float64).reshape(n, -1)[:, :width] if n else np.empty((0, width))


def _ids(col: pa.Array) -> np.ndarray:
    return col.to_numpy() if pa.types.is_integer(col.type) else np.array(col.to_pylist())


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences, dimension by dimension: one formula for every distance."""
    d = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore", over="ignore"):
        for j in range(a.shape[1]):
            diff = a[:, j][:, None] - b[:, j][None, :]
            d += diff * diff
    return d


def _of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_squared`` of rows that stand side by side, in the same order of sums."""
    d = np.zeros(len(a))
    with np.errstate(invalid="ignore", over="ignore"):
        for j in range(a.shape[1]):
            diff = a[:, j] - b[:, j]
            d += diff * diff
    return d


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return np.einsum("ij,ij->i", x, x)


def _maybe_near(q: np.ndarray, rows: np.ndarray, rows_sq: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among a query's ``k`` nearest of these
    rows and within its limit: by squared lengths and one matrix product, with
    a bound on its rounding. What it cannot tell stays in."""
    with np.errstate(invalid="ignore", over="ignore"):
        size = _lengths(q)[:, None] + rows_sq[None, :]
        d = q @ rows.T
        d *= -2
        d += size
        size *= 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps
        size += 1e-300
        most = (limit * (1 + _SLACK)) ** 2
        if len(rows) >= k:
            most = np.fmin(most, np.partition(d + size, k - 1, axis=1)[:, k - 1] * (1 + _SLACK))
        d -= size
        return np.nonzero(~(d > most[:, None]))


class _Cells:
    """Pivots, and per cell the rows' number, range of distances to the pivot
    and smallest such distances; cell ``len(pivots)`` takes the rows without a
    finite distance and is never left out."""

    def __init__(self, pivots: np.ndarray, k: int):
        self.pivots, self.k, self.n = pivots, k, len(pivots)
        self.low, self.high = np.full(self.n + 1, np.inf), np.full(self.n + 1, -np.inf)
        self.count = np.zeros(self.n + 1, np.int64)
        self.between = np.sqrt(_squared(pivots, pivots))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of every row."""
        cell, dist = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), 4096):
            d = np.sqrt(_squared(x[at:at + 4096], self.pivots))
            d[np.isnan(d)] = np.inf
            cell[at:at + 4096], dist[at:at + 4096] = d.argmin(axis=1), d.min(axis=1)
        cell[~np.isfinite(dist)] = self.n
        return cell, dist

    def bound(self, to_pivots: np.ndarray) -> np.ndarray:
        """Upper bound on every query's k-th neighbour distance."""
        out = np.full(len(to_pivots), np.inf)
        if self.near_weight.sum() < self.k:
            return out
        for at in range(0, len(out), 256):
            value = to_pivots[at:at + 256, self.near_cell] + self.near_dist[None, :]
            order = np.argsort(value, axis=1)
            enough = (np.cumsum(self.near_weight[order], axis=1) >= self.k).argmax(axis=1)[:, None]
            out[at:at + 256] = np.take_along_axis(value, np.take_along_axis(order, enough, axis=1), axis=1)[:, 0] * (1 + _SLACK)
        out[~np.isfinite(out)] = np.inf
        return out

    def least(self, to_pivots: np.ndarray) -> np.ndarray:
        """Lower bound on the distance from every query to every cell's rows."""
        d = to_pivots
        out = np.full((len(d), self.n + 1), -np.inf)
        if self.n:
            with np.errstate(invalid="ignore", divide="ignore"):
                ring = np.maximum(d - self.high[None, :-1], self.low[None, :-1] - d)
                own = d.argmin(axis=1)
                plane = (d ** 2 - d[np.arange(len(d)), own][:, None] ** 2) / (2 * self.between[own])
                out[:, :-1] = np.fmax(ring, np.where(np.isfinite(plane), plane, -np.inf)) - _SLACK * d
        return out

    def kept(self, least: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a neighbour within the bound."""
        return ~(least > bound[:, None] * (1 + _SLACK)) & (self.count[None, :] > 0)


class _Group:
    """The corpus rows of one group, and the neighbours of queries among them."""

    def __init__(self, cells: _Cells, width: int):
        self.cells, self.width, self.batches, self.parts, self.compared = cells, width, [], None, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def _ready(self) -> None:
        table = pa.Table.from_batches(self.batches).combine_chunks()
        x, ids = _matrix(table.column("vec").combine_chunks(), self.width), _ids(table.column("cid").combine_chunks())
        cell, dist = table.column("cell").to_numpy(), table.column("d").to_numpy()
        self.batches, self.parts = [], {}
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            rows = rows[np.argsort(dist[rows], kind="stable")]
            self.parts[int(c)] = (x[rows], ids[rows], dist[rows], _lengths(x[rows]))

    def nearest(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.parts is None:
            self._ready()
        k, out = self.cells.k, []
        x, bound = _matrix(batch.column("vec"), self.width), batch.column("d").to_numpy()
        to_pivots = np.sqrt(_squared(x, self.cells.pivots))
        order = np.argsort(to_pivots.argmin(axis=1) if self.cells.n else np.zeros(len(x)), kind="stable")  # queries of one cell together
        kinds = (batch.column("qid").type, batch.column("cid").type)
        for at in range(0, len(x), _TOGETHER):
            out.append(self._block(batch, order[at:at + _TOGETHER], x, bound, to_pivots, k, kinds))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(len(o) for o in out) else out[0]

    def _block(self, batch, mine, x, bound, to_pivots, k, kinds) -> pa.RecordBatch:
        q, limit, d = x[mine], bound[mine].copy(), to_pivots[mine]
        row, dist, cid = np.empty(0, np.int64), np.empty(0), None
        least = self.cells.least(d)
        for c in sorted(self.parts, key=lambda c: d[:, c].min() if c < self.cells.n else np.inf):
            rows, ids, radius, lengths = self.parts[c]
            some = np.flatnonzero(~(least[:, c] > limit * (1 + _SLACK)))
            if not len(some):
                continue
            a, b = 0, len(rows)
            if c < self.cells.n and np.isfinite(limit[some]).all() and np.isfinite(d[some, c]).all():
                slack = limit[some] + _SLACK * (limit[some] + d[some, c])
                a = np.searchsorted(radius, (d[some, c] - slack).min() * (1 - _SLACK), side="left")
                b = np.searchsorted(radius, (d[some, c] + slack).max() * (1 + _SLACK), side="right")
            step = max(1, _CELLS // len(some))
            for s in range(a, b, step):
                e = min(b, s + step)
                self.compared += len(some) * (e - s)
                i, j = _maybe_near(q[some], rows[s:e], lengths[s:e], limit[some], k)
                row, dist = np.concatenate([row, some[i]]), np.concatenate([dist, _of_pairs(q[some[i]], rows[s + j])])
                cid = ids[s + j] if cid is None else np.concatenate([cid, ids[s + j]])
                order = np.lexsort((cid, dist, row))
                rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
                row, dist, cid = (v[order[rank < k]] for v in (row, dist, cid))
                last = rank[rank < k] == k - 1
                found, worst = row[last], np.where(np.isnan(dist[last]), np.inf, dist[last])
                limit[found] = np.minimum(limit[found], np.sqrt(worst) * (1 + _SLACK))
        if cid is None:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (*kinds, pa.float64())], names=["qid", "cid", "dist"])
        return pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(mine[row])), pa.array(cid.tolist(), kinds[1]), pa.array(dist)],
                                          names=["qid", "cid", "dist"])


def _knn_of_width(q: DataFrame, c: DataFrame, k: int, width: int, n_queries: int, n_corpus: int, corpus_slice: int, max_pivots: int, compared) -> DataFrame:
    """Partial neighbour lists ``(qid, cid, dist)`` over the first ``width``
    entries; all vectors of a side have one length."""
    spark = q.sparkSession
    # about four tasks a core: groups of corpus rows times blocks of queries, so that neither side is copied often
    tasks = 4 * spark.sparkContext.defaultParallelism
    corpus_slice = min(corpus_slice, max(_LEAST_SLICE, math.ceil(n_corpus / math.sqrt(tasks))))
    qid, cid = q.schema["qid"].dataType.simpleString(), c.schema["cid"].dataType.simpleString()
    n_pivots = max(1, min(max_pivots, math.ceil(math.sqrt(n_corpus))))
    sample = c.orderBy(F.xxhash64("cid"), "cid").limit(4 * n_pivots).select("vec").collect()  # bounded
    points = np.unique(np.array([r.vec[:width] for r in sample], np.float64).reshape(len(sample), width), axis=0)
    points = points[np.isfinite(points).all(axis=1)]
    cells = _Cells(np.random.default_rng(7).permutation(points)[:n_pivots], k)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, dist = cells.assign(_matrix(batch.column("vec"), width)) if cells.n else (np.zeros(len(batch), np.int64), np.full(len(batch), np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("vec"), pa.array(cell.astype(np.int32)), pa.array(dist)], names=["cid", "vec", "cell", "d"])

    corpus = materialize(c.mapInArrow(assigned, f"cid {cid}, vec array<double>, cell int, d double"), "knn-cells")
    ranked = corpus.select("cell", "d", F.row_number().over(Window.partitionBy("cell").orderBy("d")).alias("r")).where(F.col("r") <= _NEAREST)
    near = [(r.cell, r.d) for r in ranked.collect() if r.cell < cells.n]  # at most 16 numbers a cell
    taken = np.zeros(cells.n + 1, np.int64)
    for r in corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect():
        cells.count[r.cell] = r.n
        cells.low[r.cell], cells.high[r.cell] = (r.low, r.high) if r.cell < cells.n else (0.0, np.inf)
    for at, _ in near:
        taken[at] += 1
    rest = [(i, cells.high[i], cells.count[i] - taken[i]) for i in range(cells.n) if cells.count[i] > taken[i]]
    cells.near_cell = np.array([i for i, _ in near] + [i for i, *_ in rest], np.int64)
    cells.near_dist = np.array([d for _, d in near] + [d for _, d, _ in rest], np.float64)
    cells.near_weight = np.array([1] * len(near) + [w for *_, w in rest], np.int64)

    # neighbouring cells share a group: along the chain of nearest pivots not yet visited
    chain, left = [], set(range(cells.n))
    while left:
        here = min(left) if not chain else min(left, key=lambda i: cells.between[chain[-1], i])
        chain.append(here)
        left.remove(here)
    group_of, parts_of, size, groups = np.zeros(cells.n + 1, np.int64), np.ones(cells.n + 1, np.int64), 0, 0
    for i in [*chain, cells.n]:
        n = int(cells.count[i])
        if size and size + n > corpus_slice:
            groups, size = groups + 1, 0
        group_of[i], parts_of[i] = groups, max(1, -(-n // corpus_slice))
        size += n
        if parts_of[i] > 1:
            groups, size = groups + int(parts_of[i]), 0
    groups += 1
    blocks = max(1, min(math.ceil(tasks / groups), math.ceil(n_queries / _QUERY_BLOCK)))
    shared = spark.sparkContext.broadcast((cells, group_of, parts_of))

    def numbers(v: np.ndarray):
        return F.array(*[F.lit(int(x)) for x in v])

    part = F.pmod(F.xxhash64("cid"), F.element_at(numbers(parts_of), F.col("cell") + 1).cast("bigint")).cast("int")
    group = F.element_at(numbers(group_of), F.col("cell") + 1) + part
    every = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: (group * blocks + b).cast("int"))
    right = corpus.select(F.explode(every).alias("g"), F.lit(0).alias("side"), F.lit(None).cast(qid).alias("qid"), "cid", "vec", "cell", "d")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, group, parts = shared.value
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                x = _matrix(batch.column("vec"), width)
                d = np.sqrt(_squared(x, m.pivots))
                bound = m.bound(d)
                row, cell = np.nonzero(m.kept(m.least(d), bound))
                times = parts[cell]  # to every part of a split cell
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                pairs = np.unique(np.stack([np.repeat(row, times), np.repeat(group[cell], times) + part]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype(np.int32)), *[batch.column(n).take(pa.array(pairs[0])) for n in ("qid", "vec")], pa.array(bound[pairs[0]])], names=["g", "qid", "vec", "d"])

    left = q.mapInArrow(sent, f"g int, qid {qid}, vec array<double>, d double")
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks))
    left = left.select((F.col("g") * blocks + block).cast("int").alias("g"), F.lit(1).alias("side"), "qid", F.lit(None).cast(cid).alias("cid"), "vec", F.lit(None).cast("int").alias("cell"), "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, None
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in ("g", "side")])
            cuts = np.flatnonzero(np.r_[True, (np.diff(key, axis=1) != 0).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if key[0, a] != at:
                    at, group = key[0, a], _Group(shared.value[0], width)
                some = batch.slice(a, b - a)
                if key[1, a] == 0:
                    group.add(some)
                elif group.batches or group.parts:
                    before = group.compared
                    yield group.nearest(some)
                    if compared is not None:
                        compared.add(group.compared - before)

    rows = right.unionByName(left).repartition(groups * blocks, "g").sortWithinPartitions("g", "side")
    return rows.mapInArrow(run, f"qid {qid}, cid {cid}, dist double")


def knn(queries: DataFrame, corpus: DataFrame, k: int = 3, *,
        query_key: str = "qid", corpus_key: str = "pos", vector: str = "embedding",
        corpus_vector: str | None = None, corpus_slice: int = CORPUS_SLICE, max_pivots: int = MAX_PIVOTS, compared=None) -> DataFrame:
    """Exact k nearest neighbours by squared L2 distance.

    Returns ``(query_key, rank, corpus_key, dist)``; ``rank`` starts at 1,
    ties by ascending ``corpus_key``; k larger than the corpus gives the whole
    corpus; an empty corpus gives no rows. Two vectors of different widths are
    compared over the shorter one's width (every pair of widths that occurs is
    a join of its own); null vectors are left out, and vectors with entries
    that are not finite are compared with everything. The answer to a query
    does not depend on the other queries, pivots or groups. ``compared`` may be
    an accumulator that counts the distances computed.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    q = queries.select(F.col(query_key).alias("qid"), F.col(vector).cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    c = corpus.select(F.col(corpus_key).alias("cid"), F.col(corpus_vector or vector).cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    q, c = materialize(q, "knn-queries"), materialize(c, "knn-corpus")
    widths = [{r.w: r["count"] for r in d.groupBy(F.size("vec").alias("w")).count().collect()} for d in (q, c)]
    parts = [_knn_of_width(q.where(F.size("vec") == a), c.where(F.size("vec") == b), k, min(a, b), m, n, corpus_slice, max_pivots, compared)
             for a, m in sorted(widths[0].items()) for b, n in sorted(widths[1].items())]
    if not parts:
        parts = [q.sparkSession.createDataFrame([], f"qid {q.schema['qid'].dataType.simpleString()}, cid {c.schema['cid'].dataType.simpleString()}, dist double")]
    w = Window.partitionBy("qid").orderBy(F.col("dist").asc(), F.col("cid").asc())
    return (reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select(F.col("qid").alias(query_key), "rank",
                    F.col("cid").alias(corpus_key), "dist"))


def top_k(df: DataFrame, k: int, score: str, *, tie: str, ascending: bool = True) -> DataFrame:
    """First k rows by ``score`` with a stable tie-break column.

    Catalyst plans ``orderBy().limit()`` as TakeOrderedAndProject: each task
    keeps k rows, so only k * partitions rows reach the final merge."""
    s = F.col(score).asc() if ascending else F.col(score).desc()
    return df.orderBy(s, F.col(tie).asc()).limit(k)


def top_k_per_group(df: DataFrame, k: int, group: str, score: str, *, tie: str,
                    ascending: bool = True) -> DataFrame:
    """Top-k within each group; ``row_number() <= k`` lets Catalyst insert a
    partial WindowGroupLimit before the shuffle."""
    s = F.col(score).asc() if ascending else F.col(score).desc()
    w = Window.partitionBy(group).orderBy(s, F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: What parts the words of a text, and queries without a whole word that are tried together on a text.
_GAP, _BLOCK = r"[^\p{L}\p{N}]+", 512


def substring_search(docs: DataFrame, queries: DataFrame, k: int, *, text: str = "text",
                     pos: str = "pos", query_key: str = "qid", query: str = "query",
                     score: float = 0.9) -> DataFrame:
    """per query, the first k documents (by position) whose text contains
    the query, case-insensitively; constant score. Null queries and texts give
    nothing, an empty query every text.

    A word that stands between two gaps of a query is a whole word of every
    text that contains the query. So queries meet the texts that hold their
    rarest such word, by an equi-join on words, and only those pairs are
    compared. Queries without such a word (one or two words) are compared with
    every text, in blocks of about ``_BLOCK`` queries, one scan each. The
    number of queries is not bounded."""
    q = queries.select(F.col(query_key).alias("_qid"), F.lower(F.col(query)).alias("_q")).where("_q is not null")
    words = F.split("_q", _GAP)
    whole = F.filter(F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>")), lambda w: w != "")
    q = materialize(q.withColumn("_words", F.array_distinct(whole)), "search-queries")
    d = docs.select(F.col(pos).alias("_pos"), F.lower(F.col(text)).alias("_low")).where("_low is not null")

    wanted = q.select(F.explode("_words").alias("_word")).distinct()
    held = d.select("_pos", F.explode(F.array_distinct(F.split("_low", _GAP))).alias("_word")).join(wanted, "_word", "left_semi")
    held = materialize(held, "search-words")
    often = held.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    # a query of which some word occurs nowhere has no hit
    rare = q.where(F.size("_words") > 0).select("_qid", "_q", F.explode("_words").alias("_word")).join(often, "_word", "left")
    rare = rare.groupBy("_qid", "_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("w"))).alias("_r")).where("_r.n > 0")
    pairs = held.join(rare.select("_qid", "_q", F.col("_r.w").alias("_word")), "_word").select("_pos", "_qid", "_q")
    hits = [d.join(pairs, "_pos").where(F.contains("_low", F.col("_q"))).select("_qid", "_pos")]

    short = q.where(F.size("_words") == 0).select("_qid", "_q")
    blocks = -(-short.count() // _BLOCK)
    for block in range(blocks):
        some = short.where(F.pmod(F.xxhash64("_qid", "_q"), F.lit(blocks)) == block)
        tried = some.select(F.collect_list(F.struct("_qid", "_q"))).scalar()
        found = d.select("_pos", "_low", tried.alias("_tried")).select("_pos", F.explode(F.filter("_tried", lambda x: F.contains(F.col("_low"), x["_q"]))).alias("x"))
        hits.append(found.select("x._qid", "_pos"))
    w = Window.partitionBy("_qid").orderBy("_pos")
    return (reduce(DataFrame.unionByName, hits).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_key), "rank", F.col("_pos").alias(pos),
                    F.lit(score).alias("score")))


def attach_metadata(vectors: DataFrame, meta: DataFrame, *, pos: str = "pos",
                    payload: str = "payload") -> DataFrame:
    """Left join metadata by position; missing payload -> ``'{}'``; the
    record id is the payload's ``id`` when present, else the position as text."""
    m = meta.select(F.col(pos).alias("_mpos"), F.col(payload).alias("_payload"))
    j = vectors.join(m, vectors[pos] == m["_mpos"], "left").drop("_mpos")
    pay = F.coalesce(F.col("_payload"), F.lit("{}"))
    pid = F.get_json_object(pay, "$.id")
    return (j.withColumn("payload", pay)
            .withColumn("id", F.coalesce(pid, F.col(pos).cast("string")))
            .drop("_payload"))
