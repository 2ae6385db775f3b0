"""Whitening of embeddings from an exact, bit-sliced covariance.

Every entry becomes a whole number x. A task takes its rows in blocks, shifts
each dimension to begin at zero and packs every bit plane of every dimension
across the block's rows into 64-bit words. The cross-product of two dimensions
is then a sum of popcounts of ANDed planes, weighted by the planes' powers of
two: whole numbers, without rounding. Sums and cross-products are added up by
Spark in limbs that cannot overflow; the scatter is centred as whole numbers
(n times the cross-product less the product of the sums) and turned to double
only then, for the eigenvectors. What reaches the driver is one row of sums
and one matrix of the vectors' width, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows whose bit planes are packed at once (a multiple of 64).
BLOCK = 4096
#: Larger numbers are held here, so that they stay whole 64-bit numbers.
LARGEST = 2 ** 61
#: An eigenvalue below this share of its component's summed variances counts as none.
NONE = 1e-13
_LIMB = 32


def whole(vectors: np.ndarray) -> np.ndarray:
    """x = floor(64 c) + 1,000,000 of finite doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the columns of a block of non-negative numbers: words
    (one row per plane), the plane's column and its bit."""
    rows, width = y.shape
    y = np.vstack([y, np.zeros((-rows % 64, width), np.int64)])
    bits = [int(m).bit_length() for m in y.max(axis=0)]
    column = np.repeat(np.arange(width), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if width else np.empty(0, np.int64)
    out = np.empty((len(column), len(y) // 64), np.uint64)
    for p, (c, b) in enumerate(zip(column, bit)):
        out[p] = np.packbits((y[:, c] >> b & 1).astype(np.uint8)).view(np.uint64)
    return out, column, bit


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact ``(sums, cross-products)`` of a block's columns, as Python ints."""
    rows, width = x.shape
    low = x.min(axis=0)
    words, column, bit = planes(x - low)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).tolist()
    sums = np.array([0] * width, object)
    for c, b, n in zip(column.tolist(), bit.tolist(), ones):
        sums[c] += n << b
    cross = np.zeros((width, width), object)
    power = np.array([1 << b for b in bit.tolist()], object)
    small = 2 * int(bit.max(initial=0)) + 2 + rows.bit_length() + 12 < 63
    if small:
        power = power.astype(np.int64)
        cross = cross.astype(np.int64)
    starts = np.searchsorted(column, np.arange(width))
    for p in range(len(column)):  # against itself and the planes after it
        n = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        n = (n if small else n.astype(object)) * power[p:] * power[p]
        c = column[p]
        if c + 1 < width and starts[c + 1] < len(column):  # whole columns after this one
            at = starts[c + 1] - p
            held = np.unique(column[p + at:])
            cross[c, held] += np.add.reduceat(n[at:], starts[held] - starts[c + 1])
            n = n[:at]
        cross[c, c] += n[0] + 2 * n[1:].sum()
    cross = cross.astype(object)
    cross += np.triu(cross, 1).T
    low = low.astype(object)
    return sums + rows * low, cross + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)


def _limbs(value: int) -> list[int]:
    """Limbs of 32 bits, the last one with the sign."""
    out = []
    while not -2 ** 31 <= value < 2 ** 31:
        out.append(value & (2 ** _LIMB - 1))
        value >>= _LIMB
    return [*out, value]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of doubles."""
    v = batch.column("vector")
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), width)


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """``(n, sums, cross-products)`` of the x of all ``vector``s, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.array([0] * width, object), np.zeros((width, width), object)
        for batch in batches:
            x = whole(_matrix(batch, width))
            for at in range(0, len(x), BLOCK):
                s, c = block_scatter(x[at:at + BLOCK])
                n, sums, cross = n + len(x[at:at + BLOCK]), sums + s, cross + c
        rows = [(-1, -1, n), *((-1, i, s) for i, s in enumerate(sums)), *((i, j, cross[i, j]) for i in range(width) for j in range(i, width))]
        cells = [(i, j, k, limb) for i, j, value in (rows if n else []) for k, limb in enumerate(_limbs(int(value)))]
        for at in range(0, len(cells), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cells[at:at + 100_000]], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["i", "j", "limb", "value"])

    cells = vectors.select("vector").mapInArrow(run, "i int, j int, limb int, value bigint").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    n, sums, cross = 0, [0] * width, np.zeros((width, width), object)
    for i, j, limb, value in cells.collect():  # the square of the width, whatever the number of rows
        value <<= _LIMB * limb
        if i >= 0:
            cross[i, j] += value
        elif j >= 0:
            sums[j] += value
        else:
            n += value
    return n, sums, cross + np.triu(cross, 1).T


def eigenvectors(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns. Where the
    variances differ by many orders, rotations of pairs follow that keep the
    small eigenvalues' digits, which a whole-matrix method rounds away."""
    d = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    if len(cov) and d.max() > 1e3 * d.min():
        order = np.argsort(-np.diag(cov), kind="stable")
        a, q = cov[np.ix_(order, order)].copy(), np.eye(len(cov))[:, order]
        for _ in range(60):
            moved = False
            for i in range(len(a) - 1):
                for j in range(i + 1, len(a)):
                    if abs(a[i, j]) <= 1e-16 * math.sqrt(max(a[i, i] * a[j, j], 0.0)) or a[i, j] == 0:
                        continue
                    moved = True
                    theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                    t = math.copysign(1, theta) / (abs(theta) + math.hypot(1, theta))
                    c = 1 / math.hypot(1, t)
                    s, off = t * c, a[i, j]
                    ii, jj = a[i, i] - t * off, a[j, j] + t * off
                    a[:, i], a[:, j] = c * a[:, i] - s * a[:, j], s * a[:, i] + c * a[:, j]
                    a[i], a[j] = a[:, i], a[:, j]
                    a[i, i], a[j, j], a[i, j], a[j, i] = ii, jj, 0.0, 0.0
                    q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
            if not moved:
                break
        e = np.diag(a)
    else:
        e, q = np.linalg.eigh(cov)
    order = np.argsort(-e, kind="stable")
    return e[order], q[:, order]


class Whitening:
    """Centre, components and scale of the fitted vectors."""

    def __init__(self, n: int, sums: list[int], cross: np.ndarray, components: int):
        self.n, self.sums = n, sums
        width = len(sums)
        square = n * n
        cov = np.array([[(n * cross[i, j] - sums[i] * sums[j]) / square for j in range(width)] for i in range(width)], np.float64).reshape(width, width)
        e, q = eigenvectors(cov)
        trace = sum(n * cross[i, i] - sums[i] ** 2 for i in range(width)) / square
        k = min(components, width)
        self.held = e[:k] > NONE * (np.diag(cov) @ q[:, :k] ** 2)
        self.root = np.where(self.held, np.sqrt(np.where(self.held, e[:k], 1.0)), np.nan)
        self.components = q[:, :k]
        self.explained = np.where(self.held, e[:k] / trace if trace > 0 else 0.0, 0.0)
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * (s // n) for s in sums]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.floor).astype(np.float64) - np.array(self.rest, np.float64) / self.n) @ self.components / self.root

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, as Python ints."""
        y = x - self.floor
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        kind = np.int64 if most * most * max(1, y.shape[1]) < 2 ** 63 else object
        t = self.n * y.astype(kind) - np.array(self.rest, kind)
        return [int(v) for v in (t * t).sum(axis=1)]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining vector: ``id``, ``n``, ``deviation`` (long; null
    where the exact number is larger), ``deviation_digits`` (the exact number),
    ``whitened`` (array, null where the component has no variance),
    ``explained`` (array, 0 there) and ``identity_error`` (over the components
    with variance; 0 if there are none).

    Vectors that are null or hold null or non-finite entries are dropped, and so
    are those of another width than the most common one (ties: the wider):
    they lack entries that the others have. Entries beyond 2^61 after scaling
    are held there. Repeated rows and rows with a null id count like any
    others; vectors without entries have no components; extra columns are not
    read; a table without a remaining vector gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is above all numbers
    src = vectors.where(v.isNotNull() & finite).select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("vector"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, deviation bigint, deviation_digits string, whitened array<double>, explained array<double>, identity_error double"
    widest = src.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widest is None:
        return spark.createDataFrame([], schema)
    width = widest.width
    src = src.where(F.size("vector") == width)
    model = Whitening(*scatter(src, width), components)
    shared = spark.sparkContext.broadcast(model)
    k = int(model.held.sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total, square = shared.value, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = m.whitened(whole(_matrix(batch, width)))[:, m.held]  # already centred
            total += w.sum(axis=0)
            square += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([i for i in range(-1, k) for _ in range(k)], pa.int32()), pa.array(list(range(k)) * (k + 1), pa.int32()),
                                          pa.array(np.vstack([total, square]).ravel())], names=["i", "j", "value"])

    found = np.zeros((k + 1, k))
    for i, j, value in src.select("vector").mapInArrow(moments, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        found[i + 1, j] = value / model.n
    error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max(initial=0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole(_matrix(part, width))
                w, size = m.whitened(x), len(x)
                exact = m.deviation(x)
                offsets = pa.array(np.arange(size + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([m.n] * size, pa.int64()), pa.array([d if d < 2 ** 63 else None for d in exact], pa.int64()), pa.array([str(d) for d in exact], pa.string()),
                    pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), mask=np.isnan(w.ravel()))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.tile(m.explained, size))), pa.array([error] * size, pa.float64())],
                    names=["id", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error"])

    return src.mapInArrow(run, schema)
