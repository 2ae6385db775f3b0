"""Whitening against plain numpy and whole-number Python."""

import math

import numpy as np
import pytest
from brute import empty_like

from tallyframe.llm import whitening
from tallyframe.llm.queries import op11_embedding_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<double>, id string, vector string, n string, i int, value string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, *"zzz", 7, "z") for i, v in vectors], SCHEMA)


def plain(vectors):
    """(exact x, sums, covariance, eigenvalues, eigenvectors) of lists of floats."""
    x = [[min(max(math.floor(64 * c), -2 ** 61), 2 ** 61) + 1_000_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(width)]
    cov = np.array([[sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x) / n ** 3 for b in range(width)] for a in range(width)])
    e, q = np.linalg.eigh(cov)
    return x, s, e[::-1], q[:, ::-1]


def check(rows, vectors, k=32):
    """rows: (id, n, deviation, whitened, explained, error) by row; ids 0.. name the vectors."""
    x, s, e, q = plain(vectors)
    n = len(x)
    k = min(k, len(s))
    assert len(rows) == n
    w = np.full((n, k), np.nan)
    for i, count, deviation, whitened, explained, error in rows:
        assert count == n and deviation == sum((n * a - b) ** 2 for a, b in zip(x[i], s))
        w[i] = [np.nan if v is None else v for v in whitened]
        assert error <= 1e-4 and np.allclose(explained, np.maximum(e[:k], 0) / max(e.sum(), 1e-300), rtol=1e-6, atol=1e-12)
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x])
    for c in range(k):
        if e[c] <= 1e-9 * max(e[0], 1):
            assert np.isnan(w[:, c]).all()
            continue
        assert abs(w[:, c].std() - 1) < 1e-6 and abs(w[:, c].mean()) < 1e-6
        if all(abs(e[c] - e[o]) > 1e-4 * e[0] for o in range(len(e)) if o != c):
            want = centred @ q[:, c] / math.sqrt(e[c])
            assert np.allclose(w[:, c], want, atol=1e-6) or np.allclose(w[:, c], -want, atol=1e-6)


def whitened(df, **options):
    return [(r.id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(df, **options).collect()]


@pytest.mark.parametrize("rows,width,scale", [(1, 1, 10), (5, 3, 10), (4096, 64, 3), (100, 7, 1e9), (70, 5, 1e17), (10, 4, 0), (65, 2, 1e-3)])
def test_bit_planes_give_exact_sums_and_products(rows, width, scale):
    x = whitening.whole(np.random.default_rng(rows).normal(size=(rows, width)) * scale)
    sums, cross = whitening.block_scatter(x)
    exact = x.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (cross == exact.T @ exact).all()


def test_columns_without_a_bit_stand_among_others():
    x = np.array([[5, 1, 7, 0], [5, 9, 7, 3], [5, 2, 7, -4]])
    sums, cross = whitening.block_scatter(x)
    assert (sums == x.sum(axis=0)).all() and (cross == x.T @ x).all()


def test_limbs():
    for v in (0, 1, -1, 2 ** 31, -2 ** 31 - 1, 10 ** 30, -10 ** 30):
        assert sum(limb << (32 * k) for k, limb in enumerate(whitening._limbs(v))) == v


@pytest.mark.parametrize("components", [32, 3])
def test_against_plain_version(spark, components):
    rng = np.random.default_rng(8)
    mix = rng.normal(size=(6, 6)) * [5, 3, 2, 1, 0.5, 0.3]
    vectors = (rng.normal(size=(400, 6)) @ mix + 40).tolist()
    df = table(spark, list(enumerate(vectors))).repartition(7)
    check(whitened(df, components=components), vectors, components)


def test_variances_of_many_orders(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(300, 4)) * [1e9, 1e5, 20, 3] + [0, 7, -5, 2]).tolist()
    rows = whitened(table(spark, list(enumerate(vectors))))
    w = np.array([r[3] for r in sorted(rows)])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-6 and rows[0][5] < 1e-6
    assert abs(sum(rows[0][4]) - 1) < 1e-9


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [4.0, -2.0, 3.0], [0.015625, 7.5, 3.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 1.0, 2.0], [1.0, -inf, 1.0], [1.0], [1.0, 2.0, 3.0, 4.0]]
    df = table(spark, [*enumerate(good), *((90 + i, v) for i, v in enumerate(bad))])
    check(whitened(df), good)
    same = whitened(table(spark, [(None, [2.0, 3.0])] * 5))
    assert same == [(None, 5, 0, [None, None], [0.0, 0.0], 0.0)] * 5
    assert whitened(table(spark, [(1, [])])) == [(1, 1, 0, [], [], 0.0)]
    assert whitened(table(spark, [(1, None)])) == [] and whitening.whiten(empty_like(df)).count() == 0


def test_numbers_beyond_a_long(spark):
    vectors = [[1e300, 1.0], [-1e300, 2.0], [3e15, 5.0], [1.0, 1.5]]
    rows = whitening.whiten(table(spark, list(enumerate(vectors)))).collect()
    x, s, _, _ = plain(vectors)
    for r in rows:
        exact = sum((4 * a - b) ** 2 for a, b in zip(x[r.id], s))
        assert r.deviation_digits == str(exact) and r.deviation == (exact if exact < 2 ** 63 else None)


def test_query(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    by = {}
    for r in op11_embedding_whitening(spark, SF).collect():
        row = by.setdefault(r.vec_id, [r.vec_id, r.n, r.deviation, [None] * 32, [None] * 32, r.identity_error])
        row[3][r.component - 1], row[4][r.component - 1] = r.whitened, r.explained
    at = {v: i for i, v in enumerate(sorted(by))}
    check([(at[i], *rest) for i, *rest in by.values()], vectors)
