"""P1 hash embedding and J1 exact k-NN."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions.embed import hash_embed
from tallyframe.operators.retrieval import knn, substring_search, top_k

# Golden values: texts and their 16-d hash embeddings from the reference's
# shipped snapshot file.
GOLDEN = [
    ('Open the assistant window to handle user tasks.',
     [0.09647798538208008, 0.10075471550226212, 0.004528301768004894, 0.023647798225283623, 0.0033962263260036707, 0.02138364687561989, 0.11823899298906326, 0.048805031925439835, 0.12352201342582703, 0.034213837236166, 0.05106918141245842, 0.04150943458080292, 0.10289308428764343, 0.09672956168651581, 0.040628932416439056, 0.09220125526189804]),
    ('Clipboard operations should update the shared clipboard buffer.',
     [0.14331065118312836, 0.04580498859286308, 0.014965986832976341, 0.1348450481891632, 0.024338623508810997, 0.040665153414011, 0.025547996163368225, 0.10249432921409607, 0.12214663624763489, 0.05593348294496536, 0.0247921384871006, 0.03250189125537872, 0.06409674882888794, 0.12577475607395172, 0.042328041046857834, 0.00045351474545896053]),
    ('Settings persist user preferences such as volume or theme.',
     [0.08445475995540619, 0.08665893226861954, 0.03399071842432022, 0.06078886240720749, 0.016241298988461494, 0.06345707923173904, 0.009512760676443577, 0.09211137145757675, 0.10962876677513123, 0.07505800575017929, 0.10545243322849274, 0.09675174206495285, 0.06832946836948395, 0.05429234355688095, 0.0283062644302845, 0.014965197071433067]),
    ('Logs capture a timeline of actions executed by the agent.',
     [0.025341615080833435, 0.006086956709623337, 0.09080745279788971, 0.013540372252464294, 0.10906832665205002, 0.08534161746501923, 0.055155280977487564, 0.11552795022726059, 0.12037266790866852, 0.023975154384970665, 0.016024844720959663, 0.022857142612338066, 0.052422359585762024, 0.07267080992460251, 0.08422360569238663, 0.1065838485956192]),]


def test_hash_embed_matches_golden(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN], "text string")
    got = [r.e for r in df.select(hash_embed(F.col("text")).alias("e")).collect()]
    for (_, want), g in zip(GOLDEN, got):
        assert np.max(np.abs(np.array(g, dtype=np.float32) - np.array(want, dtype=np.float32))) == 0.0


def test_hash_embed_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",)], "text string")
    rows = df.select(hash_embed(F.col("text")).alias("e")).collect()
    assert rows[0].e is None
    assert len(rows[1].e) == 16 and abs(sum(rows[1].e) - 1.0) < 1e-6


def _brute(q, c, k):
    out = []
    for qi, qv in q:
        d = sorted(((float(np.sum((np.array(qv, np.float64) - np.array(cv, np.float64)) ** 2)), ci) for ci, cv in c))
        out += [(qi, r + 1, ci, dd) for r, (dd, ci) in enumerate(d[:k])]
    return out


def test_knn_ties_and_bounds(spark):
    corpus = [(i, [float(i % 3), 0.0]) for i in range(10)]   # repeated vectors -> ties
    queries = [(100, [0.0, 0.0]), (101, [2.0, 0.1])]
    c = spark.createDataFrame(corpus, "pos long, embedding array<double>")
    q = spark.createDataFrame(queries, "qid long, embedding array<double>")
    got = sorted(tuple(r) for r in knn(q, c, 4).collect())
    want = sorted(_brute(queries, corpus, 4))
    assert [(a, b, c_) for a, b, c_, _ in got] == [(a, b, c_) for a, b, c_, _ in want]
    # k larger than the corpus gives the whole corpus
    assert knn(q, c, 50).count() == 20
    # empty corpus -> no rows
    assert knn(q, c.filter(F.lit(False)), 3).count() == 0


def test_knn_blocked_query_side_equals_single_pass(spark):
    rng = np.random.default_rng(7)
    corpus = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    queries = [(1000 + j, rng.normal(size=8).tolist()) for j in range(37)]
    c = spark.createDataFrame(corpus, "pos long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "qid long, embedding array<double>")
    one = sorted(tuple(r) for r in knn(q, c, 3).collect())
    blocked = sorted(tuple(r) for r in knn(q, c, 3, corpus_slice=5, max_pivots=4).collect())
    assert one == blocked
    assert [(a, b, c_) for a, b, c_, _ in one] == [(a, b, c_) for a, b, c_, _ in sorted(_brute(queries, corpus, 3))]


def test_substring_search_first_k_by_position(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["Alpha beta", "gamma ALPHA", "delta", "alphabet", "x"])], "pos long, text string")
    qs = spark.createDataFrame([(1, "alpha"), (2, "zzz"), (3, "")], "qid long, query string")
    got = sorted((r.qid, r.rank, r.pos) for r in substring_search(docs, qs, 2).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (3, 1, 0), (3, 2, 1)]


def test_substring_search_equals_a_scan(spark, monkeypatch):
    import random

    from tallyframe.operators import retrieval
    monkeypatch.setattr(retrieval, "_BLOCK", 3)
    rng = random.Random(5)
    words = ["alpha", "Beta", "gam", "gamma", "x", "été", "ÉTÉ", "1", "12", "the"]
    gaps = [" ", ", ", "\n", "--", " (", "."]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "the"]
    asked = [t[a:a + rng.randint(1, 25)] for t in texts[:150] if t for a in [rng.randrange(len(t))]] + ["", None, "the", " the ", "not there at all", "alpha not there", ",", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(asked)), "qid long, query string")
    got = sorted((r.qid, r.rank, r.pos) for r in substring_search(docs, queries, 4).collect())
    want = []
    for i, q in enumerate(asked):
        found = [p for p, t in enumerate(texts) if t is not None and q is not None and q.lower() in t.lower()][:4]
        want += [(i, rank, p) for rank, p in enumerate(found, 1)]
    assert got == sorted(want)


def test_top_k_stable(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(6)], "pos long, score double")
    assert [r.pos for r in top_k(df, 3, "score", tie="pos").collect()] == [0, 2, 4]


def test_knn_answer_does_not_depend_on_other_queries(spark):
    rng = np.random.default_rng(3)
    near = lambda n: 1000 + 1e-4 * rng.normal(size=(n, 16))  # noqa: E731  far from the origin and close together
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near(300))], "pos long, embedding array<double>")
    few, many = near(40), near(10_000)
    s = "qid long, embedding array<double>"
    alone = knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(few)], s), corpus, 3).collect()
    rows = [(i, v.tolist()) for i, v in enumerate(few)] + [(100 + i, v.tolist()) for i, v in enumerate(many)]
    among = knn(spark.createDataFrame(rows, s), corpus, 3).where("qid < 100").collect()
    assert sorted(map(tuple, alone)) == sorted(map(tuple, among)) and len(alone) == 120
    c = {r.pos: np.array(r.embedding) for r in corpus.collect()}
    for i, v in enumerate(few):
        d = sorted((sum((v[j] - x[j]) ** 2 for j in range(16)), p) for p, x in c.items())[:3]
        assert [(r.cid if hasattr(r, "cid") else r.pos) for r in sorted(alone, key=lambda r: r.rank) if r.qid == i] == [p for _, p in d]


def test_knn_compares_over_the_shorter_width(spark):
    c = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 5.0, 9.0]), ("c", [3.0]), ("d", None), ("long-name", [1.0, 2.0, 3.0])], "pos string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("y", [3.0]), (None, [0.0])], "qid string, embedding array<double>")
    got = {(r.qid, r.rank): (r.pos, r.dist) for r in knn(q, c, 4).collect()}
    assert [got[("x", i)] for i in (1, 2, 3, 4)] == [("a", 0.0), ("long-name", 0.0), ("c", 4.0), ("b", 45.0)]
    assert [got[("y", i)] for i in (1, 2, 3, 4)] == [("c", 0.0), ("a", 4.0), ("b", 4.0), ("long-name", 4.0)]
    assert got[(None, 1)] == ("a", 1.0)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_knn_leaves_out_cells_and_stays_exact(spark, k):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)), np.repeat(centres[:1], 400, axis=0)])  # a crowd of equal vectors
    q = np.concatenate([x[::40], rng.normal(size=(20, 8)) * 30])
    count = spark.sparkContext.accumulator(0)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, embedding array<double>")
    got = {(r.qid, r.rank): (r.pos, r.dist) for r in knn(queries, corpus, k, corpus_slice=150, compared=count).collect()}
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    for i in range(len(q)):
        for rank, pos in enumerate(np.lexsort((np.arange(len(x)), np.round(d[i], 9)))[:k], 1):
            assert abs(got[(i, rank)][1] - d[i, pos]) < 1e-9 and abs(d[i, got[(i, rank)][0]] - d[i, pos]) < 1e-9
    crowd = [got[(i, 1)][0] for i in range(len(q)) if (q[i] == centres[0]).all()]
    assert crowd and set(crowd) == {900}  # the smallest id of the equal ones
    assert 0 < count.value < 0.4 * d.size


def test_knn_with_entries_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [[0.0, 1.0], [nan, 1.0], [inf, 0.0], [3.0, 4.0], [0.0, 1.5], [1e200, 0.0]]
    c = spark.createDataFrame(list(enumerate(vecs)), "pos long, embedding array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [nan, 0.0]), (2, [inf, 1.0])], "qid long, embedding array<double>")
    got = {}
    for r in knn(q, c, 6, max_pivots=2).collect():
        got.setdefault(r.qid, []).append((r.rank, r.pos, r.dist))
    assert [p for _, p, _ in sorted(got[0])][:3] == [0, 4, 3] and all(len(v) == 6 for v in got.values())


def test_pairs_left_out_by_the_product_are_no_neighbours():
    from tallyframe.operators.retrieval import _lengths, _maybe_near, _of_pairs, _squared
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(400, 8)), np.full((3, 8), 1e8) + rng.normal(size=(3, 8)), [[np.nan] * 8, [np.inf] * 8]])
    rows[50:60] = rows[0]
    q = rows[[0, 5, 400, 403]]
    d = _squared(q, rows)
    i, j = _maybe_near(q, rows, _lengths(rows), np.full(len(q), np.inf), 5)
    near = set(zip(i.tolist(), j.tolist(), strict=True))
    for a in range(len(q)):
        kth = np.sort(d[a])[4]
        assert all((a, b) in near for b in range(len(rows)) if not d[a, b] > kth)
    assert len([1 for a, _ in near if a == 1]) < 20  # only those are compared by the exact formula
    assert np.array_equal(_of_pairs(q[i], rows[j]), d[i, j], equal_nan=True)


def test_a_large_query_side_meets_the_corpus_in_many_tasks(spark):
    n = 10_000
    e = spark.range(n).select(F.col("id").alias("pos"), F.array((F.col("id") % 100).cast("double"), F.floor(F.col("id") / 100).cast("double")).alias("embedding"))
    r = knn(e.withColumnRenamed("pos", "qid"), e, 2)
    assert "Exchange hashpartitioning(g" in r._jdf.queryExecution().toString() and r.count() == 2 * n
    assert r.where("rank = 1 and qid <> pos").count() == 0 and r.where("rank = 2 and dist <> 1").count() == 0
    parts = [line for line in r._jdf.queryExecution().optimizedPlan().toString().split("\n") if "RepartitionByExpression [g" in line]
    assert int(parts[0].rsplit(",", 1)[-1].strip(" ]")) >= 4
