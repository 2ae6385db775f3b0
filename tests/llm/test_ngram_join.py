import random
from collections import Counter

import pytest
from brute import awkward_documents, empty_like, similar

from tallyframe.llm import ngram_join as N
from tallyframe.llm.common import connected_components


def check(df):
    docs = df.collect()
    links, comp = similar([d.text for d in docs])
    n = Counter(i for pair in links for i in pair)
    members = {}
    for i, c in enumerate(comp):
        members.setdefault(c, []).append(docs[i].doc_id)
    low = {c: min((x for x in m if x is not None), default=None) for c, m in members.items()}
    want = Counter((docs[i].doc_id, low[comp[i]], n[i]) for i in range(len(docs)))
    assert Counter((r.id, r.class_id, r.n_links) for r in N.similarity_classes(df).collect()) == want
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        (None if any(x is None for x in m) else low[c]) for c, m in members.items())


def test_documents_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    check(docs)
    assert N.similarity_classes(empty_like(docs)).count() == 0 and N.keep_one(empty_like(docs)).count() == 0


def test_group_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # near copies at similarities around the threshold
        w = list(base)
        for j in rng.sample(range(120), rng.randint(0, 6)):
            w[j] = f"x{rng.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(30)] + [(200 + i, " ".join(f"o{rng.randint(0, 400)}" for _ in range(50))) for i in range(20)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_threshold_is_exact():
    from fractions import Fraction

    import numpy as np
    a, b, c = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(2, 11, dtype=np.uint64)
    side = np.zeros(3, int)
    assert N._compare([a, b, c], side, True, Fraction(4, 5)).tolist() == [[False, True, False], [True, False, True], [False, True, False]]
    assert not N._compare([a, b, c], side, True, Fraction(801, 1000)).any()


@pytest.mark.parametrize("recall", [0.9, 0.99, 0.9999])
def test_bands_reach_recall(recall):
    b, r = N.choose_bands(0.8, recall)
    assert 1 - (1 - 0.8 ** r) ** b >= recall and b * r <= 200
    assert 1 - (1 - 0.8 ** (r + 1)) ** (200 // (r + 1)) < recall  # no wider band would do


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randint(0, 60), 1000 + rng.randint(0, 60)) for _ in range(40)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= (root[a], root[b]) != (m, m)
            root[a] = root[b] = m
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
