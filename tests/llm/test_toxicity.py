import zlib

import numpy as np
import pytest
from brute import awkward_documents, empty_like

from tallyframe.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), sample=1500)


def test_held_out_accuracy(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    s = toxicity.score(docs, model).withColumnRenamed("id", "doc_id").join(labels, "doc_id").toPandas()
    assert [zlib.crc32(str(i).encode()) % 5 == 0 for i in s.doc_id] == s.held_out.tolist()
    assert ((s.score >= 0.5) == (s.predicted == 1)).all() and s.score.between(0, 1).all()
    h = s[s.held_out]
    pos, neg = h[h.toxic == 1].score.to_numpy(), h[h.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean() > 0.9
    assert (neg >= 0.5).mean() < 0.01 and (pos >= 0.5).mean() > 0.7


def test_misspelling_shares_subwords():
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    docs = [([*rng.choice(plain, 30), *(["horrible"] if i % 3 == 0 else [])], int(i % 3 == 0)) for i in range(300)]
    m = toxicity.train(docs)
    assert m.score("w1 w2 horrible w3") > 0.5 > m.score("w1 w2 w3 w4")
    assert m.score("w1 horribble w3") > 10 * m.score("w1 harvest w3")
    assert m.score("w1 w2 horrible w3") == toxicity.train(docs).score("w1 w2 horrible w3")


def test_no_labels_and_one_label():
    assert toxicity.train([]).score("some text") < 0.5
    assert toxicity.train([(["a"], 0)]).score("some text") < 0.5
    assert toxicity.train([(["a"], 1)]).score("some text") >= 0.5
    assert 0 <= toxicity.train([([], 1), ([], 0)]).score("") <= 1
    owner, bucket = toxicity.subwords(["a", "", "b\U0001f600c", "a"])
    assert owner.tolist() == [0, 2, 2, 2, 2, 2, 2, 3] and bucket[0] == bucket[-1] and len(toxicity.subwords([])[0]) == 0


def test_awkward_rows(spark, model):
    docs = awkward_documents(spark)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(r.score is not None and r.predicted in (0, 1) and r.held_out is not None for r in got)
    assert toxicity.score(empty_like(docs), model).count() == 0
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 0, None), (5, 0, 1)], "doc_id bigint, toxic int, quality int")
    assert toxicity.fit(docs, labels).score("x") is not None
    assert toxicity.fit(empty_like(docs), empty_like(labels)).score("x") < 0.5
