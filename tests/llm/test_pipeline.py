"""The pipeline, stage by stage and as a whole, against plain Python."""

from collections import Counter

import corpus_pipeline
import pytest
from brute import awkward_documents, base_spans, contamination, empty_like, mixture, quality, similar

from tallyframe.llm import decontaminate, pii
from tallyframe.llm import mixture as mixing

SF = "/root/testdata/sf0.01"


def plain(docs, bench, field):
    """docs: rows with doc_id, text, lang, source, n_chars; the stages in order."""
    docs = [d for d, (_, _, _, kept) in zip(docs, quality([(d["text"], d["lang"], d["source"]) for d in docs])) if kept]
    _, comp = similar([d["text"] for d in docs])
    first = {}
    for d, c in sorted(zip(docs, comp), key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0)):
        first.setdefault(c, d)
    docs = list(first.values())
    docs = [d for d in docs if contamination(d["text"], bench)[1] == 0]
    out = []
    for d in docs:
        base, extra = field.find([d["text"]])[0]
        assert sorted(base) == base_spans(d["text"])
        t = pii.mask_text(d["text"], base + extra)
        out.append(d | {"text": t, "n_chars": len(t) if t != d["text"] else d["n_chars"]})
    times = [t for _, _, t in mixture([(d["doc_id"], d["text"], d["source"]) for d in out])]
    return [d for d, n in zip(out, times) for _ in range(n)]


def key(d):
    return tuple(sorted((k, str(v)) for k, v in d.items()))


def test_whole_pipeline(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF)
    # the field is fitted on the stage's own input
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, SF)
    want = plain(docs, bench, pii.fit(kept))
    assert Counter(key(r.asDict()) for r in got.collect()) == Counter(map(key, want))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_and_empty_rows(spark, name, stage):
    docs = awkward_documents(spark)
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    out.collect()
    none = stage(spark, empty_like(docs), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_spans_are_cut_from_texts(spark):
    docs = spark.createDataFrame([(1, "Start here, One TWO three four five six seven eight nine ten! end été."), (2, "clean"), (None, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "été")], "item_id bigint, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, mode="span").collect()}
    assert got == {1: "Start here! end.", 2: "clean", None: None}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, None}


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixture(docs).toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most / 2 + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * rows["size"].sum()) < 1e-3 and (rows.taken <= 2 * rows["size"]).all()
    again = mixing.mixture(docs.repartition(5)).toPandas()
    assert dict(zip(rows.id, rows.taken)) == dict(zip(again.id, again.taken))


def test_mixture_against_plain_version(spark):
    docs = awkward_documents(spark, [(50 + i, "a b c " * (i + 1), "en", f"s{i % 3}") for i in range(40)])
    want = [(str(d.doc_id), n, round(t, 6), k * n) for d, (n, t, k) in zip(docs.collect(), mixture([(d.doc_id, d.text, d.source) for d in docs.collect()]))]
    assert Counter((str(r.id), r.size, round(r.target, 6), r.taken) for r in mixing.mixture(docs).collect()) == Counter(want)


def test_equal_rows_are_taken_by_count(spark):
    same = [(None, "word " * 10, "en", "a")] * 1000 + [(7, "other word", "en", "a")] * 333 + [(i, "one two three", "en", "b") for i in range(400)]
    docs = spark.createDataFrame(same, "doc_id bigint, text string, lang string, source string").repartition(6)
    rows = mixing.mixture(docs).toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most / 2 + 1e-6).all() and len(rows) == len(same)
    mixed = mixing.mix(docs)
    assert Counter(r.source for r in mixed.collect() for _ in r.text.split()) == {s: int(t) for s, t in by.taken.items()}


def test_a_large_bucket_is_refined(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 700, f"w{i % 900} " * (1 + i % 7), "en", f"s{i % 2}") for i in range(3000)], "doc_id bigint, text string, lang string, source string")
    want = Counter((r.id, r.size, r.taken) for r in mixing.mixture(docs).collect())
    monkeypatch.setattr(mixing, "SMALL", 0)
    assert Counter((r.id, r.size, r.taken) for r in mixing.mixture(docs).collect()) == want


def test_oracle_is_absent_because_stages_are_iterative():
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_dedup", "benchmark_decontamination", "personal_data", "source_mix"]
