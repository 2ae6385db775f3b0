import math

import numpy as np
import pytest
from brute import awkward_documents, empty_like, quality, statistics

from tallyframe.llm import quality as Q
from tallyframe.llm.common import written
from tallyframe.llm.queries import op7_quality_outliers


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6))


def check(docs, got):
    """Rows of the operator against the plain version, row by row per id and text."""
    want = quality([(d.text, d.lang, d.source) for d in docs])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    a = sorted(((str(d.doc_id), *[s[n] for n in names], f, k) for d, (s, f, _, k) in zip(docs, want)), key=str)
    b = sorted(((str(r.doc_id), *[r[n] for n in names], r.base_failed, r.kept) for r in got), key=str)
    assert a == b
    far = {}
    for d, (s, _, x, _) in zip(docs, want):
        far.setdefault((str(d.doc_id), s["n_words"]), []).append(x)
    for r in got:
        assert any(close(r.distance, x) for x in far[(str(r.doc_id), r.n_words)])


def test_documents_table_against_numpy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    check(docs, op7_quality_outliers(spark, sf).collect())


def run(df, **options):
    stats = written(Q.base_statistics(df.select("doc_id", "lang", "source", "text")).drop("text"), "t")
    return Q.judge(stats, ["lang", "source"], **options).collect()


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    check(docs.collect(), run(docs))
    assert run(empty_like(docs)) == []


def test_groups_of_their_own_and_shared(spark):
    rng = np.random.default_rng(1)

    def text(marks):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) + ("." if rng.random() < 0.1 else "") + marks for _ in range(60))

    rows = [(i, text(""), "en", "big", None) for i in range(120)] + [(200 + i, text("#"), "en", "tags", None) for i in range(60)]
    rows += [(300 + i, text(""), "en", f"small{i}", None) for i in range(5)] + [(400, text("###"), "en", "big", None), (401, text("###"), "xx", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = run(docs)
    check(docs.collect(), got)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in [*range(120), *range(200, 260), *range(300, 305)]) and not kept[400]


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {r.doc_id: (r.distance, r.kept) for r in run(docs)}
    assert a == {r.doc_id: (r.distance, r.kept) for r in run(docs.orderBy("text").repartition(7))}


@pytest.mark.parametrize("text", ["", "a", "a b c d e f g h", " ".join("abcdefgh") * 3, "x " * 50, "one\ntwo\none\n \n \ntwo two", "\x0b\x0c\r\x1c\x85 a",
                                  " ".join(f"w{i}" for i in range(30)) + " q " + " ".join(f"w{i}" for i in range(30)), "a b c d e f g h a b c d e f g h a b c d e f g h"])
def test_statistics_of_one_text(spark, text):
    r = Q.base_statistics(spark.createDataFrame([(text, 1)], "text string, n_words int"), prefix="s_").first()
    want = statistics(text)
    assert {k: r[f"s_{k}"] for k in want} == want and r.n_words == 1


def test_chi_square():
    assert math.isclose(Q.chi2_cdf(22.458, 6), 0.999, abs_tol=1e-5) and math.isclose(Q.chi2_cdf(2.0, 2), 1 - math.exp(-1), abs_tol=1e-12)


@pytest.mark.parametrize("bad", ["w# " * 3 + "a b c # d e f g h i j k l m n o p q r s t u v w x y z", "AB. CDE; FGH, IJ! " + " ".join(f"KLMNOPQRSTUVW{chr(65 + i)}" for i in range(20))])
def test_a_third_of_a_group_is_one_bad_text(spark, bad):
    rng = np.random.default_rng(3)

    def text():
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(60))

    rows = [(i, text(), "en", "big", None) for i in range(120)] + [(200 + i, bad, "en", "big", None) for i in range(60)]
    rows += [(400 + i, text(), "en", "clean", None) for i in range(60)]
    got = run(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    assert not any(r.base_failed for r in got) and {r.doc_id for r in got if r.kept} == {i for i, *_ in rows if not 200 <= i < 300}


def test_small_sources_with_two_fifths_of_bad_rows(spark):
    rng = np.random.default_rng(4)

    def text():
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) + ("." if rng.random() < 0.1 else "") for _ in range(60))

    bad = "AB. CDE; FGH, IJ! " + " ".join(f"KLMNOPQRSTUVW{chr(65 + i)}" for i in range(20))
    rows = [(100 * s + i, bad if i < 12 else text(), "en", f"s{s}", None) for s in range(10) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = run(docs)
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows if r[1] != bad}
    check(docs.collect(), got)
