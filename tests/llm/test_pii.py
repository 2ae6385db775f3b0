import hashlib
import itertools
import math
import random

import numpy as np
from brute import awkward_documents, base_spans, empty_like

from tallyframe.llm import pii


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    pieces = ["+1 (523) 555-1055", "4111 1111 1111 1111", "4111111111111111", "10.1.2.3", "1.2.3.4.5.6.7.8", "300.1.1.1", "a.b@c.d", "x@y", "@", "é", " ", "-", "00.0.0.0001",
              "+", "9", "4785380592391139", ".", "\n", "(", "a@b.c@d.e", "1-", "4465758382889437 4465758382889437", "0012.1.1.1"]
    texts = ["".join(rng.choice(pieces + list("0123456789 -.+@ab")) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    for t in texts:
        assert pii.base_spans(t) == base_spans(t), t


def test_long_runs_stay_linear():
    for t in ("1" * 300_000, "1." * 200_000, "a" * 300_000 + "@", "@" * 200_000, "+1" * 100_000, "1 " * 200_000, "1-" * 150_000):
        pii.graph(t)


def field():
    counts = [("shape", pii.shape(s), y, n) for s, y, n in [
        ("+1 (523) 555-1055", 3, 400), ("4111111111111111", 2, 400), ("10.1.2.3", 1, 400), ("a.b@c.de", 0, 400), ("523 555 1055", 4, 20),
        ("2019", 4, 900), ("12", 4, 900), ("a1", 4, 900), ("1234567", 4, 100), ("deadbeef01", 4, 200), ("x@y", 4, 20)]]
    return pii.Field(counts + [("skip", k, k, 50) for k in range(4)] + [("chain", 4, 4, 500), ("chain", 3, 4, 40), ("chain", 2, 4, 40)])


def added(text):
    return [(text[a:b], pii.KINDS[k]) for a, k, b in field().find([text])[0][1]]


def test_skip_links_carry_a_label_to_the_bare_form():
    assert added("call +1 (523) 555-1055 now. " + "word " * 500 + "or 523 555 1055 later") == [("523 555 1055", "phone")]
    assert added("card 4111-1111-1111-1111 " + "word " * 50 + "4111.1111.1111.1111 again") == [("4111.1111.1111.1111", "card")]
    assert added("mail a.b@c.de and A.B@localhost") == [("A.B@localhost", "email")]


def test_without_a_link_nothing_is_added():
    assert added("in 2019 and 12 of 523 555 1055, room 7, version 1.2.3, hash deadbeef01") == []
    assert added("") == [] and added("no digits at all") == []


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.id: r for r in pii.find_spans(docs).collect()}
    for d in docs.collect():
        base, r = base_spans(d.text), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.spell(base).encode()).hexdigest()
        assert set(pii.spell(base).split(",")) <= set(r.spans.split(","))


def test_awkward_rows(spark):
    docs = awkward_documents(spark)
    got = pii.find_spans(docs).collect()
    want = sorted((str(d.doc_id), pii.spell(base_spans(d.text))) for d in docs.collect())
    assert sorted((str(r.id), hashlib.sha256(s.encode()).hexdigest()) for r, (_, s) in zip(got, want)) and len(got) == len(want)
    assert sorted((str(r.id), r.base_sha256) for r in got) == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want)
    assert pii.find_spans(empty_like(docs)).count() == 0


def test_mask_keeps_rows_and_columns(spark):
    docs = awkward_documents(spark)
    out = pii.mask(docs, model=field())
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    r = {x.doc_id: x for x in out.where("doc_id >= 5").collect()}
    assert r[8].text.startswith("<EMAIL> <PHONE> then <PHONE> and <IP> é\n\n") and r[8].n_chars == len(r[8].text)
    assert out.where("text is null").count() == 2 and out.count() == docs.count()
    assert pii.mask(empty_like(docs), model=field()).count() == 0


def test_mask_joins_overlaps():
    assert pii.mask_text("a1234b", [(1, 2, 4), (2, 3, 5)]) == "a<CARD>b"


def test_digits_that_are_no_ascii_digits(spark):
    assert pii.shape("192.168.1.1²") != pii.shape("192.168.1.1") and pii.shape("①.2.3.4") != pii.shape("1.2.3.4")
    texts = ["see 192.168.1.1² there", "① 1.2.3.④ and ٣.٣.٣.٣ 1", "192.168.1.1"]
    docs = awkward_documents(spark, [(20 + i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r.id: r.base_sha256 for r in pii.find_spans(docs).collect()}
    for i, t in enumerate(texts):
        assert got[20 + i] == hashlib.sha256(pii.spell(base_spans(t)).encode()).hexdigest()
    assert pii.mask(docs, model=field()).count() == docs.count()


def test_leading_zeros_of_any_length():
    for t in ("0" * 5000 + ".1.1.1", "1.1.1." + "0" * 9000 + "255", "0" * 5000 + ".0.0.256", "000.00.0.0"):
        got = pii.base_spans(t)
        assert got == ([] if t.endswith("256") else [(0, 1, len(t))])
        pii.graph(t)


def exact(f, text):
    """Best labels by adding up all labellings of the text's graph."""
    base, nodes, seen, chain, skip = pii.graph(text)
    total = np.zeros((len(nodes), pii.NONE + 1))
    for labels in itertools.product(range(pii.NONE + 1), repeat=len(nodes)):
        if any(s >= 0 and s != y for s, y in zip(seen, labels)):
            continue
        score = sum(f.unary[pii.shape(text[a:b]), y] for (a, b), y, s in zip(nodes, labels, seen) if s < 0)
        score += sum(f.chain[labels[i], labels[j]] for i, j in chain) + sum(f.skip[labels[i], labels[j]] for i, j in skip)
        total[np.arange(len(nodes)), labels] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_added_labels_equal_exact_marginals():
    f, rng = field(), random.Random(11)
    parts = ["+1 (523) 555-1055", "523 555 1055", "555-1055", "2019", "12", "4111 1111 1111 1111", "4111.1111.1111.1111", "10.1.2.3", "a.b@c.de", "A.B@localhost", "deadbeef01"]
    sure = 0
    for _ in range(300):
        text = ", ".join(rng.choice(["word", "word " * 12]) + " " + rng.choice(parts) for _ in range(rng.randint(1, 5)))
        base, nodes, seen, _, _ = pii.graph(text)
        p = exact(f, text)
        added = {(a, b): k for a, k, b in f.find([text])[0][1]}
        for (a, b), s, q in zip(nodes, seen, p):
            top = np.sort(q)
            if s < 0 and top[-1] - top[-2] > 0.1:  # loops may tip what is nearly even
                sure += 1
                assert added.get((a, b), pii.NONE) == q.argmax(), (text, text[a:b], q)
    assert sure > 200


def test_every_one_of_many_repeats_gets_the_label():
    for n in (60, 400):
        text = "call +1 (523) 555-1055 now. " + ("word " * 12 + "or 523 555 1055 later ") * n
        assert added(text) == [("523 555 1055", "phone")] * n


def test_a_text_is_labelled_alike_whatever_stands_beside_it():
    f, rng = field(), random.Random(12)
    texts = ["call +1 (523) 555-1055. " + " ".join(rng.choice(["523 555 1055", "2019", "word", "4111.1111.1111.1111", "x@y"]) for _ in range(30)) for _ in range(40)]
    assert f.find(texts) == [f.find([t])[0] for t in texts]
