"""Fill-in-the-middle against a plain line-by-line version."""

import hashlib
import random
import re

import pytest
from brute import awkward_documents, empty_like

from tallyframe.llm import infill
from tallyframe.llm.queries import op13_fill_in_middle

SF = "/root/testdata/sf0.01"


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(5)
    texts = ["", "\n", "a", "a\n", "\n\n\n", "x<P>y", "a <S", "<", "<\n<S", "P>\n<", "é中😀\n" * 4000, "z" * 30_000, ("line\n" * 300 + "w" * 9000) * 3]
    for _ in range(150):
        texts.append("".join(rng.choice("ab<SPM>é\n 中😀") for _ in range(rng.choice([3, 40, 700, 4000]))))
    shared = "".join(rng.choice("abcdefgh \n") for _ in range(5000))
    return texts + [f"start {i}\n" + shared + f"\nend {i}" for i in range(20)]


def test_cuts_and_forms_of_odd_texts():
    chunks = infill.Chunks()
    for i, text in enumerate(odd_texts()):
        n, form, a, b, out = infill.transform_text(text.encode(), str(i), chunks)
        assert (n, form, a, b, out.decode()) == plain(i, text)


def test_chunks_are_bounded_cover_the_text_and_follow_its_content():
    rng = random.Random(9)
    shared = bytes(rng.randrange(256) for _ in range(60_000))
    for text in (shared, b"", b"x" * 100_000, shared * 30):
        ends = infill.chunk_ends(text)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert sum(sizes) == len(text) and all(0 < s <= infill.LARGEST for s in sizes)
    pieces = [{t[a:b] for a, b in zip([0, *e], e)} for t in (b"head" + shared, b"another head" * 70 + shared) for e in [infill.chunk_ends(t)]]
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])


def test_a_slice_border_changes_no_chunk(monkeypatch):
    text = random.Random(2).randbytes(50_000)
    want = infill.chunk_ends(text)
    monkeypatch.setattr(infill, "SLICE", 700)
    assert infill.chunk_ends(text) == want


def test_memory_is_bounded_and_a_forgotten_chunk_is_counted_again(monkeypatch):
    monkeypatch.setattr(infill, "MEMORY", 5000)
    chunks = infill.Chunks()
    for i, text in enumerate(odd_texts()):
        assert infill.transform_text(text.encode(), str(i), chunks)[4].decode() == plain(i, text)[4]
        assert chunks.held <= max(5000, infill.LARGEST)


@pytest.mark.parametrize("rate,spm", [(100, 50), (0, 50), (100, 0), (60, 100)])
def test_outputs_restore_to_their_texts(spark, rate, spm):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = infill.infill(docs, rate=rate, spm=spm).withColumn("back", infill.restored("output", "form")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.back == texts[r.id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.id, texts[r.id], rate, spm)


def test_awkward_and_empty_rows(spark):
    docs = awkward_documents(spark)
    got = sorted(map(str, ((r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.infill(docs).collect())))
    assert got == sorted(map(str, ((r.doc_id, *plain(r.doc_id, r.text)) for r in docs.collect())))
    assert infill.infill(empty_like(docs)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_fill_in_middle(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, a, b, out = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, a, b)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
