"""Packing: ids against the tokenizer library, plans and places against a
plain walk over every piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import awkward_documents, empty_like
from tokenizers import Tokenizer

from tallyframe.llm import packing
from tallyframe.llm.common import written
from tallyframe.llm.queries import op12_best_fit_packing

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def library(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return packing.Encoder(f.read())


def test_ids_equal_the_library(encoder):
    assert encoder.by_words
    letters = "aÉé'sS'T’ß ²½½_-­ıİΣσς中ñ́é \u0085\x1c\x00!?!'ll12<|endoftext|>ªµºǅ \n\tÅẞﬁ"
    rng = random.Random(1)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    texts += [x for c in range(0x250) for x in (chr(c), chr(c) + "a", f"a{chr(c)}'s1")] + ["x" * 5000, "<|startoftext|>a <|endoftext|>", "don't DON'T 'summer"]
    for t in texts * 2:
        assert ids_of(encoder.ids(t.encode())) == library(t), repr(t)


def test_a_full_memory_changes_no_ids(encoder, monkeypatch):
    monkeypatch.setattr(packing, "MEMORY", 3)
    small = packing.Encoder(WHOLE.to_str())
    words = ["one", "Two,", "three", "four-five", "ünf", "one", "six", "Two,", "中文", "one"]
    assert ids_of(small.ids(" ".join(words * 4).encode())) == library(" ".join(words * 4))
    assert len(small.words) <= 3 and len(small.old_words) <= 3


def test_another_kind_of_tokenizer_is_used_as_it_is():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        other = packing.Encoder(f.read())
    assert not other.by_words
    assert ids_of(other.ids("two  words\nhere".encode())) == other.whole.encode("two  words\nhere", add_special_tokens=False).ids


def walk(counts, capacity):
    """Every single piece of every length at its planned place."""
    places = defaultdict(list)
    for length, *rest in packing.plan(dict(counts), capacity):
        places[length].append(rest)
    found = defaultdict(list)
    for length, number in counts.items():
        for rank in range(number):
            first, each, sequence, offset = max(p for p in places[length] if p[0] <= rank)
            found[sequence + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    return found


def fewest(pieces, capacity):
    """Best number of sequences, by trying (few pieces)."""
    best = len(pieces)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= pieces[i]:
                rest = list(bins)
                rest.remove(b)
                put(i + 1, [*rest, b - pieces[i]])
        put(i + 1, [*bins, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    put(0, [])
    return best


def test_plans_are_gapless_and_pair_large_pieces_at_most_twice():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 10, 64, 100])
        top = rng.choice([capacity, max(1, capacity // 3)])
        counts = Counter(rng.randint(1, top) for _ in range(rng.choice([0, 1, 5, 60, 700])))
        found = walk(counts, capacity)
        assert sorted(found) == list(range(len(found)))
        assert Counter(n for v in found.values() for _, n in v) == counts
        for v in found.values():
            at = 0
            for offset, n in sorted(v):
                assert offset == at
                at += n
            assert at <= capacity and sum(3 * n > capacity for _, n in v) <= 2
        total = sum(n * c for n, c in counts.items())
        assert len(found) <= 1 + 1.25 * -(-total // capacity) or any(2 * n > capacity for n in counts)


def test_plans_are_the_best_or_one_more_in_a_tenth_of_tight_cases():
    rng = random.Random(4)
    more = 0
    for _ in range(120):
        pieces = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        found, best = len(walk(Counter(pieces), 20)), fewest(pieces, 20)
        assert best <= found <= best + 1
        more += found > best
    assert more <= 12


def test_a_plan_is_as_small_for_a_thousand_times_the_pieces():
    counts = Counter(random.Random(6).randint(1, 4096) for _ in range(3000))
    counts[1] = 50_000
    one, many = (packing.plan({n: c * k for n, c in counts.items()}) for k in (1, 1000))
    assert len(many) < 20_000 and len(many) < 2 * len(one)


def pieces_of(text, capacity):
    ids = [*library(text), 1]
    return [ids[i:i + capacity] for i in range(0, len(ids), capacity)]


def check(rows, docs, capacity):
    want = Counter((d, k, k * capacity, tuple(p)) for d, t in docs for k, p in enumerate(pieces_of(t, capacity)))
    assert Counter((r.id, r.piece, r.start, tuple(ids_of(r.ids))) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= capacity
    return by


@pytest.mark.parametrize("capacity", [5, 64, 4096])
def test_documents_are_packed_whole(spark, capacity):
    docs = awkward_documents(spark, [(100 + i, "some words here " * (i % 40), "en", "a") for i in range(150)] + [(500, None, None, None)] * 90).repartition(5)
    packed = packing.pack(written(packing.tokenized(docs, PATH, capacity=capacity), "t"), capacity)
    rows = packed.collect()
    by = check(rows, [(r.doc_id, r.text) for r in docs.collect()], capacity)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert set(whole) == set(by)
    for r in rows:
        assert whole[r.sequence_id].ids[4 * r.offset:4 * (r.offset + r.length)] == r.ids
    assert packing.pack(written(packing.tokenized(empty_like(docs), PATH), "t")).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op12_best_fit_packing(spark, SF).collect()
    want = Counter((d, k, 4096 * k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for d, t in docs.items() for k, p in enumerate(pieces_of(t, 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 4096
    assert len(by) <= 1.02 * sum(r.length for r in rows) / 4096 + 1
