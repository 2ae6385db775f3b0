"""Toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams; its embedding is the average of
their vectors, and a linear softmax turns it into the probability that the
word is toxic. A document is toxic if any of its distinct words is (noisy-or
over the words), so one insult in a long text is not averaged away. N-gram
vectors and softmax are trained jointly in numpy, by gradient steps on the
document labels; a misspelling that was never seen shares most n-grams with
the word it stands for. During training a part of each word's n-grams is left
out at random, which spreads a word's weight over all of them, and a part of
the words of toxic documents, so that each insult is learned by itself and
not explained away by the others beside it.

Training takes a bounded sample of labelled documents (``SAMPLE`` expected
rows of at most ``MAX_CHARS`` characters; longer ones are scored but not
learned from). Scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

SAMPLE = 4_000
MAX_CHARS = 50_000
BUCKET_BITS = 17
SIZES = (3, 4, 5)
DIM = 8
_WORD = re.compile(r"\w+")
#: Words that a worker remembers the scores of before it starts afresh.
MEMORY = 300_000
#: Texts whose words are looked up together.
CHUNK = 256


def word_set(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(word number, bucket)`` of every character n-gram of every word, its
    borders marked; word numbers ascend."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "<" + "><".join(words) + ">" if words else ""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.cumsum(size)[word] - np.arange(len(code)) if len(words) else np.empty(0, np.int64)  # characters from here to the word's end
    owners, buckets = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        m = max(0, len(code) - n + 1)
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:n - 1 + m]
        if n in SIZES:
            at = np.flatnonzero(left[:m] >= n)
            x = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            owners.append(word[at])
            buckets.append((x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


class Model:
    """``weight`` per n-gram bucket (its vector times the softmax direction)
    and ``bias``: all that scoring needs of the trained pair."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)
        self._memory: dict[str, float] = {}

    def __getstate__(self):
        return {"weight": self.weight, "bias": self.bias, "_memory": {}}

    def _learn(self, words: list[str]) -> None:
        """Remember -log of the probability that a word is not toxic."""
        owner, bucket = subwords(words)
        n = np.bincount(owner, minlength=len(words))
        mean = np.bincount(owner, self.weight[bucket], len(words)) / np.maximum(n, 1)
        self._memory.update(zip(words, np.logaddexp(0.0, self.bias + mean).tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        """Probability that a text is toxic: 1 minus the product over its
        distinct words. ``CHUNK`` texts at a time, so that a worker holds the
        words of few texts beside those it remembers."""
        out = []
        for i in range(0, len(texts), CHUNK):
            sets = [word_set(t) for t in texts[i:i + CHUNK]]
            if len(self._memory) > MEMORY:
                self._memory.clear()
            self._learn(sorted(set().union(*sets).difference(self._memory)))
            get = self._memory.__getitem__
            out += [-math.expm1(-math.fsum(map(get, s))) for s in sets]  # the exact sum: the order of a set does not matter
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def train(docs: list[tuple[list[str], int]], **rule) -> Model:
    """``train_indexed`` for ``(words, label)`` documents."""
    vocab = sorted({w for words, _ in docs for w in words})
    index = {w: i for i, w in enumerate(vocab)}
    sets = [sorted({index[w] for w in words}) for words, _ in docs]
    doc = np.repeat(np.arange(len(docs)), [len(x) for x in sets])
    return train_indexed(doc, np.array([w for x in sets for w in x], np.int64), vocab, np.array([y for _, y in docs], float), **rule)


def train_indexed(doc: np.ndarray, word: np.ndarray, vocab: list[str], y: np.ndarray, dim: int = DIM, epochs: int = 80, rate: float = 0.05,
                  drop: float = 0.3, word_drop: float = 0.5, decay: float = 1e-5, min_docs: int = 2, seed: int = 7) -> Model:
    """Joint full-batch Adam steps on n-gram vectors, softmax weights and bias.

    Document ``doc[i]`` holds word ``vocab[word[i]]`` (each pair once), and
    ``y`` are the labels. Words of fewer than ``min_docs`` documents are not
    learned from. Where there are not both labels, or no such word, the score
    is one for all texts with a word: about the only or more frequent label."""
    weight = np.zeros(1 << BUCKET_BITS)
    often = np.bincount(word, minlength=len(vocab)) >= min_docs
    pairs = often[word]
    if len(y) == 0 or y.min() == y.max() or not pairs.any():
        return Model(weight, 30.0 if len(y) and y.mean() > 0.5 else -30.0)
    number = np.cumsum(often) - 1
    doc_of, in_doc = doc[pairs], number[word[pairs]]
    kept = [w for w, o in zip(vocab, often, strict=True) if o]
    word_of, bucket = subwords(kept)
    used, gram_of = np.unique(bucket, return_inverse=True)
    word_starts = np.flatnonzero(np.r_[True, np.diff(word_of) > 0])  # every word has an n-gram: its borders count
    by_gram = np.argsort(gram_of, kind="stable")
    gram_starts = np.flatnonzero(np.r_[True, np.diff(gram_of[by_gram]) > 0])

    rng = np.random.default_rng(seed)
    z = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    v = rng.normal(0, 1.0, (dim, 2)).astype(np.float32)
    bias = np.log(max(y.mean(), 1e-3) / max(1.0, len(doc_of) / len(y)))
    state = [[np.zeros_like(z), np.zeros_like(z)], [np.zeros_like(v), np.zeros_like(v)], [np.zeros(1), np.zeros(1)]]
    for step in range(1, epochs + 1):
        mask = (rng.random(len(gram_of), dtype=np.float32) >= drop).astype(np.float32)
        size = np.maximum(1.0, np.add.reduceat(mask, word_starts))
        e = np.add.reduceat(z[gram_of] * mask[:, None], word_starts) / size[:, None]
        logits = e @ v
        delta = logits[:, 1] - logits[:, 0] + bias
        p = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        here = rng.random(len(doc_of), dtype=np.float32) >= np.where(y[doc_of] == 1, word_drop, 0.0)
        total = np.bincount(doc_of, np.logaddexp(0.0, delta)[in_doc] * here, len(y))
        prob = np.clip(-np.expm1(-total), 1e-6, 1 - 1e-6)
        # log-likelihood of the label with respect to a word's log-odds
        pull = np.where(y == 1, (1 - prob) / prob, -1.0)
        g_delta = p * np.bincount(in_doc, pull[doc_of] * here, len(kept)) / len(y)
        g_logits = np.stack([-g_delta, g_delta], axis=1).astype(np.float32)
        g_v = e.T @ g_logits - decay * v
        g_e = (g_logits @ v.T) / size[:, None]
        g_z = np.add.reduceat((g_e[word_of] * mask[:, None])[by_gram], gram_starts) - decay * z
        for (m1, m2), x, g in zip(state, (z, v, None), (g_z, g_v, np.array([g_delta.sum()])), strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            up = rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
            if x is None:
                bias += float(up[0])
            else:
                x += up.astype(np.float32)
    weight[used] = z @ (v[:, 1] - v[:, 0])
    return Model(weight, bias)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [sorted(word_set(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words, pa.list_(pa.string())), batch.column("label")], names=["id", "words", "label"])


def remainder(id_col: str):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on labelled documents outside the held-out fold (remainder 0),
    drawn by a hash of the id. Both sides are cut to the sample before they
    are joined; what reaches the driver are its words."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1)).distinct()
    every = max(1, known.count() // sample)
    drawn = (F.pmod(F.xxhash64("id"), F.lit(every)) == 0) & (remainder("id") != 0)
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    both = text.where(drawn).join(known.where(drawn), "id").select("id", "text", "label")
    kind = both.schema["id"].dataType.simpleString()
    table = both.mapInArrow(_words, f"id {kind}, words array<string>, label int").toArrow()
    table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("label", "ascending")]))
    words = table.column("words").combine_chunks()
    size = np.asarray(pc.list_value_length(words), dtype=np.int64)
    coded = pa.chunked_array([pc.list_flatten(words)]).combine_chunks().dictionary_encode()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    vocab = coded.dictionary.to_pylist()
    order = np.array(sorted(range(len(vocab)), key=vocab.__getitem__), dtype=np.int64)  # the same numbers on every run
    rank = np.empty(len(vocab), np.int64)
    rank[order] = np.arange(len(vocab))
    return train_indexed(np.repeat(np.arange(len(size)), size), rank[np.asarray(coded.indices, dtype=np.int64)] if len(vocab) else np.empty(0, np.int64),
                         [vocab[i] for i in order], np.asarray(table.column("label"), dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``held_out``, ``score`` and
    ``predicted``. Null and empty texts, and texts without a word, score 0.
    Nothing but the text enters the score; repeated rows score alike; an empty
    table gives an empty result; extra columns are not read."""
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"), (remainder(id_col) == 0).alias("held_out"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array(model.scores(batch.column("text").to_pylist()), float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=["id", "held_out", "score", "predicted"])
    return src.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int")
