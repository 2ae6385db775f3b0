"""Packing documents into sequences of a fixed number of tokens.

Every document becomes token ids and an end id; only longer ones are cut into
pieces of the capacity. Which pieces share a sequence depends on nothing but
their lengths, so the plan is made on the histogram of the lengths (at most as
many rows as the capacity): pieces above a third of the capacity meet at most
twice in a sequence, the longest with the longest that still fits, and the
smaller ones go, longest first, into the tightest gap that takes them. Runs of
equal sequences are planned as one, so the plan is bounded by the capacity,
whatever the number of documents, and packs all documents together.

A piece finds its place by its rank among the pieces of its length: counted
within the task that made it, plus what the tasks before it have of the length.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of, written

CAPACITY = 4096
END_ID = 1
#: Half of the words, and of the parts of words, that a worker remembers, and
#: the bytes of the longest one it keeps.
MEMORY, LONGEST = 300_000, 64
#: The pre-tokenizer of a lower-case word-end vocabulary, on lower-cased text
#: of Basic Latin, Latin-1 and Latin Extended-A (fixed by the vocabulary file).
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w]|_)+")
#: Text on which the shortcut is taken: no composition, case rule or white space of its own.
_PLAIN = re.compile(r"[!-~¡-¬®-įı-ſ]+")
#: How the shortcut expects the vocabulary file to normalise and to cut.
_EXPECTED = ("Sequence(normalizers=[NFC(), Replace(pattern=Regex(\"\\s+\"), content=\" \"), Lowercase()])",
             "Sequence(pretokenizers=[Split(pattern=Regex(\"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+\"), behavior=Removed, invert=True), "
             "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])")


class Encoder:
    """Token ids of texts by a tokenizer file, equal to the library's for the
    whole text. A tokenizer that drops white space never looks across it, so a
    text is the row of its words; words, and for plain words their parts, are
    encoded once and remembered. Of a full memory the older half goes."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(file)
        self.by_words = (str(self.whole.normalizer), str(self.whole.pre_tokenizer)) == _EXPECTED
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = (chr(c) for c in range(0x180) if _PLAIN.fullmatch(chr(c)))
        self.spelled = {ord(c): letters.pre_tokenize_str(c)[0][0] for c in plain}
        self.added = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or r"(?!)")
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            found = self.old_parts.get(part)
            if found is None:
                spelled = part if part.isascii() else part.translate(self.spelled)
                found = b"".join([self.id_bytes[t.id] for t in self.whole.model.tokenize(spelled)])
            if len(part) <= LONGEST:
                if len(self.parts) >= MEMORY:
                    self.old_parts, self.parts = self.parts, {}
                self.parts[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        """The ids of a word that is not among the newer remembered ones."""
        found = self.old_words.get(word)
        if found is None:
            text = word.decode()
            if _PLAIN.fullmatch(text) and not self.added.search(text):
                text = text.lower()
                found = self._part(text) if text.isascii() and text.isalpha() else b"".join(map(self._part, _PARTS.findall(text)))
            else:
                found = self._encode(text)
        if len(word) <= LONGEST:
            if len(self.words) >= MEMORY:
                self.old_words, self.words = self.words, {}
            self.words[word] = found
        return found

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.by_words:
            return self._encode(text.decode())
        words, known, word = text.split(), self.words, self._word
        return b"".join([known.get(w) or word(w) for w in words])


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file)  # a worker that serves several tasks keeps what it remembers


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs``: ``id``, ``piece`` (from 0), ``start``,
    ``length``, ``ids`` (little-endian 32-bit numbers), and the piece's rank
    among those of its length in the task ``part`` that made it.

    ``tokenizer`` is the path of a tokenizer file, read on the driver and
    broadcast (a vocabulary). Null and empty texts are the end id alone.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).cast("binary").alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, part = _encoder(shared.value), defaultdict(int), TaskContext.get().partitionId()
        for batch in batches:
            row, piece, length, ids, rank = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                whole = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    cut = whole[at:at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    length.append(len(cut) // 4)
                    ids.append(cut)
                    rank.append(seen[len(cut)])
                    seen[len(cut)] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array(length, pa.int64()),
                 pa.array(ids, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=["id", "piece", "start", "length", "ids", "part", "rank"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids binary, part int, rank bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces of each length, as
    ``(length, first_rank, per_sequence, first_sequence, offset)``: pieces from
    ``first_rank`` on go ``per_sequence`` to a sequence, from ``first_sequence``
    on, one after the other from ``offset``."""
    left = {n: c for n, c in counts.items() if c > 0}
    placed: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # the gaps there are, ascending, and the runs (first, number) of sequences that have them
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    n_sequences = 0

    def put(length: int, number: int, each: int, first: int, offset: int) -> None:
        out.append((length, placed[length], each, first, offset))
        placed[length] += number
        left[length] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                insort(gaps, gap)
            runs[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1)
        mate = large[fits - 1] if fits else 0
        pairs = left[n] // 2 if mate == n else min(left[n], left.get(mate, 0))
        number = pairs or left[n]
        put(n, number, 1, n_sequences, 0)
        if pairs:
            put(mate, number, 1, n_sequences, n)
        leave(capacity - n - (mate if pairs else 0), n_sequences, number)
        n_sequences += number
        large = [x for x in large if left[x]]

    for n in sorted((n for n in left if left[n]), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):  # no gap takes it: a run of new sequences
                number = -(-left[n] // (capacity // n))
                leave(capacity, n_sequences, number)
                n_sequences += number
                continue
            gap = gaps[at]
            first, number = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            each = gap // n
            full = min(number, left[n] // each)
            if full:
                put(n, full * each, each, first, capacity - gap)
                leave(gap - each * n, first, full)
            if full < number:
                rest = min(left[n], each - 1) if left[n] < each else 0
                if rest:
                    put(n, rest, rest, first + full, capacity - gap)
                    leave(gap - rest * n, first + full, 1)
                leave(gap, first + full + bool(rest), number - full - bool(rest))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece once, no
    sequence above the capacity, its pieces gapless from 0.

    ``pieces`` is a written table with ``length`` (1 to the capacity), ``part``
    and ``rank`` as :func:`tokenized` yields them, and any further columns,
    which pass through. An empty table gives an empty result. Equal pieces take
    different places.
    """
    spark = pieces.sparkSession
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = np.array(sorted(plan(by_length, capacity)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(places)
    before = written(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n"), "pack-ranks")
    names = [c for c in pieces.columns if c not in ("part", "rank")]
    ranked = pieces.join(before.hint("merge"), ["length", "part"]).select(*names, (F.col("rank") + F.col("before")).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        keys = at[:, 0] << 46 | at[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__rank"))
            p = at[np.searchsorted(keys, length << 46 | rank, side="right") - 1]
            k = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(p[:, 3] + k // p[:, 2]), pa.array(p[:, 4] + k % p[:, 2] * length)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` (its pieces'
    ids in their order) and ``n_tokens``. A group is one sequence, so it is as
    small as the capacity."""
    g = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return g.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens")
