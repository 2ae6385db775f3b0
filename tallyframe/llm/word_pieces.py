"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with two roots, one for pieces that begin a word
and one for pieces that continue it. Every node knows the number of pieces
that greedy longest match takes off the text read so far when the next
character does not fit, and the node of the rest that remains to be matched
(its failure link). So a word is read once, character by character, and the
length of its greedy segmentation is added up without building a piece.

A word that no beginning fits can start with the bare word mark, where that is
a piece, and go on in the continuations; a character in no piece can count as
its bytes. Without these a word is one unknown token.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

#: A run of word characters, or one character that is neither that nor white space.
_WORD = re.compile(r"\w+|[^\w\s]")
#: Words that a worker remembers the counts of before it starts afresh.
MEMORY = 500_000
#: Trie nodes that are broadcast at most (about 1 GB of tables).
MAX_NODES = 4_000_000
START, REST = 0, 1


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """``(beginnings, continuations)`` of a piece vocabulary file in which a
    low line (U+2581) marks the beginning of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces = [model.id_to_piece(i) for i in ids]
    return [p[1:] for p in pieces if len(p) > 1 and p[0] == "▁"], [p for p in pieces if "▁" not in p]


def read_spelling(path: str) -> tuple[bool, bool]:
    """Whether the vocabulary file has the bare word mark, and all 256 bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return not model.is_unknown(model.piece_to_id("▁")), sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


class Automaton:
    """``count(word)``: pieces of the greedy longest match, or None if some
    part of the word is in no piece.

    With ``mark`` the bare word mark is a beginning of no characters that
    counts one; with ``by_bytes`` a character in no piece counts its UTF-8
    bytes."""

    def __init__(self, beginnings: Iterable[str], continuations: Iterable[str], mark: bool = False, by_bytes: bool = False):
        self.by_bytes = by_bytes
        self.next: list[dict[str, int]] = [{}, {}]
        ends = set()
        for root, pieces in ((START, beginnings), (REST, continuations)):
            for piece in pieces:
                at = root
                for c in piece:
                    to = self.next[at].get(c)
                    if to is None:
                        if len(self.next) >= MAX_NODES:
                            raise ValueError("the vocabulary is too large to broadcast")
                        to = self.next[at][c] = len(self.next)
                        self.next.append({})
                    at = to
                if piece:
                    ends.add(at)
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        if mark:
            self.fail[START], self.pops[START] = REST, 1
        queue = deque([START, REST])  # nearer to a root first: a link leads to a node of fewer characters
        while queue:
            node = queue.popleft()
            for c, to in self.next[node].items():
                queue.append(to)
                if to in ends:
                    self.fail[to], self.pops[to] = REST, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[to], self.pops[to] = self.next[at][c], popped
                elif by_bytes:
                    self.fail[to], self.pops[to] = REST, popped + len(c.encode())

    def count(self, word: str) -> int | None:
        at, n = START, 0
        for c in word:
            while (to := self.next[at].get(c)) is None:
                n += self.pops[at]
                at = self.fail[at]
                if at < 0:
                    if not self.by_bytes:
                        return None
                    n += len(c.encode())
                    to = REST
                    break
            at = to
        while at > REST:
            n += self.pops[at]
            at = self.fail[at]
            if at < 0:
                return None
        return n


def count_pieces(docs: DataFrame, vocabulary: str | tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text",
                 spelled: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_words``, ``n_tokens`` (a word
    that no pieces make up is one unknown token) and ``n_unknown``.

    ``vocabulary`` is a vocabulary file's path, read on the driver, or
    ``(beginnings, continuations)``. With ``spelled`` the file's bare word mark
    and byte pieces serve as well, so that every character is counted. Null and empty texts count 0; whole texts
    are read row by row, so repeated rows, null ids and extra columns do not
    matter; an empty table gives an empty result.
    """
    beginnings, continuations = read_pieces(vocabulary) if isinstance(vocabulary, str) else vocabulary
    mark, by_bytes = read_spelling(vocabulary) if spelled and isinstance(vocabulary, str) else (False, False)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(beginnings, continuations, mark, by_bytes))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memory = shared.value, {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column("text"):
                n = total = missing = 0
                for w in _WORD.findall(text.as_py()):
                    k = memory.get(w, -1)
                    if k == -1:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        k = memory[w] = automaton.count(w)
                    n += 1
                    if k is None:
                        missing += 1
                    else:
                        total += k
                words.append(n)
                tokens.append(total + missing)
                unknown.append(missing)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(x, pa.int64()) for x in (words, tokens, unknown)]],
                                             names=["id", "n_words", "n_tokens", "n_unknown"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint")
