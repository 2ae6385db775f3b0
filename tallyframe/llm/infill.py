"""Fill-in-the-middle transformation with memoized content-defined chunks.

A text is a row of lines; two cuts between lines, drawn from a digest of the
document's id, part it into prefix, middle and suffix. The cuts are found
without walking the lines: a rolling hash over the UTF-8 bytes cuts the text
into chunks that depend on content alone, so copies, templates and shared
passages fall into equal chunks. The summary of a chunk (line ends, code
points, where its lines end) is kept in a cache keyed by the chunk's bytes, so
an entry serves only a chunk of equal content. Adding up the chunks' counts
leads to the chunk that holds a cut, and its summary to the place inside.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

#: Bytes of the rolling window, and the least, mean and largest bytes of a chunk.
WINDOW, LEAST, MEAN, LARGEST = 16, 256, 1024, 8192
#: Bytes that are hashed at once, whatever the text's length.
SLICE = 1 << 20
#: Bytes of chunk content a worker remembers before it starts afresh.
MEMORY = 32 << 20
MARKS = ("<P>", "<S>", "<M>")
_STEP = 0x9E3779B1


def _byte_values() -> np.ndarray:
    """A fixed odd-looking 32-bit value for each byte."""
    return np.frombuffer(b"".join(hashlib.md5(bytes([i])).digest()[:4] for i in range(256)), "<u4")


_VALUES = _byte_values()


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each place, by doubling."""
    h, width, factor = _VALUES[data], 1, _STEP
    while width < WINDOW:
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
        width *= 2
    return h


def chunk_ends(text: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text. Equal runs of bytes are
    cut alike once their chunks have fallen into step; a run without a cut is
    cut every ``LARGEST`` bytes."""
    ends, last, n = [], 0, len(text)
    data = np.frombuffer(text, np.uint8)
    for start in range(0, n if n > LEAST else 0, SLICE):
        lead = min(start, WINDOW)
        h = _rolling(data[start - lead:start + SLICE])[lead:]
        for at in (np.flatnonzero((h & np.uint32(MEAN - 1)) == 0) + (start + 1)).tolist():
            while at - last > LARGEST:
                last += LARGEST
                ends.append(last)
            if at - last >= LEAST:
                last = at
                ends.append(last)
    while n - last > LARGEST:
        last += LARGEST
        ends.append(last)
    return ends if last == n else [*ends, n]


class Chunks:
    """Summaries of chunks by their content: ``(line ends, code points, code
    points before each line's end, bytes before each line's end)``."""

    def __init__(self):
        self.known: dict[bytes, tuple] = {}
        self.held = 0

    def of(self, chunk: bytes) -> tuple:
        found = self.known.get(chunk)  # a dict compares the bytes, not the hash alone
        if found is None:
            data = np.frombuffer(chunk, np.uint8)
            at = np.flatnonzero(data == 10) + 1
            first = (data & 0xC0) != 0x80  # bytes that begin a code point
            chars = np.cumsum(first) if len(at) else None
            found = len(at), int(first.sum()), chars[at - 1].tolist() if len(at) else [], at.tolist()
            if self.held + len(chunk) > MEMORY:
                self.known.clear()
                self.held = 0
            self.known[chunk] = found
            self.held += len(chunk)
        return found


def draws(seed: str, key: str) -> list[int]:
    """Four 32-bit numbers of a document."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transform_text(text: bytes, key: str, chunks: Chunks, seed: str = "7", rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, bytes]:
    """``(lines, form, prefix code points, middle code points, output)``."""
    ends = chunk_ends(text)
    sums = [chunks.of(text[a:b]) for a, b in zip([0, *ends], ends)]
    lines = list(accumulate((s[0] for s in sums), initial=0))
    chars = list(accumulate((s[1] for s in sums), initial=0))
    n = lines[-1] + (text != b"" and not text.endswith(b"\n"))
    h = draws(seed, key)
    if not text or any(m.encode() in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text

    def place(units: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``units`` lines."""
        if units == n:
            return len(text), chars[-1]
        if units == 0:
            return 0, 0
        c = bisect_left(lines, units) - 1
        k = units - lines[c] - 1
        return (ends[c - 1] if c else 0) + sums[c][3][k], chars[c] + sums[c][2][k]

    (a, a_chars), (b, b_chars) = map(place, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = (x.encode() for x in MARKS)
    if h[3] % 100 < spm:
        return n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def restored(output: str | Column, form: str | Column) -> Column:
    """The exact text, from an output and its form. Texts that hold a mark are
    left plain, so the three marks of an output are its own."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<[PSM]>", 4)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part[1], part[3], part[2]))
            .otherwise(F.concat(part[2], part[3], part[1])))


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n`` (lines), ``form`` (plain, psm
    or spm), ``prefix_chars`` and ``middle_chars`` (null if plain) and
    ``output``. ``rate`` of a hundred documents are transformed, ``spm`` of a
    hundred of these begin with the suffix.

    Null and empty texts and texts that hold a mark are plain; a null id is the
    empty key; equal rows get equal results; very long texts are hashed slice
    by slice; extra columns are not read; an empty table gives an empty result.
    """
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"),
                      text_of(F.col(f"`{text_col}`")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in batches:
            out = [transform_text(text.as_py(), key.as_py(), chunks, seed, rate, spm) for key, text in zip(batch.column("key"), batch.column("text"))]
            cols = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cols[:4], cols[4].cast(pa.string())],
                                             names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
