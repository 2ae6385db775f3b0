"""Personal data by a skip-chain conditional random field.

Base spans come from fixed patterns. The field's nodes are the text's
number-like and address-like pieces; its labels are the kinds of personal data
or none. Neighbouring pieces share transition potentials; pieces with the same
or a similar value, however far apart, share skip potentials, so that a value
recognised once is recognised where its form alone would not do. Occurrences
of a value are linked in a chain, so the edges grow with the pieces, not their
pairs. Pieces under a base span are observed. Loopy sum-product message passing
runs over all documents of an Arrow batch as one disjoint graph; pieces whose
marginal prefers a kind become added spans.

Potentials are learned: a softmax over piece shapes from the base labels of a
bounded sample (``SAMPLE`` documents), and pair potentials from the label
counts of linked pieces. Spark counts shape and label; at most a few thousand
counts reach the driver, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
#: Documents whose base labels train the potentials (expected number).
SAMPLE = 20_000
#: Share of the old message in a new one; rounds between two looks at the
#: messages, and the largest change of a document's that has settled; rounds
#: after which the damping grows, so that every document settles.
DAMPING, LOOK, SETTLED, PATIENCE = 0.3, 8, 1e-6, 200

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the look-behind and the possessive repeats only skip starts that cannot match: long digit runs stay linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_PIECE = re.compile(r"[0-9@]\S*")
_SPACE = re.compile(r"\s")
_OCTET = re.compile(r"[0-9]{1,3}")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _LOCAL.match(text, start) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and without
    overlap per kind, in order. Code points, end exclusive."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x := part.lstrip("0")) < 4 and int(x or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def pieces(text: str) -> list[tuple[int, int]]:
    """The nodes: white-space separated pieces with a digit or an at sign,
    without outer punctuation; short digit groups one blank apart are one."""
    out: list[tuple[int, int]] = []
    loose = False  # whether the last piece may be continued
    end = 0
    for m in _PIECE.finditer(text):
        start = m.start()
        while start > end and not _SPACE.match(text[start - 1]):
            start -= 1
        a, b = start, m.end()
        end = b
        while a < b and not (text[a].isalnum() or text[a] in "+(@"):
            a += 1
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if a == b:
            continue
        s = text[a:b]
        n = len(_DIGITS.findall(s))
        group = n <= 6 or (n == 7 and not s.isdigit())
        group = group and not any(c.isalpha() or c == "@" for c in s)
        if group and loose and out and a - out[-1][1] <= 2 and text[out[-1][1]:a].strip(") ") == "":
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        loose = group
    return out


def shape(s: str) -> int:
    """The observed features of a piece as a code below ``SHAPES``."""
    digits = "".join(_DIGITS.findall(s))
    n = len(digits)
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 14 else 5 if n < 20 else 6
    parts = s.split(".")
    ip = len(parts) == 4 and all(_OCTET.fullmatch(x) and int(x) <= 255 for x in parts)
    local, at, domain = s.partition("@")
    flags = (ip, bool(at and local and domain), bool(at) and "." in domain.strip("."), 14 <= n <= 19 and luhn(digits),
             s.startswith("+"), any(c.isalpha() for c in s))
    return size + 7 * sum(bool(f) << i for i, f in enumerate(flags))


SHAPES = 7 * 64


def shape_features(codes: np.ndarray) -> np.ndarray:
    """0/1 matrix of a code's features with a constant."""
    size, flags = codes % 7, codes // 7
    return np.hstack([np.ones((len(codes), 1)), size[:, None] == np.arange(7), (flags[:, None] >> np.arange(6)) & 1]).astype(float)


def value_key(s: str) -> str | None:
    """Pieces with one key have the same or a similar value: the local part of
    an address, a long number, or the last seven digits of a shorter one."""
    if "@" in s:
        local = s.partition("@")[0].lower()
        return f"@{local}" if local else None
    if any(c.isalpha() for c in s):
        return None
    d = "".join(_DIGITS.findall(s))
    return d if len(d) >= 14 else d[-7:] if len(d) >= 7 else None


def graph(text: str) -> tuple[list, list, list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """``(base spans, nodes, observed label or -1, chain edges, skip edges)``."""
    base = base_spans(text)
    if "@" not in text and not _DIGITS.search(text):
        return base, [], [], [], []
    nodes = pieces(text)
    starts, seen = [a for a, _ in nodes], [-1] * len(nodes)
    for a, kind, b in base:
        j = max(0, bisect_right(starts, a) - 1)
        while j < len(nodes) and starts[j] < b:
            if nodes[j][1] > a and seen[j] < 0:
                seen[j] = kind
            j += 1
    chain = [(j, j + 1) for j in range(len(nodes) - 1) if nodes[j + 1][0] - nodes[j][1] <= 40]
    last: dict[str, int] = {}
    skip = []
    for j, (a, b) in enumerate(nodes):
        if key := value_key(text[a:b]):
            if key in last:
                skip.append((last[key], j))
            last[key] = j
    return base, nodes, seen, chain, skip


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int, int], int] = {}
    for batch in batches:
        for text in batch.column("text"):
            t = text.as_py()
            _, nodes, seen, chain, skip = graph(t)
            label = [NONE if x < 0 else x for x in seen]
            for (a, b), y in zip(nodes, label, strict=True):
                k = ("shape", shape(t[a:b]), y)
                total[k] = total.get(k, 0) + 1
            for name, edges in (("chain", chain), ("skip", skip)):
                for i, j in edges:
                    k = (name, label[i], label[j])
                    total[k] = total.get(k, 0) + 1
    rows = [(*k, n) for k, n in total.items()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["what", "a", "b", "n"])


class Field:
    """Learned log-potentials: ``unary[shape, label]``, ``chain`` and ``skip``
    ``[label, label]``."""

    def __init__(self, counts: list[tuple[str, int, int, int]], ridge: float = 1.0, steps: int = 400):
        n = np.zeros((SHAPES, NONE + 1))
        pair = {"chain": np.ones((NONE + 1,) * 2), "skip": np.full((NONE + 1,) * 2, 0.1) + np.eye(NONE + 1)}
        for what, a, b, c in counts:
            if what == "shape":
                n[a, b] += c
            else:
                pair[what][a, b] += c
        # softmax regression on the counted shapes, each label weighing alike per square root of its count
        used = np.flatnonzero(n.sum(axis=1))
        x, y = shape_features(used), np.sqrt(n[used])
        w = np.zeros((x.shape[1], NONE + 1))
        w[0, NONE] = 1.0
        rate = 1.0 / max(1.0, y.sum())
        for _ in range(steps if len(used) else 0):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            w += rate * 4 * (x.T @ (y - p * y.sum(axis=1, keepdims=True)) - ridge * w)
        z = shape_features(np.arange(SHAPES)) @ w
        self.unary = z - np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - z.max(axis=1, keepdims=True)
        # pointwise mutual information of linked labels; skip links also hold labels together by themselves
        def pmi(m: np.ndarray) -> np.ndarray:
            m = m + m.T
            p = m / m.sum()
            q = p.sum(axis=1)
            return np.log(p / (q[:, None] * q[None, :]))

        self.chain = np.clip(pmi(pair["chain"]), -1.0, 1.0)
        self.skip = np.clip(pmi(pair["skip"]), -4.0, 4.0) + 2.0 * np.eye(NONE + 1)
        # a value that is none of the kinds in one place is weak evidence for another place
        self.skip[NONE, NONE] = min(self.skip[NONE, NONE], 1.0)

    def marginals(self, codes: np.ndarray, seen: np.ndarray, chain: np.ndarray, skip: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Label beliefs after damped messages have settled, document by
        document (``doc`` names a node's), so that a label does not depend on
        the documents beside it. Damping grows with the rounds, so messages
        that swing come to rest as well."""
        node = self.unary[codes].copy()
        known = np.flatnonzero(seen >= 0)
        node[known] = -30.0
        node[known, seen[known]] = 0.0
        out_belief = node.copy()
        ends = np.vstack([chain.reshape(-1, 2), skip.reshape(-1, 2)]).astype(np.int64)
        n = len(ends)
        src, dst = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
        psi = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        psi = np.concatenate([psi, psi])  # both potentials are symmetric
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        msg = np.zeros((2 * n, NONE + 1))
        damping, step = DAMPING, 0
        while len(src):
            nodes, at = np.unique(dst, return_inverse=True)  # every edge has its way back here
            start = np.searchsorted(nodes, src)
            for _ in range(LOOK):
                belief = node[nodes]
                np.add.at(belief, at, msg)
                out = (belief[start] - msg[back])[:, :, None] + psi
                top = out.max(axis=1, keepdims=True)
                new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
                new -= new.max(axis=1, keepdims=True)
                new = damping * msg + (1 - damping) * new
                moved, msg = np.abs(new - msg).max(axis=1), new
                step += 1
                if step % PATIENCE == 0:
                    damping = (1 + damping) / 2
            docs, of = np.unique(doc[src], return_inverse=True)
            worst = np.zeros(len(docs))
            np.maximum.at(worst, of, moved)
            rest = worst[of] <= SETTLED
            if rest.any():
                np.add.at(out_belief, dst[rest], msg[rest])
                live = ~rest
                back = (np.cumsum(live) - 1)[back[live]]
                src, dst, psi, msg = src[live], dst[live], psi[live], msg[live]
        return out_belief

    def find(self, texts: list[str]) -> list[tuple[list, list]]:
        """``(base spans, added spans)`` of every text."""
        docs, codes, seen, chain, skip, open_docs, doc = [], [], [], [], [], [], []
        for t in texts:
            base, nodes, obs, c, s = graph(t)
            docs.append((base, []))
            if any(x < 0 for x in obs):
                at = len(codes)
                codes += [shape(t[a:b]) for a, b in nodes]
                seen += obs
                doc += [len(docs)] * len(nodes)
                chain += [(at + i, at + j) for i, j in c]
                skip += [(at + i, at + j) for i, j in s]
                open_docs.append((len(docs) - 1, at, nodes))
        if codes:
            best = self.marginals(np.array(codes), np.array(seen), np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), np.array(doc)).argmax(axis=1)
            for d, at, nodes in open_docs:
                docs[d][1].extend((a, int(best[at + i]), b) for i, (a, b) in enumerate(nodes) if seen[at + i] < 0 and best[at + i] != NONE)
        return docs


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field:
    """Potentials from the base labels of about ``sample`` documents, drawn by
    a hash of the text."""
    t = docs.select(text_of(F.col(f"`{text_col}`")).alias("text"))
    every = max(1, docs.count() // sample)
    counts = t.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).mapInArrow(_count, "what string, a int, b int, n bigint")
    rows = counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()  # at most SHAPES * 5 + 50 counts
    return Field(sorted(tuple(r) for r in rows))


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, base counts ``n_email``, ``n_ip``,
    ``n_card``, ``n_phone``, ``base_sha256`` (of ``kind:start:end`` by start,
    then kind, comma-joined), ``spans`` (base and added ones, joined likewise)
    and ``n_added``.

    Null and empty texts have no span. Texts are read whole and row by row, so
    repeated rows, null ids and extra columns do not matter; an empty table
    gives an empty result.
    """
    field = model or fit(docs, text_col)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = field.find(batch.column("text").to_pylist())
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(NONE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([spell(base + added) for base, added in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())],
                names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans
    that overlap are one, under the first one's kind."""
    out, end = [], 0
    for a, k, b in sorted(spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", model: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in the texts. All rows and columns
    stay; ``chars_col``, if there is such a column, is the new length where a
    text changed. Null texts stay null."""
    field = model or fit(docs, text_col)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        given = texts.tolist()
        found = field.find([t or "" for t in given])
        return pd.Series([t if not t or not (base or added) else mask_text(t, base + added) for t, (base, added) in zip(given, found, strict=True)], dtype=object)

    t = F.col(f"`{text_col}`")
    d = docs.withColumn("__pii_text", masked(t))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("__pii_text").alias(c))
        elif c == chars_col:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("__pii_text") != t, F.length("__pii_text").cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return d.select(*cols)
