"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return df.toPandas()


def multiset(records):
    return Counter(map(tuple, records))


# ---- quality -------------------------------------------------------------

def statistics(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    upper = sum(1 for c in text if c.isupper() and re.match(r"[^\W\d_]", c))
    return dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)), n_dup_lines=len(lines) - len(set(lines)),
                n_repeat_words=len(covered), n_lines=len(lines), n_upper=upper, n_marks=len(re.findall(r"[.,!?;:]", text)))


def half_up(x):
    return math.floor(x + 0.5)


def quality(docs, support=0.5, steps=4, max_distance=5.5, min_group=50):
    """docs: (text, lang, source) -> (statistics, base_failed, distance or None, kept)."""
    from tallyframe.llm import quality as Q

    ridge = np.diag([(r * Q.UNIT) ** 2 for r in Q.RIDGE])
    p = len(Q.FEATURES)
    stats = [statistics(t) for t, _, _ in docs]
    failed = [s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"] for s in stats]
    x = np.array([[half_up(Q.UNIT * v) for v in (
        math.log1p(s["word_chars"] / max(1, s["n_words"])), math.log1p(s["n_symbols"] / max(1, s["n_words"])), math.log1p(s["n_marks"] / max(1, s["n_words"])),
        math.sqrt(s["n_upper"] / max(1, s["word_chars"])), s["n_dup_lines"] / max(1, s["n_lines"]), s["n_repeat_words"] / max(1, s["n_words"]))] for s in stats], float).reshape(-1, p)

    def estimate(members):
        y = x[members]

        def middle(v):
            return np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]

        def root(cov, factor):
            return np.linalg.inv(np.linalg.cholesky(cov * factor + ridge))

        def moments(v):
            mean = v.mean(axis=0)
            return mean, v.T @ v / len(v) - np.outer(mean, mean)

        mean = middle(y)
        inverse = root(np.diag((1.4826 * middle(abs(y - mean))) ** 2), 1.0)
        for step in range(steps):
            d2 = (((y - mean) @ inverse.T) ** 2).sum(axis=1)
            bins = np.floor(np.log2(d2 + 2.0 ** -6) * Q.BINS_PER_OCTAVE)
            cut = next(b for b in sorted(set(bins)) if (bins <= b).sum() >= support * len(y))
            mean, cov = moments(y[bins <= cut])
            inverse = root(cov, Q.consistency(support, p) if step == steps - 1 else 1.0)
        mean, cov = moments(y[(((y - mean) @ inverse.T) ** 2).sum(axis=1) <= Q.chi2_quantile(Q.CORE, p)])
        return mean, root(cov, Q.consistency(Q.CORE, p))

    good = [i for i in range(len(docs)) if not failed[i]]
    keys = [[i for i in good if docs[i][1:] == k] for k in {docs[i][1:] for i in good}]
    fits = {}
    for members in keys:
        key = docs[members[0]][1:]
        pool = members
        if len(pool) < min_group:
            pool = [i for i in good if docs[i][1] == key[0]]
        if len(pool) < min_group:
            pool = good
        fits[key] = estimate(pool)
    out = []
    for i, s in enumerate(stats):
        fit = fits.get(docs[i][1:])
        d = None if fit is None else float(np.sqrt(((fit[1] @ (x[i] - fit[0])) ** 2).sum()))
        out.append((s, failed[i], d, not failed[i] and d is not None and d <= max_distance))
    return out


# ---- similarity ----------------------------------------------------------

def shingles(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(texts, num=4, den=5):
    """Links (i, j) of all pairs at num / den or more, and the component of each text."""
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(sets))]


# ---- decontamination -----------------------------------------------------

def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(text, bench):
    w = bench_words(text)
    hit, items = set(), set()
    for item, b in bench:
        b = bench_words(b)
        k = min(10, len(b))
        for s in {tuple(b[i:i + k]) for i in range(len(b) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) == s:
                    hit |= set(range(i, i + k))
                    items.add(str(item))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


# ---- personal data -------------------------------------------------------

def base_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)]
    out = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0])]
    return sorted(out)


# ---- mixture -------------------------------------------------------------

def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Clamp and redistribute until nothing lies above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = budget / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = float(cap * sizes[s])
            budget -= out[s]
            open_.remove(s)
    return out


def mixture(docs):
    """docs: (doc_id, text, source) -> (size, target, times)."""
    size = [len(SPACE_WORD.findall(t or "")) for _, t, _ in docs]
    draw = [int(hashlib.md5(f"mix-1:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for i, t, _ in docs]
    total = Counter()
    for (_, _, s), n in zip(docs, size):
        total[s] += n
    goal = targets(dict(total))
    times = [0] * len(docs)
    for s in total:
        whole = math.floor(goal[s] / total[s]) if total[s] else 0
        rest, before = goal[s] - whole * total[s], 0
        for _, i in sorted((draw[i], i) for i in range(len(docs)) if docs[i][2] == s):
            times[i] = whole + (before + size[i] / 2 < rest)
            before += size[i]
    return [(n, goal[d[2]], t) for n, d, t in zip(size, docs, times)]


# ---- awkward rows ---------------------------------------------------------

DOC_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
              "id string, n_words string, kept string, size string, text_hash string, h string, w string, level string, root string, draw string, label string")


def awkward_documents(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, equal ids
    with other texts, and extra columns named like inner ones."""
    base = " ".join(f"word{i % 97} and{i % 13}" for i in range(40))
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(4_000))
    rows = [(1, base, "en", "a"), (1, base, "en", "a"), (2, base + " more", "en", "b"), (None, base, "en", None), (3, None, "en", "a"), (4, "", None, "b"),
            (4, "other text here", None, "b"), (5, long, "en", "a"), (6, long + " tail", "en", "a"), (7, "!!! ###", "de", "a"), (None, None, None, None),
            (8, "x@y.org +1 (523) 555-1055 then 523 555 1055 and 10.0.0.1 é\n\n" + base, "en", "c"), *extra]
    data = [(*r, None if r[1] is None else len(r[1]), *["z"] * 10, None) for r in rows]
    return spark.createDataFrame(data, DOC_SCHEMA)


def empty_like(df):
    return df.where("1 = 0")


def frame(df):
    return df.toPandas().astype(object).where(lambda x: pd.notna(x), None)
