"""Small awkward tables and plain-Python versions of the operators."""

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, shard int, doc string, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = text(150) + "."
    rows = [(1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "One  TWO"), (None, base), (None, None)]
    for i in range(10, 40):
        w = base.split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(i, "\n".join(text(12) + "." for _ in range(8)) + "\n  A common LINE of text.  \n" + text(9)) for i in range(40, 60)]
    rows += [(60, text(9000)), (61, "x" * 5000), (62, "ab" * 3000), (63, "É ü 日本 " * 200), (63, "another text under one id"), (64, base), (64, base)]
    return [(i, t, None, 7, "d", None) for i, t in rows]


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n):
    w = WORD.findall(folded(text))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n, percent):
    """{doc_id: smallest linked id} by all pairs."""
    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {d: root(d) for d in parent}


def covered(texts, length):
    """Per text the bytes covered by a string that also starts elsewhere."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return raw, out


def repeated_lines(rows, min_chars):
    """Per row (lines, dropped, kept text)."""
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", folded(line))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out
