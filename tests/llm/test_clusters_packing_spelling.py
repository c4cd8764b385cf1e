"""Centroid clustering, exact-complement packing and spelling variants against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from docmine.llm import complement_packing, shallot, spelling

from .fixtures import SCHEMA, awkward_rows

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


# --- clustering -------------------------------------------------------------------------


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = []
    for vec_id, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            kept.append((vec_id, tuple(math.floor(1024 * float(np.float32(x))) for x in e)))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if groups[j] else old for j, old in enumerate(centroids)]
    out = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    per = Counter()
    for _, j, d in out:
        per[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, per[j], sum(per.values()), digest[j]) for i, j, d in out]


def vectors(n, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(11, 64))
    x = (middle[rng.integers(0, 11, n)] + spread * rng.normal(size=(n, 64))).astype(np.float32)
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def clustered(spark, rows, **options):
    table = spark.createDataFrame([(i, e, 1, 2.0, b"") for i, e in rows], "vec_id long, embedding array<float>, cluster int, upper double, v binary")
    got = shallot.cluster(table.repartition(3), **options)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in got.collect()), key=key), key


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_clusters_equal_plain_rounds(spark, spread):
    rows = vectors(900, 3, spread)
    got, key = clustered(spark, rows)
    assert got == sorted(plain_clusters(rows), key=key)


def test_clusters_of_awkward_vectors(spark):
    good = vectors(60, 5, 0.4)
    rows = good + [(1000, None), (1001, []), (1002, [0.1] * 63), (1003, [0.1] * 65), (1004, [None] + [0.0] * 63)]
    rows += [(1005, [float("nan")] + [0.0] * 63), (1006, [float("inf")] + [0.0] * 63), (None, good[0][1]), (None, [0.0] * 64)]
    rows += [(7, good[9][1]), (7, good[9][1])] + [(2000 + i, good[4][1]) for i in range(300)]
    got, key = clustered(spark, rows)
    assert got == sorted(plain_clusters(rows), key=key)


def test_few_equal_and_no_vectors(spark):
    same = [(i, [0.25] * 64) for i in range(12)]
    for rows in (same, same[:3], [], [(1, None)]):
        got, key = clustered(spark, rows)
        assert got == sorted(plain_clusters(rows), key=key)


def test_search_keeps_all_ties_and_skips_far_centroids():
    rng = np.random.default_rng(2)
    centroids = [tuple(c) for c in rng.integers(-3, 4, (40, 5)).tolist()]
    centroids[7] = centroids[3]
    x = rng.integers(-4, 5, (2000, 5)).astype(np.int64)
    search = shallot.Search(centroids)
    want = search.full(x)
    for _ in range(3):
        own = rng.integers(0, 40, len(x))
        other = (own + rng.integers(1, 40, len(x))) % 40
        got = search.nearest(x, own, other)
        assert [g.tolist() for g in got] == [w.tolist() for w in want]
    # From the right neighbours the ball is small.
    search.scanned = 0
    apart = shallot.Search([tuple(c) for c in (1000 * rng.normal(size=(40, 5))).astype(int).tolist()])
    x = apart.c[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 5))
    one, two, _, _ = apart.full(x)
    apart.nearest(x, one, two)
    assert apart.scanned < 2000 * 12


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        shallot.cluster(table).collect()


# --- packing ----------------------------------------------------------------------------


def check_plan(lengths, size=1024):
    counts = np.bincount(lengths, minlength=size + 1)
    plan = complement_packing.plan_windows(counts)
    held = Counter()
    for window, times in plan:
        assert sum(window) <= size and times > 0
        for n in window:
            held[n] += times
    assert held == Counter(np.asarray(lengths).tolist())
    return sum(times for _, times in plan), max(-(-int(np.sum(lengths)) // size), sum(n > size // 2 for n in lengths))


def best_fit_decreasing(lengths, size=1024):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def test_plans_hold_every_piece_in_few_windows():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 1025, 900), rng.integers(1, 300, 2000), rng.integers(200, 700, 900), rng.integers(300, 400, 700)):
        windows, bound = check_plan(lengths)
        assert bound <= windows <= best_fit_decreasing(lengths.tolist())
    # Exact complements of one, two and three pieces.
    assert check_plan([1000, 24] * 5 + [700, 300, 24] * 7 + [461, 300, 239, 24] * 9)[0] == 21
    assert check_plan([341] * 9) == (3, 3)
    assert check_plan([1024, 1, 1]) == (2, 2)
    assert check_plan([]) == (0, 0)


def test_small_plans_are_nearly_the_fewest():
    rng = random.Random(9)
    worse = 0
    for _ in range(150):
        lengths = [rng.randrange(1, 11) for _ in range(rng.randrange(1, 9))]
        windows, _ = check_plan(lengths, 10)

        def fewest(left, rooms):
            if not left:
                return len(rooms)
            best = len(left) + len(rooms)
            for r in {*rooms}:
                if r >= left[0]:
                    rest = list(rooms)
                    rest.remove(r)
                    best = min(best, fewest(left[1:], [*rest, r - left[0]]))
            return min(best, fewest(left[1:], [*rooms, 10 - left[0]]))

        best = fewest(sorted(lengths, reverse=True), [])
        assert windows <= best + 1
        worse += windows > best
    assert worse <= 3


def test_complement_packing_of_awkward_documents(spark):
    from tokenizers import Tokenizer

    rows = awkward_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("shard", "piece").withColumnRenamed("doc", "length")
    got = complement_packing.pack(docs.repartition(5), TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = [r.length for r in got]
    assert len(windows) == check_plan(lengths)[0]


def test_hot_length_and_other_key_types(spark):
    docs = spark.createDataFrame([(f"k{i}", "same words in all of them") for i in range(3000)], "name string, text string")
    got = complement_packing.pack(docs.repartition(4), TOKENIZER, key="name").collect()
    places = Counter((r.sequence_id, r.offset) for r in got)
    assert len(got) == len(places) == 3000
    n = got[0].length
    assert len({r.sequence_id for r in got}) == -(-3000 // (1024 // n))
    assert not complement_packing.pack(docs.filter("false"), TOKENIZER, key="name").collect()


# --- spelling ---------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_variants(rows, modulus=199, least=5):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def misspelt(seed, words=150, most=400):
    """Documents of few stems with edits, A-Z and accents, some much more frequent than others."""
    rng = random.Random(seed)
    letters = "abcdeéßÀz"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(words)]
    forms = list(stems)
    for s in stems:
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(s))
            forms.append(rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :], s + "a", "b" + s, s[1:]]))
    rows = []
    for i in range(most):
        rows.append((i, " ".join(rng.choice(forms if rng.random() < 0.5 else stems[: 1 + rng.randrange(words)]) for _ in range(40))))
    rows += [(None, rows[0][1].upper()), (None, None), (7, rows[3][1]), (901, ""), (902, "x" * 30000), (903, "12-34 !")]
    return rows


def variants(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 5, "w", 1) for i, t in rows], "doc_id long, text string, n long, word string, h int")
    got = spelling.group_variants(docs.repartition(3), **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def test_variants_equal_plain_pairs(spark):
    rows = misspelt(1)
    want = plain_variants(rows)
    assert variants(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 5 and sum(r[4] for r in want) > 200
    # Long lists go by their words' remainders, with the same result.
    assert variants(spark, rows, hot=3) == want


def test_variants_of_nothing(spark):
    assert variants(spark, []) == []
    assert variants(spark, [(1, None), (2, "short"), (3, "longenough once")]) == []


def test_deletions_make_variants(spark):
    rows = [(i, "Wonderful wonderful") for i in range(6000)]
    want = plain_variants(rows)
    assert len(want) > 3
    assert variants(spark, rows) == want


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("often", [0, 2, 30])
def test_words_one_edit_apart_share_a_list(seed, often):
    rng = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdefgh"
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 30))) for _ in range(400)}
    for w in sorted(words)[:300]:
        i = rng.randrange(len(w) + 1)
        words |= {x for x in (w[:i] + "a" + w[i:], w[:i] + w[i + 1 :], w[:i] + "h" + w[i + 1 :]) if len(x) >= 6}
    words = sorted(words)
    count = Counter()
    for q, fits, h in spelling.Grams(words, 6).hashes():
        if q >= spelling.SHORTEST:
            count.update(h[fits].tolist())
    table = sorted((h, c) for h, c in count.items() if c > often)
    frequent = np.array([h for h, _ in table], np.uint64), np.array([c for _, c in table], np.int64)
    token, number, own = spelling.list_entries(words, *frequent, 6)
    lists = defaultdict(set)
    for t, w, o in zip(token.tolist(), number.tolist(), own.tolist()):
        lists[w].add((t, o))
    for i, a in enumerate(words):
        for j in range(i):
            if one_edit(a, words[j]):
                met = {(t, o or p) for t, o in lists[i] for p in (True, False) if (t, p) in lists[j]}
                assert any(o for _, o in met), (a, words[j])
