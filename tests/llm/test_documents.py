"""Operators on documents against plain loops, over awkward rows and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from docmine.llm import decontaminate, jaccard_join, line_dedup, packing, quality, sharding, suffix_dedup
from tests.llm import fixtures as fx

ROWS = fx.awkward_rows()
PAIRS = [(r[0], r[1]) for r in ROWS]
sha = lambda t: hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, fx.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], fx.SCHEMA)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_byte_shards(docs, shards):
    out = sharding.shard_documents(docs, shards).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in out) == sorted(
        (d is None, d or 0, zlib.crc32((t or "").encode())) for d, t in PAIRS
    )
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    assert total == sum(len((t or "").encode()) + 8 for _, t in PAIRS)
    for s in range(shards):
        assert sorted(r.slot for r in by[s]) == list(range(len(by[s])))
        assert abs(sum(r.size for r in by[s]) - total / shards) <= largest
    # Contiguous in the order of text digest and id.
    order = [(hashlib.md5((t or "").encode()).hexdigest(), -1 if d is None else d) for d, t in PAIRS]
    placed = sorted((r.shard, r.slot, r.doc_id, r.text_crc32) for r in out if r.doc_id is not None)
    crc = {d: zlib.crc32((t or "").encode()) for d, t in PAIRS if d not in (63, None)}
    seen = [(d, c) for _, _, d, c in placed if d in crc]
    assert [d for d, _ in seen] == [d for _, d in sorted(order) if d in crc]


def test_byte_shards_of_nothing(none):
    assert sharding.shard_documents(none).collect() == []


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_join_components(docs, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 500 if words == 4 else 1 << 18)
    out = jaccard_join.link_components(docs, words, percent).collect()
    assert len(out) == len(ROWS)
    expect = fx.components(PAIRS, words, percent)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == expect
    assert Counter((r.doc_id, r.n_shingles) for r in out) == Counter((d, len(fx.shingles(t, words))) for d, t in PAIRS)
    assert all(r.component_id is None for r in out if r.doc_id is None)


def test_join_of_nothing(none):
    assert jaccard_join.link_components(none).collect() == []


def test_keep_one_per_component(docs):
    kept = [r.doc_id for r in jaccard_join.keep_one_per_component(docs).collect()]
    expect = fx.components(PAIRS, 5, 80)
    assert Counter(kept) == Counter(d for d, _ in PAIRS if d is None or expect[d] == d)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for percent in (60, 80, 85, 95):
        for n in (1, 2, 6, 7, 12, 30, 90, 400):
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                drop = int(rng.integers(0, max(1, n // 8) + 1))
                y = np.unique(np.concatenate([x[rng.permutation(n)[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 1)), dtype=np.uint64)]))
                common = len(np.intersect1d(x, y))
                if len(y) and 100 * common >= percent * (len(x) + len(y) - common):
                    assert len(np.intersect1d(jaccard_join.signatures(x, percent), jaccard_join.signatures(y, percent)))


def test_unrelated_sets_share_no_signature():
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for n in (5, 6, 12, 60, 300):
            seen = Counter()
            for _ in range(400):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                seen.update(set(jaccard_join.signatures(x, percent).tolist()))
            assert max(seen.values()) <= 3


def test_quality(docs, none):
    out = quality.judge(docs).collect()
    expect = []
    for d, t in PAIRS:
        w = fx.WORD.findall(t or "")
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if fx.WORD.search(x)]
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        expect.append((d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), failed))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert Counter(got) == Counter(expect)
    assert not any(r.kept for r in out if r.base_failed)
    assert quality.judge(none).collect() == [] and quality.clean(none).collect() == []


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("A plain sentence of some words.", None), ("He said so (\"yes!\")", None), ("one two three four", "punctuation"),
        ("a | b | c | d.", "navigation"), ("All rights reserved.", "boilerplate"), ("Ends well. but then not", None),
        ("Read the privacy policy and the terms of use.", "boilerplate"),
        (f"{'Long texts can name the privacy policy once. ' + 'They go on for some words more. ' * 5}", None),
        ("Click here now and here again, " * 40 + "to the end.", "boilerplate"),
    ],
)
def test_line_rules(line, rule):
    assert quality.line_failure(line, quality.LineRules()) == rule


def test_clean_drops_lines_and_documents(spark):
    good = "This is a sentence that goes on for long enough to stay here."
    more = "Quite another one follows, of words that have not come before now."
    rows = [(1, f"{good}\nhome about contact\n{more}"), (2, "menu home about contact links and so on for ever"), (3, good)]
    one_line = " ".join(f"Clean{i} words{i} follow{i} here{i} still{i}." for i in range(400)) + " It has a privacy policy."
    rows.append((4, one_line))
    out = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: f"{good}\n{more}", 3: good, 4: one_line}


@pytest.mark.parametrize(("shard_keys", "probes"), [(200_000, 1_000_000), (7, 5)])
def test_line_dedup(docs, shard_keys, probes):
    out = line_dedup.measure(docs, shard_keys=shard_keys, probes=probes).collect()
    expect = fx.repeated_lines(PAIRS, 10)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in out) == Counter((d, n, g, sha(k)) for d, n, g, k in expect)
    texts = line_dedup.drop_repeated_lines(docs, shard_keys=shard_keys, probes=probes)
    assert texts.columns == docs.columns
    assert Counter((r.doc_id, r.text or "", r.shard) for r in texts.collect()) == Counter((d, k, 7) for d, _, _, k in expect)


def test_line_dedup_of_nothing(none):
    assert line_dedup.measure(none).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    for n in (0, 1, 2, 17, len(keys)):
        table = line_dedup.PerfectHash.build(keys[:n])
        assert sorted(table.places(keys[:n]).tolist()) == list(range(n))
    assert (table.places(np.arange(100, dtype=np.uint64)) < len(keys)).all()


@pytest.mark.parametrize("length", [40, 400])
def test_repeats(docs, length):
    out = suffix_dedup.remove_repeats(docs, length, shard_bytes=3000).collect()
    raw, gone = fx.covered([t for _, t in PAIRS], length)
    expect = []
    for (d, _), b, g in zip(PAIRS, raw, gone, strict=True):
        runs = sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1]))
        expect.append((d, len(b), sum(g), runs, sha(bytes(c for c, x in zip(b, g, strict=True) if not x))))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == Counter(expect)


def test_repeats_in_nothing(none):
    assert suffix_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("spill", [3, 1 << 18])
def test_induced_sorting(monkeypatch, spill):
    monkeypatch.setattr(suffix_dedup.SpillQueue.__init__, "__defaults__", (spill,))
    rng = np.random.default_rng(4)
    for _ in range(150):
        letters, size = int(rng.choice([1, 2, 4, 26])), int(rng.integers(1, 120))
        base = bytes((rng.integers(0, letters, size) + 97).astype(np.uint8))
        pieces = []
        for _ in range(int(rng.integers(1, 6))):
            b = bytearray(base)
            for _ in range(int(rng.integers(0, 3))):
                b[int(rng.integers(0, size))] = int(rng.choice([0, 255, 97]))
            at = int(rng.integers(0, size))
            pieces.append(bytes(b[at : at + int(rng.integers(1, 100))]))
        length = int(rng.choice([1, 2, 3, 5, 8, 20]))
        sorter = suffix_dedup.InducedSorter(pieces, length)
        marked = sorter.repeated()
        seen = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, at in zip(pieces, sorter.starts, strict=True):
            assert marked[at : at + len(p)].tolist() == [i + length <= len(p) and seen[p[i : i + length]] > 1 for i in range(len(p))]


BENCHMARK = [(1, " ".join(f"w{i}" for i in range(30))), (2, "the quick brown fox"), (3, None), (4, ""), (None, "no id here at all to see"), (5, " ".join(f"Q{i}," for i in range(12)))]


def test_leaks(spark, none):
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    one = BENCHMARK[0][1]
    filler = " ".join(f"z{i}" for i in range(50))
    rows = [
        (1, f"{filler} {one.upper()}! {filler}"), (2, filler), (3, "The quick, brown fox."), (4, None), (5, ""),
        (6, f"{filler} {' '.join(one.split()[:15])} {filler}"), (7, one.replace("w29", "v")), (8, f"q{one}"),
        (9, " ".join(f"q{i}" for i in range(12))), (None, one), (10, f"{one} {filler} {one}"), (10, "the quick brown fox"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.find_leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(1, 1), (3, 2), (7, 1), (8, 1), (9, 5), (10, 1), (10, 2)}
    exact = {(r.doc_id, r.item_id): r.similarity for r in out}
    assert exact[1, 1] == 1.0 and exact[7, 1] == pytest.approx(25 / 27)
    stay = Counter(r.doc_id for r in decontaminate.drop_leaks(docs, items).collect())
    assert stay == Counter({2: 1, 4: 1, 5: 1, 6: 1, None: 1})
    assert decontaminate.find_leaks(none, items).collect() == []
    assert decontaminate.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_leaks_against_all_windows(spark):
    rng = np.random.default_rng(9)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 60, n)]
    items = [(i, text(int(rng.integers(5, 25)))) for i in range(8)]
    rows = []
    for d in range(60):
        w = text(60)
        passage = list(items[int(rng.integers(0, 8))][1])
        if d % 3 == 0:
            passage[int(rng.integers(0, len(passage)))] = "edit"
        if d % 2 == 0:
            w[20:20] = passage
        rows.append((d, w))
    gram = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    expect = set()
    for d, w in rows:
        for k, item in items:
            for s in range(len(w)):
                x, y = gram(w[s : s + len(item)]), gram(item)
                if 100 * (x & y).total() >= 80 * (x | y).total() > 0:
                    expect.add((d, k))
    out = decontaminate.find_leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in out.collect()} == expect


def test_swapped_halves_insertions_and_short_items_are_found(spark):
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in rng.permutation(4000)]
    item, short, pad = words[:60], words[100:103], words[1000:1100]
    gone = words[200:260]
    rows = [
        (1, pad + item[30:] + item[:30] + pad), (2, pad + item + pad), (3, item[:30] + ["x"] + item[30:]), (4, pad + short + pad),
        (5, pad[:50] + item + pad + item), (6, item[5:]), (7, pad + gone[:20] + pad + gone[20:]), (8, pad * 40 + item + item * 30),
    ]
    gram = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    expect = set()
    for d, w in rows:
        for k, it in ((10, item), (11, short), (12, gone)):
            n = min(5, len(it))
            for s in range(len(w)):
                x, y = gram(w[s : s + len(it)], n), gram(it, n)
                if 100 * (x & y).total() >= 80 * (x | y).total() > 0:
                    expect.add((d, k))
    assert (1, 10) in expect and (4, 11) in expect and (7, 12) not in expect
    docs = spark.createDataFrame([(d, " ".join(w), 1, "a", 2, 3) for d, w in rows], "doc_id long, text string, h int, doc string, n int, pos int")
    items = spark.createDataFrame([(10, " ".join(item), 5), (11, " ".join(short), 5), (12, " ".join(gone), 5)], "item_id long, text string, size int")
    out = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(out) == expect
    assert (out[2, 10].similarity, out[2, 10].word_start) == (1.0, 100) and out[5, 10].word_start == 50
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {7}


def test_edited_items_are_all_found_by_default(spark):
    rng = np.random.default_rng(21)
    items, rows = [], []
    for k in range(400):
        w = [f"w{x}" for x in rng.integers(0, 50_000, 49 + k % 12)]
        edited = list(w)
        edited[int(rng.integers(4, len(w) - 4))] = "edit"  # five shingles of 45 to 56 differ: 0.80 to 0.84
        items.append((k, " ".join(w)))
        rows.append((k, " ".join(["before"] * 7 + edited + ["behind"] * 7)))
    out = decontaminate.find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    found = {(r.doc_id, r.item_id): r.similarity for r in out.collect()}
    assert set(found) == {(k, k) for k in range(400)}
    assert all(0.8 <= s < 0.85 for s in found.values())


TOKENS = "byte_bpe_50k.json"


@pytest.mark.parametrize(("size", "places", "parts"), [(1024, 128, 3), (64, 4, 40)])
def test_packing(docs, size, places, parts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENS)
    out = packing.pack(docs.repartition(parts), path, size=size, places=places, fan_in=4).collect()
    tokenizer = Tokenizer.from_file(path)
    blobs = Counter()
    for d, t in PAIRS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), size):
            blobs[d, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == blobs
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.15 * sum(r.length for r in out) / size + 2 * places


def test_packing_of_nothing(none):
    import public_tokenizers

    assert packing.pack(none, public_tokenizers.path(TOKENS)).collect() == []


def test_chunks_spell_the_tokenizers_ids():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENS)
    with open(path, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    tokenizer, rng = Tokenizer.from_file(path), random.Random(3)
    parts = ["a", "b", "'s", " ", "  ", "\n", "\t", "\r\n", "\xa0", "é", "1", "½", "_", "　", "\x1c", "\x85", "|", "<|endoftext|>", "日本", "\0", "😀", "'ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for text, blob in zip(texts, encoder.encode(texts), strict=True):
        assert blob == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_signatures_are_sent_with_two_bytes_less_than_a_long(spark):
    from docmine.llm import jaccard_join

    texts = [" ".join(f"w{i * 7 + j}" for j in range(60)) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_doc long, _text string")
    sent = jaccard_join.signature_rows(rows, 5, 80).collect()
    assert sent and all(0 <= r["sig"] < 1 << 48 for r in sent)
