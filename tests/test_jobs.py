import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docmine.functions import scalars as N
from docmine.functions import sequences as Q
from docmine.operators import components, evaluation, graphs, layout, ordering, sampling, search


def test_rank_and_take_match_a_sort(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string")
    got = defaultdict(dict)
    for r in ordering.rank_by_hash(df, ["k"], ["id"], 5).collect():
        got[r["k"]][r["rank"]] = r["id"]
    import hashlib

    for k in {k for _, k in rows}:
        order = sorted((hashlib.md5(f"5|{i}".encode()).hexdigest(), i) for i, kk in rows if kk == k)
        assert [got[k][n + 1] for n in range(len(order))] == [i for _, i in order]
    taken = ordering.take_by_hash(df.repartition(7), ["k"], 10, ["id"], 5).collect()
    assert {(r["k"], r["id"]) for r in taken} == {(k, got[k][n]) for k in got for n in range(1, 11) if n in got[k]}


def test_islands_across_buckets(spark):
    rows = [(1, 0, 10), (1, 104, 110), (1, 205, 210), (1, 306, 310), (2, 5, 6)]
    df = spark.createDataFrame(rows, "k int, s int, e int")
    out = ordering.split_islands(df, ["k"], F.floor(F.col("s") / 100), ["s"], F.col("s"), F.col("e"), 95)
    assert sorted((r["k"], r["s"], r["island"]) for r in out.collect()) == [
        (1, 0, 0), (1, 104, 0), (1, 205, 0), (1, 306, 1), (2, 5, 0),
    ]


def test_ema_long_key(spark):
    rng = random.Random(1)
    xs = [rng.random() for _ in range(2500)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i int, x double")
    out = ordering.ema_baseline(df, ["k"], {"b": F.floor(F.col("i") / 100)}, ["i"], "x", block=64)
    got = {r["i"]: r["baseline"] for r in out.collect()}
    b = xs[0]
    for i, x in enumerate(xs):
        b = x if i == 0 else 0.9 * b + 0.1 * x
        assert got[i] == pytest.approx(b, abs=1e-12)


def test_quotas(spark):
    sizes = {"a": 50, "b": 5, "c": 1}
    df = spark.createDataFrame([(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)], "id string, k string")
    count = lambda out: dict(out.groupBy("k").count().collect())
    assert count(sampling.sample_balanced(df, ["k"], 6, ["id"])) == {"a": 2, "b": 2, "c": 1}
    assert count(sampling.sample_balanced(df, ["k"], 6, ["id"], "sqrt")) == {"a": 4, "b": 1, "c": 1}
    assert sampling.sample_stratified(df, ["k"], 30, ["id"]).count() == 30
    assert sampling.sample_stratified(df, ["k"], 500, ["id"]).count() == 56


def test_split_needs_two_rows(spark):
    with pytest.raises(Exception):
        sampling.train_val_split(spark.range(1), ["id"], 0.1).collect()
    assert dict(sampling.train_val_split(spark.range(2), ["id"], 0.9).groupBy("split").count().collect()) == {
        "train": 1, "val": 1,
    }


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    edges += [(1000, 1000 + i) for i in range(1, 200)]
    df = spark.createDataFrame(edges, "u int, v int")
    got = {r["vertex"]: r["component"] for r in components.connected_components(df).collect()}
    want = union_find([(a, b) for a, b in edges if a != b])
    assert got == want


def test_merged_atoms(spark):
    rng = random.Random(3)
    atoms, bonds = [], []
    for m in range(40):
        n = rng.randrange(1, 30)
        atoms += [(m, i, "C") for i in range(n)]
        seen = {tuple(sorted((rng.randrange(n), rng.randrange(n)))) for _ in range(rng.randrange(0, 30))}
        bonds += [(m, a, b, 1) for a, b in seen if a != b]
    b = spark.createDataFrame(bonds, "mol_id int, u int, v int, code int")
    merged = defaultdict(int)
    for m in range(40):
        roots = union_find([(u, v) for mm, u, v, _ in bonds if mm == m])
        merged[m] = sum(1 for x, r in roots.items() if x != r)
    got = {r["mol_id"]: r["_merged"] for r in graphs.merged_atoms(b).collect()}
    assert {k: v for k, v in merged.items() if v} == {k: v for k, v in got.items() if v}
    far = spark.createDataFrame([(1, 0, 2147483646, 1)], "mol_id int, u int, v int, code int")
    assert [tuple(r) for r in graphs.merged_atoms(far).collect()] == [(1, 1)]


def shuffled_sets(seed, n):
    rng = random.Random(seed)
    base = [sorted(rng.sample(range(300), 20)) for _ in range(8)]
    out = []
    for i in range(n):
        bits = set(base[i % 8])
        for _ in range(rng.randrange(0, 6)):
            bits.discard(rng.choice(sorted(bits)))
            bits.add(rng.randrange(300))
        out.append((i, sorted(bits)))
    return out + [(n + i, out[0][1]) for i in range(n // 2)]


def test_similarity_range_is_exact(spark):
    rows = shuffled_sets(4, 60)
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for lo, hi in ((0.3, 0.8), (0.7, 1.0)):
        got = {(r["query_id"], r["id"]) for r in search.similarity_range(df, df, lo, hi).collect()}
        assert got == {(i, j) for i, a in rows for j, b in rows if lo <= sim(a, b) <= hi}
    part = spark.createDataFrame([(i, b[:5]) for i, b in rows[:10]], "id int, bits array<int>")
    got = {(r["query_id"], r["id"]) for r in search.substructure_screen(part, df).collect()}
    assert got == {(i, j) for i, a in rows[:10] for j, b in rows if set(a[:5]) <= set(b)}


def test_leader_clusters_against_loop(spark):
    rows = shuffled_sets(6, 60)
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    assert N.band_shape(0.5, 128) == (25, 5)
    pairs = N.hash_pairs(125)
    founders, want = {}, {}
    for i, bits in rows:
        sig = [min((a * h + b) % N.MINHASH_PRIME for h in bits) for a, b in pairs]
        keys = {(k, tuple(sig[k * 5 : k * 5 + 5])) for k in range(25)}
        hits = [f for f, other in founders.items() if keys & other]
        want[i] = min(hits) if hits else i
        if not hits:
            founders[i] = keys
    got = {r["id"]: r["cluster"] for r in search.leader_clusters(df, 0.5).collect()}
    assert got == want


def test_triplets(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(99, 9)], "id int, label int")
    out = sampling.sample_triplets(df, "id", "label", 0.5).collect()
    assert len(out) == 40
    for r in out:
        assert r["anchor"] not in (r["positive"], r["negative"])
        assert r["anchor"] % 4 == r["positive"] % 4


def test_symmetric_edges_tie_and_wedge(spark):
    rows = [(1, 0, 1, 5, 0.9), (1, 1, 0, 6, 0.7), (1, 0, 1, 1, 0.1), (1, 1, 0, 1, 0.3),
            (2, 0, 1, 2, 0.5), (2, 1, 0, 2, 0.5), (2, 0, 1, 3, 0.5), (2, 1, 0, 3, 0.5)]
    df = spark.createDataFrame(rows, "sample_id int, i int, j int, k int, p double")
    got = {(r["sample_id"], r["i"], r["j"]): (r["code"], round(r["p"], 6)) for r in evaluation.symmetrise_edges(df).collect()}
    assert got == {(1, 0, 1): (5, 0.8), (1, 1, 0): (6, 0.8), (2, 0, 1): (2, 0.5), (2, 1, 0): (2, 0.5)}


def test_chain_lines(spark):
    rows = [
        (1, 0, 0, "Example: a", 0.0, 0.0, 100.0, 10.0), (1, 0, 1, "b", 0.0, 15.0, 100.0, 25.0),
        (1, 0, 2, "side", 300.0, 20.0, 400.0, 90.0), (1, 0, 3, "c", 2.0, 30.0, 102.0, 40.0),
        (1, 0, 4, "far", 0.0, 60.0, 100.0, 70.0),
    ]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, line_id int, text string, x0 double, y0 double, x1 double, y1 double")
    seed = F.when(F.col("text").startswith("Example"), "a")
    assert [(r["line_id"], r["full"]) for r in layout.chain_lines(df, seed).collect()] == [(0, "abc")]


def test_nearest_and_isolated(spark):
    def line(i, x0, y0, w, h):
        return (1, 0, i, "t", float(x0), float(y0), float(x0 + w), float(y0 + h))

    rows = [line(0, 0, 0, 100, 10), line(1, 0, 80, 100, 10), line(2, 0, 161, 100, 10), line(3, 900, 0, 50, 10),
            line(4, 0, 400, 100, 10)]
    df = spark.createDataFrame(rows, "doc_id int, page_index int, line_id int, text string, x0 double, y0 double, x1 double, y1 double")
    near = layout.nearest_same_column(df)
    assert {r["line_id"]: r["min_y_distance"] for r in near.collect()} == {0: 80.0, 1: 80.0, 2: 81.0, 3: 1000.0, 4: 239.0}
    assert {r["line_id"] for r in layout.drop_isolated_small(near).collect()} == {0, 1}


def test_sequence_roundtrip(spark):
    df = spark.createDataFrame([("[R1]CCl", [(1, 2), (3, 4), (70, -1)])], "s string, b array<struct<x:int,y:int>>")
    ids = df.select(Q.encode(F.col("s"), F.col("b")).alias("ids"))
    row = ids.select("ids", Q.decode(F.col("ids")).alias("d"), Q.grammar_violations(F.col("ids")).alias("g"),
                     Q.trim(F.concat("ids", F.array(F.lit(0)))).alias("t")).first()
    assert row["d"]["smiles"] == "[R1]CCl" and row["g"] == 0 and row["t"] == row["ids"]
    assert [tuple(a) for a in row["d"]["atoms"]] == [("[R1]", 1, 2), ("C", 3, 4), ("Cl", 63, 0)]
    assert Q.vocabulary(spark).count() == 207
