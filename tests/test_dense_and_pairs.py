"""Dense fingerprint search and verified bucket pairs against all pairs."""

import random

import pytest

from docmine.operators import dense, search

SCHEMA = "id bigint, bits array<int>"


def similar(a, b):
    return len(a & b) / len(a | b)


def dense_sets(seed, n, width):
    rng = random.Random(seed)
    sets = [{i for i in range(width) if rng.random() < rng.choice([0.3, 0.5, 0.7])} for _ in range(n)]
    for i in range(0, n, 3):
        sets[i] = set(sets[rng.randrange(n)])
        for _ in range(rng.randrange(0, width // 8)):
            sets[i] ^= {rng.randrange(width)}
    return sets


@pytest.mark.parametrize("width,lo,hi", [(64, 0.6, 1.0), (64, 0.85, 0.97), (100, 0.7, 1.0), (20, 0.5, 1.0), (64, 1.0, 1.0)])
def test_dense_search_finds_all(spark, width, lo, hi):
    sets = dense_sets(width, 160, width) + [set(), {0}, {0}, {width - 1}, set(range(width))]
    rows = [(i, sorted(s)) for i, s in enumerate(sets)] + [(900, None)]
    db = spark.createDataFrame(rows, SCHEMA)
    asked = db.filter("id % 3 = 0 OR bits IS NULL")
    got = {(r["query_id"], r["id"]): r["sim"] for r in dense.dense_range(asked, db, lo, hi, width).collect()}
    want = {
        (i, j): similar(a, b)
        for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i % 3 == 0 and a and b and lo <= similar(a, b) <= hi
    }
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_dense_search_of_nothing_and_of_wrong_bits(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [3, 64])], SCHEMA)
    assert dense.dense_range(none, none, 0.5).count() == 0
    assert dense.dense_range(one, none, 0.5, width=65).count() == 0
    with pytest.raises(ValueError):
        dense.dense_range(one, one, 0.0)
    with pytest.raises(Exception, match="outside"):
        dense.dense_range(one, one, 0.5, width=64).collect()


def test_blocks_keep_every_pair_in_reach():
    for radius in range(0, 20):
        for blocks in range(1, 12):
            radii = dense.block_radii(radius, blocks)
            # The cheapest way to pass all blocks costs more than the radius.
            assert sum(r + 1 for r in radii) == radius + 1


def test_longer_blocks_for_more_rows():
    small, large = (dense.choose_layout(64, 0.8, {32: n}, 34, n)[1] for n in (1_000, 1_000_000))
    assert large < small


@pytest.mark.parametrize("tile", [3, 256])
def test_verified_pairs_are_all_pairs(spark, tile):
    rng = random.Random(4)
    sets = []
    for _ in range(12):
        base = {rng.randrange(1 << 20) for _ in range(rng.randrange(30, 120))}
        for _ in range(rng.randrange(1, 12)):
            sets.append((base | {rng.randrange(1 << 20) for _ in range(rng.randrange(0, 6))}) - set(rng.sample(sorted(base), rng.randrange(0, 4))))
    sets = [set(x) for x in {tuple(sorted(s)) for s in sets}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], SCHEMA)
    got = [(r["id"], r["other"], r["sim"]) for r in search.verified_pairs(df, 0.5, tile=tile).collect()]
    pairs = {(i, j) for i, j, _ in got}
    assert len(pairs) == len(got)
    assert all(i < j and abs(s - similar(sets[i], sets[j])) < 1e-12 and s >= 0.5 for i, j, s in got)
    # 25 bands of 5 lose a pair of 0.9 with a chance below 1e-9.
    close = {(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j]) >= 0.9}
    assert len(close) > 30 and close <= pairs
    members = {}
    for r in search.lsh_buckets(df, 0.5).collect():
        members.setdefault(bytes(r["bucket"]), []).append(r["id"])
    met = {(i, j) for m in members.values() for i in m for j in m if i < j and similar(sets[i], sets[j]) >= 0.5}
    assert pairs == met


def test_similar_pairs_are_all_pairs_and_signatures_meet_few_others(spark):
    import numpy as np

    from docmine.functions import partenum
    from docmine.operators import search

    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 3, 4, 5, 7, 9, 12, 16, 25, 40, 90, 300):
        for _ in range(4):
            base = rng.choice(1 << 20, size, replace=False)
            for changed in range(0, max(1, size // 6) + 1, max(1, size // 24)):
                kept = base[changed:]
                sets.append(sorted({*kept.tolist(), *rng.choice(1 << 20, int(rng.integers(0, changed + 1)), replace=False).tolist()}))
    sets += [list(s) for s in sets[:5]] + [[]]
    for least in (0.8, 0.5, 1.0):
        found = search.similar_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, bits array<int>"), least)
        got = {(r["query_id"], r["id"]): r["sim"] for r in found.collect()}
        want = {}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                both, either = len({*a} & {*b}), len({*a, *b})
                if either and both / either >= least:
                    want[i, j] = both / either
        assert got == want
    # Sets that share common bits only: lists behind those bits would pair all of them.
    common = rng.choice(1 << 20, 40, replace=False)
    loose = [np.unique(np.concatenate([common, rng.choice(1 << 20, 260)])) for _ in range(100)]
    signed = np.concatenate([np.unique(partenum.signatures(s, 0.8)) for s in loose])
    assert len(signed) < 200 * len(loose)
    assert len(signed) - len(np.unique(signed)) < 2 * len(loose)


def test_hashed_runs_are_those_of_the_column_functions(spark):
    from pyspark.sql import functions as F

    from docmine.functions import runs
    from docmine.functions import scalars as N
    from docmine.functions import structures as S
    from docmine.functions.text import hash_int

    texts = ["", None, " \t\n", "one", "a b", "a b c", "a b  c\x0bd\x0c e\r\nf é ü 漢字 g a b c", "x" * 60 + " y " + "z" * 200, "b" * 53 + " c d", " a b " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    want = df.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    for slots in (1 << 20, 1000):
        listed = want.select("doc_id", N.shingle_bits(F.col("w"), 3, slots).alias("bits"))
        assert sorted(map(tuple, runs.text_bits(df, "doc_id", "text", 3, slots).collect())) == sorted(map(tuple, listed.collect()))
    smiles = spark.createDataFrame([(1, "C[NH3+]%12c1Cl*("), (2, ""), (3, "C"), (4, "漢"), (5, "[R]é[")], "mol_id long, smiles string")
    listed = smiles.select("mol_id", N.shingle_bits(S.tokenise(F.col("smiles")), 3, 2048).alias("bits"))
    assert sorted(map(tuple, runs.token_bits(smiles, "mol_id", "smiles", S.TOKENS, 3, 2048).collect())) == sorted(map(tuple, listed.collect()))
    spans = df.filter("text IS NOT NULL").select("text", hash_int(F.col("text")).alias("h")).collect()
    import numpy as np

    for r in spans:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        assert runs.md5_heads(data, np.array([0]), np.array([len(data)]))[0] == r["h"]


@pytest.mark.parametrize("width,lo,n", [(64, 0.55, 3), (100, 0.3, 4), (20, 0.9, 2)])
def test_topn_in_tiles_is_the_best_of_all(spark, monkeypatch, width, lo, n):
    """Ties go by id, copies count one by one, and a tile of any size gives the same."""
    monkeypatch.setattr(dense, "QUERY_BLOCK", 50)
    monkeypatch.setattr(dense, "ROW_BLOCK", 70)
    sets = dense_sets(width + 1, 150, width) + [set(), {0}, {0}, {0}, {0}, {width - 1}, set(range(width))]
    rows = [(i, sorted(s)) for i, s in enumerate(sets)] + [(900, None), (None, [1, 2])]
    db = spark.createDataFrame(rows, SCHEMA)
    asked = db.filter("id % 3 = 0 OR id > 149 OR bits IS NULL")
    got = sorted((r["query_id"], r["rank"], r["id"], r["sim"]) for r in dense.dense_topn(asked, db, n, lo, width).collect())
    want = []
    for i, a in enumerate(sets):
        if a and (i % 3 == 0 or i > 149):
            best = sorted((-similar(a, b), j) for j, b in enumerate(sets) if b and similar(a, b) >= lo)[:n]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want) and len(want) > 50
    assert dense.dense_topn(asked.filter("id = 900"), db, n, lo, width).count() == 0


def test_least_hashes_are_those_of_the_plain_remainder():
    import numpy as np

    from docmine.functions import scalars as N

    rng, pairs, heads = np.random.default_rng(3), N.hash_pairs(20), np.arange(0, 5000, 7)
    for top in (2, 1 << 20, (1 << 31) - 1):
        bits = np.concatenate([[0, top - 1, top], rng.integers(0, top, 4997)])
        for sign in (1, -1):
            want = [np.minimum.reduceat((sign * bits * a + b) % N.MINHASH_PRIME, heads) for a, b in pairs]
            assert all((g == w).all() for g, w in zip(search.least_hashes(sign * bits, heads, pairs), want, strict=True))


@pytest.mark.parametrize("cluster", [search.component_clusters, search.leader_clusters])
def test_clusters_read_their_rows_once(spark, cluster):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, sorted({i % 7 * 50 + k for k in range(40)})) for i in range(30)] + [(90, []), (91, None), (92, [])]
    df = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    got = {r["id"]: r["cluster"] for r in cluster(df).collect()}
    assert got.keys() == {i for i, _ in rows} and [got[i] for i in (90, 91, 92)] == [None] * 3
    assert all(got[i] <= i % 7 for i in range(30))
    assert seen.value == len(rows)


def test_only_shared_buckets_are_settled(spark, monkeypatch):
    sizes, founders = [], search.founders
    monkeypatch.setattr(search, "founders", lambda buckets: sizes.append(buckets.count()) or founders(buckets))
    rows = [(i, list(range(1000 * i, 1000 * i + 30))) for i in range(20)] + [(50, list(range(1000, 1031)))]
    got = {r["id"]: r["cluster"] for r in search.leader_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: i for i in range(20)}, 50: 1}
    assert 2 <= sizes[0] <= 50


def test_a_tile_compares_across_its_blocks_and_a_row_goes_to_a_family_once(spark):
    import pyarrow as pa

    one, two, other = ("%032x" % k for k in (1, 2, 1 << 64 | 1))
    rows = [(1, 0, one + two, [1, 2, 3, 4]), (2, 0, one + two, [1, 2, 3, 4]), (3, 1, one + other, [1, 2, 3]), (4, 1, other + two, [1, 2, 3, 4, 5]), (5, 1, other * 2, [1, 2, 3, 4])]
    names = ["id", "block", "keys", "bits"]

    def pairs(rows, least):
        columns = dict(zip(names, zip(*rows), strict=True))
        table = pa.table({**columns, "keys": list(columns["keys"]), "bits": pa.array(list(columns["bits"]), pa.list_(pa.int32()))})
        return sorted(map(tuple, (r.values() for r in search._tile_pairs(table, 2, least).to_pylist())))

    assert pairs(rows, 0.5) == [(1, 3, 0.75), (1, 4, 0.8), (2, 3, 0.75), (2, 4, 0.8)]
    assert pairs([(i, 0, k, b) for i, _, k, b in rows], 0.8) == [(1, 2, 1.0), (1, 4, 0.8), (2, 4, 0.8), (4, 5, 0.8)]
    assert pairs(rows[:1], 0.5) == []
    base = list(range(100, 160))
    near = [(i, sorted([*base, 1000 + i])) for i in range(40)]
    found = search.verified_pairs(spark.createDataFrame(near, SCHEMA), 0.5, tile=8)
    assert found.count() == 40 * 39 // 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "array_intersect" not in plan
    assert search.verified_pairs(spark.createDataFrame([], SCHEMA), 0.5).count() == 0
