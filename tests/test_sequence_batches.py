"""Sequences in Arrow batches against plain loops, over odd rows and any batch size."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmine.functions import runs
from docmine.functions import sequences as Q
from docmine.functions import structures as S
from docmine.operators import sequences as O
from docmine.plans import catalog

X, Y = Q.FIRST_X, Q.first_y()
C = {c: Q.FIRST_CHAR + i for i, c in enumerate(Q.CHARACTERS)}


def collect(spark, rows, schema, *columns):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, v {schema}").repartition(2)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = []
    for limit in ("3", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
        try:
            out.append(sorted(map(tuple, df.select("i", *columns).collect())))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert out[0] == out[1]
    return [r[1:] for r in out[0]]


def odd_ids():
    rng = random.Random(4)
    pool = [Q.PAD, Q.SOS, Q.EOS, Q.UNK, *[C[c] for c in "CClB[]R1(=2a"], X, X + 63, Y, Y + 63, Y + 64, 999]
    rows = [[rng.choice(pool) for _ in range(rng.randrange(12))] for _ in range(300)]
    rows += [[], None, [C["1"], Y + 5, C["C"]], [Q.SOS, C["C"], X + 1, Y + 2, Q.EOS], [C["C"], X + 1], [Y + 1], [X, Y], [Q.PAD], [Q.EOS]]
    rows += [[C["["], C["R"], C["]"], X + 1, Y + 2, C["("], X + 1, Y + 2], [Q.PAD, Q.EOS, Q.PAD], None]
    return rows


def kind(t):
    return "x" if X <= t < Y else "y" if Y <= t < Y + 64 else "c" if Q.FIRST_CHAR <= t < X else "s"


def faults(ids):
    n = 0
    for a, b in zip(ids, ids[1:], strict=False):
        ka, kb = kind(a), kind(b)
        n += bool(
            (ka == "x" and kb != "y") or (ka == "y" and kb in "xy") or (ka not in "xy" and kb == "y")
            or (a == Q.SOS and kb not in "cy") or b in (Q.SOS, Q.UNK) or (b == Q.PAD and a not in (Q.EOS, Q.PAD))
        )
    return n


def trimmed(ids):
    ids = ids[: ids.index(Q.EOS) + 1] if Q.EOS in ids else list(ids)
    while ids and ids[-1] == Q.PAD:
        ids.pop()
    return ids


def decoded(ids):
    stop = next((i for i, t in enumerate(ids) if t in (Q.EOS, Q.PAD)), len(ids))
    shown = {"x": lambda t: f"{{{t - X},", "y": lambda t: f"{t - Y}}}", "c": lambda t: Q.CHARACTERS[t - Q.FIRST_CHAR], "s": lambda t: ""}
    text = "".join(shown[kind(t)](t) for t in ids[:stop])
    atoms = [(s, int(x), int(y)) for s, x, y in re.findall(Q.ATOM_WITH_PLACE, text)]
    return re.sub(r"\{\d+,|\d+\}", "", text), atoms, bool(atoms)


def test_ids_are_read_as_by_loops(spark):
    rows = odd_ids()
    ids = F.col("v")
    got = collect(spark, rows, "array<int>", Q.decode(ids).alias("d"), Q.trim(ids), Q.atom_positions(ids), Q.grammar_violations(ids))
    for row, (d, t, p, g) in zip(rows, got, strict=True):
        if row is None:
            assert (d is None or d["smiles"] is None) and (t, p, g) == (None, None, None)
            continue
        assert (d["smiles"], [tuple(a) for a in d["atoms"]], d["success"]) == decoded(row), row
        assert (t, p, g) == (trimmed(row), [i for i, v in enumerate(row) if kind(v) == "y"], faults(row)), row


def test_a_null_id_is_no_fault_of_its_own(spark):
    rows = [[C["C"], None, C["C"]], [X, None], [None, Y], [None, Q.SOS], [Q.EOS, None, Q.PAD]]
    assert [r[0] for r in collect(spark, rows, "array<int>", Q.grammar_violations(F.col("v")))] == [0, 0, 0, 1, 0]


COORDS = [
    "[[1,2],[3,4],[5,6]]", "[[1.5,-2],[1e3,0.25]]", "not a list", "[]", "[[1,2,3]]", "[[1,2],[3]]", "[[1,2],null]", "[[1,null]]",
    "[[1,2],[3,4]", '[["1","2"]]', "[[7,7]]", "[[1,2],[1,2]]", "null", "", None, "[[NaN,1],[2,3]]", "[[1e400,1],[2,3]]", "[[1,2],[],[3,4]]", '{"a":1}',
]


def test_rows_follow_the_parsed_points(spark):
    texts = ["[R1]CC*", "C", "", " ", "[3*]N*[x*]*", "C[", "xé", None, "C.C-Cl", "*"]
    pairs = [(s, c) for s in texts for c in COORDS]
    df = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(pairs)], "k int, s string, c string")
    out = {r["k"]: r for r in O.sequence_rows(df, "k", "s", "c", max_length=9, max_atoms=3).collect()}
    asked = df.select("k", S.quick_normalise(F.col("s")).alias("n"), Q.parse_coords(F.col("c")).alias("p")).collect()
    assert len(out) == len(pairs)
    for r in asked:
        row, p = out[r["k"]], r["p"]
        assert row["norm"] == r["n"] and row["has_coords"] == (p is not None), r
        if r["n"] is None:
            assert row["ids"] is None and row["status"] == "blank"
            continue
        ids, seen = [Q.SOS], 0
        for t in re.findall(S.TOKEN_PATTERN, r["n"]):
            ids += [C.get(c, Q.UNK) for c in t]
            if re.match(r"^([A-Za-z]+$|\[|\*$)", t):
                ids += [X + place(p, seen, 0), Y + place(p, seen, 1)]
                seen += 1
        assert row["ids"] == [*ids, Q.EOS] and row["n_atoms"] == seen, r


def place(p, i, axis):
    """Not-a-number is larger than any number."""
    if p is None or i >= len(p):
        return 0
    values = np.array([q[axis] for q in p])
    low = np.fmin.reduce(values)
    high = np.nan if np.isnan(values).any() else values.max()
    with np.errstate(invalid="ignore", over="ignore"):
        span = np.nan if np.isnan(high - low) else max(high - low, 1e-6)
        v = ((high - values[i]) if axis else (values[i] - low)) / span * 384
    v = 383.0 if np.isnan(v) else min(max(v, 0.0), 383)
    return int(min(63, max(0, np.floor(v / 384 * 64))))


def test_hashes_of_spans_of_any_length():
    rng = np.random.default_rng(1)
    for top in (1, 4, 5, 9, 55, 56, 57, 200):
        sizes = rng.integers(0, top, 3000)
        data, ends = rng.integers(0, 256, int(sizes.sum()) + 3).astype(np.uint8), np.cumsum(sizes)
        want = [int(hashlib.md5(data[a:b].tobytes()).hexdigest()[:8], 16) for a, b in zip(ends - sizes, ends, strict=True)]
        assert runs.md5_heads(data, ends - sizes, ends).tolist() == want


@pytest.mark.parametrize("name", ["grammar_violations", "trimmed_sequences", "atom_positions", "sequence_rows", "sequence_status", "decoded_sequences"])
def test_sequences_are_not_made_id_by_id(spark, name):
    """No lambda over ids or points is left in the plans, and nothing is stored on the way."""
    query = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "md5(" not in plan and "docmine-" not in query._jdf.queryExecution().executedPlan().toString()
