"""Components per molecule, in batches that cut molecules."""

import random

from pyspark.sql import functions as F

from docmine.operators import graphs
from docmine.plans import catalog


def plain(atoms, bonds):
    out = {}
    for mol in {m for m, *_ in atoms}:
        mine = [(u, v) for m, u, v, _ in bonds if m == mol]
        root = {i: i for m, i, _ in atoms if m == mol} | {x: x for e in mine for x in e if x is not None}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        merged = 0
        for u, v in mine:
            if u is not None and v is not None and find(u) != find(v):
                root[find(u)] = find(v)
                merged += 1
        n = sum(1 for m, *_ in atoms if m == mol)
        out[mol] = (n, len(mine), n - merged, len(mine) - merged)
    return out


def cases():
    rng = random.Random(5)
    atoms, bonds = [], []
    for m in range(30):
        n = rng.choice([1, 2, 5, 40, 90])
        atoms += [(m, i, rng.choice("CNOH*")) for i in range(n)]
        bonds += [(m, rng.randrange(n), rng.randrange(n), 1) for _ in range(rng.randrange(0, 2 * n))]
    # A chain against its order, bonds twice, far and negative numbers, a bond without an end.
    atoms += [(50, i, "C") for i in range(300)] + [(51, 0, "C"), (51, 2147483646, "C"), (51, -5, "C")] + [(52, 0, "C")]
    bonds += [(50, i + 1, i, 1) for i in range(298, -1, -1)] * 2 + [(51, 0, 2147483646, 1), (51, -5, 0, 1), (51, 0, -5, 1)]
    bonds += [(52, 0, None, 1), (53, 0, 1, 1), (None, 0, 1, 1)]
    rng.shuffle(bonds)
    return atoms, bonds


def test_closures_do_not_depend_on_batches(spark):
    atoms, bonds = cases()
    a = spark.createDataFrame(atoms, "mol_id long, idx int, symbol string")
    b = spark.createDataFrame(bonds, "mol_id long, u int, v int, code int").repartition(3)
    want = plain(atoms, bonds)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for rows in ("3", "64", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = graphs.graph_counts(a, b).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {r.mol_id: (r.n_atoms, r.n_bonds, r.n_components, r.n_rings) for r in got} == want and len(got) == len(want)
    named = b.withColumn("mol_id", F.concat(F.lit("m"), F.col("mol_id")))
    assert {r.mol_id: r._merged for r in graphs.merged_atoms(named).collect()}["m50"] == 299
    assert graphs.merged_atoms(b.limit(0)).collect() == []


def test_graph_counts_go_over_bonds_once(spark):
    """No rounds of stored edge tables while the plan is built, and bonds are dealt out once."""
    query = catalog.QUERIES["graph_counts"](spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "docmine-cc" not in plan and plan.count("documents.parquet") == 2
