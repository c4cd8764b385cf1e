"""Steps over molecules that once shuffled every atom or ran per element."""

import pyarrow as pa
from pyspark.sql import functions as F

from docmine.operators import graphs as R
from docmine.plans import derive as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_atoms_and_bonds_are_not_joined_or_shuffled_again(spark):
    docs = spark.createDataFrame([(1, "s", "a b c d e f g h i j k l m n")], "doc_id bigint, source string, text string")
    atoms, bonds = D.atoms(docs), D.bonds(docs)
    assert "Join" not in plan(R.leaf_atoms(atoms, bonds))
    nodes = plan(R.normalise_nodes(atoms.select("mol_id", "idx", "x", "y"), "mol_id"))
    assert "Join" not in nodes and nodes.count("Exchange") == 2
    assert plan(R.degree(bonds)).count("Exchange") == 2


def test_leaf_atoms_by_one_aggregation(spark):
    atoms = spark.createDataFrame([(1, i, s) for i, s in enumerate("CC*NO")], "mol_id bigint, idx int, symbol string")
    bonds = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 3), (1, 9, 3)], "mol_id bigint, u int, v int")
    assert [tuple(r) for r in R.leaf_atoms(atoms, bonds).collect()] == [(1, 0)]


def test_a_molecule_block_is_cut_into_lines_once(spark):
    block = F.concat(F.col("id").cast("string"), F.lit("\n \n\n 1\n 0 0 0 C\nM  END"))
    df = spark.range(1).select(R.molblock_atoms(block).alias("a"))
    assert plan(df.repartition(2)).split("Project")[1].count("cast(id") <= 1
    assert [tuple(x) for x in df.first()["a"]] == [(0, "C")]


def test_molecule_blocks_are_read_in_no_inferred_filter(spark, tmp_path):
    from docmine.plans import catalog

    docs = spark.createDataFrame([(1, "s", "a b c d e f g h i j k l m n")], "doc_id bigint, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    optimised = catalog.QUERIES["molblock_symbols"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in optimised.splitlines() if "Filter" in line and "M  END" in line]


def test_bonds_are_hashed_in_batches_before_they_are_dealt_out(spark):
    from hashlib import md5

    from docmine.functions import structures as S

    docs = spark.createDataFrame([(i, "s", " ".join(f"w{i}.{k}" for k in range(i))) for i in range(1, 60)], "doc_id bigint, source string, text string")
    docs = docs.unionByName(spark.createDataFrame([(99, "s", ""), (100, "s", None)], docs.schema))
    counts = D.structures(docs).select("mol_id", S.count_atoms(F.col("smiles")).alias("n")).collect()
    want = []
    for mol_id, n in counts:
        for u in range(n - 1):
            h = int(md5(f"{mol_id}-{u}".encode()).hexdigest()[:8], 16)
            if h % 7:
                want.append((mol_id, u, u + 1, 1 if h % 10 < 6 else h % 10 - 4))
            if h % 11 == 0 and u + 5 < n:
                want.append((mol_id, u, u + 5, 1))
    bonds = D.bonds(docs)
    assert sorted(map(tuple, bonds.collect())) == sorted(want) and {n for _, n in counts} >= {1, 2}
    few = pa.record_batch([pa.array([5, 6], pa.int64()), pa.array([0, 1], pa.int32())], names=["mol_id", "n"])
    assert [b.column(1).to_pylist() for b in D._bond_slots(iter([few]))] == [[[], []]]
    assert bonds.dtypes == [("mol_id", "bigint"), ("u", "int"), ("v", "int"), ("code", "int")]
    assert "md5" not in plan(bonds) and plan(R.change_candidates(bonds).groupBy("mol_id").count()).count("Exchange") == 2
