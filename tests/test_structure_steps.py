"""Steps that queries over structures share: each is done once, whatever reads its rows."""

import re

from pyspark.sql import functions as F

from docmine.functions import structures as S

ODD = ["", "C", "[R12]N*", "[R]C[X]", "[NH3+:4]C[Xx]", "C[", "[]C", "[C@@H](C)/F\\Cl", "漢C[漢]%12B", "[R1a][R٣]", "[13*]:5][a]\nC", "C.C-N:9]"]


def test_text_keys_follow_the_tokens(spark):
    def plain(text):
        text = re.sub(r":[0-9]+\]", "]", text).translate({ord("/"): None, ord("\\"): None})
        out = []
        for token in re.findall(S.TOKEN_PATTERN, text, re.ASCII):
            number = re.fullmatch(r"\[R([0-9]+)\]", token)
            known = token[0] != "[" or re.search(S.BRACKET_ATOM, token, re.ASCII)
            out.append(f"[{number[1]}*]" if number else token if known else "*")
        return "".join(out)

    rows = spark.createDataFrame([(t,) for t in [*ODD, None]], "smiles string").select("smiles", S.text_key(F.col("smiles")).alias("key"))
    assert {r["smiles"]: r["key"] for r in rows.collect()} == {**{t: plain(t) for t in ODD}, None: None}


def test_exact_search_derives_keys_once(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["exact_structure_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "structure-keys" in plan and "documents.parquet" not in plan


def test_element_labels_are_known_without_the_pattern(spark):
    labels = [*S.ELEMENTS, *S.RGROUP_SYMBOLS, *S.ABBREVIATIONS, "Zz", "", "13C", "se"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string").select("label", S.classify_label(F.col("label")).alias("kind"))

    def plain(x):
        if x in S.RGROUP_SYMBOLS:
            return "rgroup"
        if x in S.ABBREVIATIONS:
            return "abbreviation"
        return "element" if re.search(S.BRACKET_ATOM, f"[{x}]", re.ASCII) else "other"

    assert {r["label"]: r["kind"] for r in rows.collect()} == {x: plain(x) for x in labels}


def test_masks_are_made_in_arrow_batches(spark):
    odd = {
        "[R12]N*": ("[12*]N*", {}, "[*:1001]N*", {1001: "R12"}),
        "[Et][ Xx ]C[OMe]": ("[50*][51*]C[52*]", {50: "Et", 51: " Xx ", 52: "OMe"}, "[*:1001][*:1002]C[*:1003]", {1001: "Et", 1002: "Xx", 1003: "OMe"}),
        "[50*][Foo][51*][Bar]": ("[50*][52*][51*][53*]", {52: "Foo", 53: "Bar"}, "[50*][*:1001][51*][*:1002]", {1001: "Foo", 1002: "Bar"}),
        "<unk>[Xx": ("C", {}, "<unk>[Xx", {}),
        "漢C[漢]%12B😀[a]": ("C[50*]%12B[51*]", {50: "漢", 51: "a"}, "漢C[*:1001]%12B😀[*:1002]", {1001: "漢", 1002: "a"}),
        "[[x]]": ("[50*]", {50: "[x"}, "[[*:1001]]", {1001: "x"}),
        "": ("", {}, "", {}),
        None: (None, None, None, None),
    }
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    got = rows.select("t", S.mask_labels(F.col("t")).alias("m"), S.alias_labels(F.col("t")).alias("a"))
    assert {r["t"]: (*r["m"], *r["a"]) for r in got.collect()} == odd
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_structures_do_not_copy_the_text_of_their_document():
    import pyarrow as pa

    from docmine.plans import derive as D

    text = " ".join(f"w{i}" for i in range(30_000))
    batch = pa.record_batch([pa.array([7]), pa.array(["s"]), pa.array([text])], names=["doc_id", "source", "text"])
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        found = [(b.column(0)[0].as_py(), b.num_rows) for b in D._structure_rows(iter([batch]))]
    finally:
        pa.set_memory_pool(before)
    assert found == [(7 * D.RUNS, 2500)]
    assert pool.max_memory() < 20 * len(text)


def test_numbers_are_checked_in_one_reading(spark, tmp_path):
    from docmine.operators import audit as A
    from docmine.plans import catalog

    smiles = spark.createDataFrame([(1, "[5*]C[05*][2*]"), (2, "[7*]"), (3, "C*"), (4, "[1*][1*]")], "mol_id long, smiles string")
    rows = [(1, "*", 5), (1, "C", 2), (2, "*", 8), (2, "*", 0), (4, "*", 1), (4, "*", 1), (9, "*", 3)]
    atoms = spark.createDataFrame(rows, "mol_id long, symbol string, isotope int")
    got = sorted(map(tuple, A.id_subset_check(smiles, atoms).collect()))
    assert got == [(1, 2, 1, False), (2, 1, 1, False), (4, 1, 0, True)]
    docs = spark.createDataFrame([(i, "s", f"a{i} b c d e f g h") for i in range(40)], "doc_id bigint, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    checked = catalog.QUERIES["isotope_subsets"](spark, str(tmp_path))
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("MapInArrow") == 1
