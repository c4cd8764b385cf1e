import json
import random
import re

from pyspark.sql import functions as F

from docmine.functions import sequences as Q
from docmine.functions import structures as S


def one(spark, rows, schema, col):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_normalise_with_labels(spark):
    rows = [
        ("[2*]c1ccc(*)cc1*", ["X", "Ar"]), ("*CC*", ["X"]), ("CCO", []), (None, None), ("*C", None), ("*C[ab", ["Q"]),
    ]
    got = one(spark, rows, "s string, l array<string>", S.normalise_with_labels(F.col("s"), F.col("l")))
    assert got == ["[R2]c1ccc([X])cc1[Ar]", "[R]CC[R]", "CCO", None, "[R]C", "[Q]C[ab"]


def test_unclosed_bracket(spark):
    # The replacement scan swallows the rest, the count goes on behind the bracket.
    assert one(spark, [("*C[x*",)], "s string", S.quick_normalise(F.col("s"))) == ["[R]C[x*"]
    assert one(spark, [("*C[x*",)], "s string", S.bare_stars(F.col("s"))) == [2]


def test_estrings(spark):
    rows = [
        "CCO<sep>", "*CC<sep><a>0:R[1]</a>", "*CC*<sep><a>0:<dum></a><a>3:X'</a>", "CC<sep><a>0:R</a>",
        "*C<sep><a>9:R</a>", "CC<sep><r>0:R</r>", "CCO",
    ]
    got = one(spark, [(r,) for r in rows], "s string", S.convert_estring(F.col("s")))
    assert [(g["category"], g["smiles"]) for g in got] == [
        ("pure", "CCO"), ("wild", "[R1]CC"), ("wild", "[R]CC[X]"), ("wild", "CC"), ("fail", None),
        ("drop_tag", None), ("drop_tag", None),
    ]


def test_counts(spark):
    rows = [("c1ccccc1",), ("CC(=O)Oc1ccccc1C(=O)O",), ("C1CC2CCC1C2",), ("C%12CCCCC%12",)]
    got = one(spark, rows, "s string", F.struct(S.heavy_atoms(F.col("s")), S.ring_count(F.col("s"))))
    assert [tuple(g) for g in got] == [(6, 1), (13, 1), (7, 2), (6, 1)]


def test_balance(spark):
    rows = [("[a]",), ("]a[",), ("[[",), ("",)]
    assert one(spark, rows, "s string", S.brackets_balanced(F.col("s"))) == [True, False, False, True]


def loop_mask(text):
    text = text.replace("<unk>", "C")
    for r in S.RGROUP_SYMBOLS:
        text = text.replace(f"[{r}]", f"[{r[1:]}*]" if r[0] == "R" and r[1:].isdigit() else "*")
    out, mapping, n = [], {}, 50
    for token in re.findall(S.TOKEN_PATTERN, text):
        if token[0] == "[" and (token[1:-1] in S.ABBREVIATIONS or not re.match(S.BRACKET_ATOM, token)):
            while f"[{n}*]" in text or f"[{n}*]" in out:
                n += 1
            mapping[str(n)] = token[1:-1]
            token = f"[{n}*]"
        out.append(token)
    return "".join(out), mapping


def test_mask_labels_against_loop(spark):
    rows = ["C[R1][foo]N", "[50*]C[foo][Me]", "[Ar][X]C", "C<unk>[bar][bar]", "CC", "[NH3+][13CH3][zz]"]
    got = one(spark, [(r,) for r in rows], "s string", F.to_json(S.mask_labels(F.col("s"))))
    for text, result in zip(rows, got):
        value = json.loads(result)
        assert (value["masked"], value["mapping"]) == loop_mask(text), text


def test_alias_labels(spark):
    got = one(spark, [("C[foo][NH3+][ bar ]",)], "s string", F.to_json(S.alias_labels(F.col("s"))))
    assert json.loads(got[0]) == {"masked": "C[*:1001][NH3+][*:1002]", "mapping": {"1001": "foo", "1002": "bar"}}


def test_inline_labels(spark):
    rows = [("*C* $R1;;X;$",), ("CC |ext|",), ("*C $$",)]
    assert one(spark, rows, "s string", S.inline_labels(F.col("s"))) == ["[R1]C[X]", "CC", None]


def test_formula(spark):
    got = one(spark, [("C2H4O",), ("CH(CH3)2",)], "s string", S.formula_parts(F.col("s")))
    assert [tuple(p) for p in got[0]] == [("C", 2), ("H", 4), ("O", 1)]
    assert [tuple(p) for p in got[1]] == [("C", 1), ("H", 1), ("(CH3)", 2)]


def loop_reads(text):
    """The same grammar by recursive descent over characters."""
    marks = re.findall(r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFIbcnops*]|%\d\d|\d|[-=#$:/\\\\~]|[().]", text)
    if not text or "".join(marks) != text:
        return False
    rings, state = {}, {"i": 0, "atoms": 0}

    def peek():
        return marks[state["i"]] if state["i"] < len(marks) else ""

    def chain(bond_first, base):
        here = base
        if bond_first and peek() and peek() in "-=#$:/\\~":
            state["i"] += 1
        while True:
            m = peek()
            if not m or m in "-=#$:/\\~().%" or m[0] in "0123456789%":
                return False
            state["i"] += 1
            state["atoms"] += 1
            here = state["atoms"]
            while True:
                m = peek()
                if not m or m == ")":
                    return True
                if m == "(":
                    state["i"] += 1
                    if not chain(True, here) or peek() != ")":
                        return False
                    state["i"] += 1
                    continue
                if m == ".":
                    state["i"] += 1
                    break
                if m in "-=#$:/\\~":
                    state["i"] += 1
                    m = peek()
                    if not m or m[0] not in "0123456789%":
                        break
                if m[0] in "0123456789%":
                    state["i"] += 1
                    n = int(m.replace("%", ""))
                    if rings.get(n) == here:
                        return False
                    if rings.pop(n, None) is None:
                        rings[n] = here
                    continue
                break

    return chain(False, 0) and state["i"] == len(marks) and not rings


def test_readable_structures_against_descent(spark):
    import random

    rng = random.Random(6)
    rows = ["CC[", "C(C", "C1CC", "CC", "C(=O)O", "C()C", "c1ccccc1", "C11", "C1(C)1", "C=", "=C", "C.C", ".C", "C..C", "C(.C)", "[R]C[Ar]", "", "C%12CC%12", "C%01CC1", "C)C", "Cx", "C((C))", "C=1CC=1", "C(C)1CC1", "[]", "C[[N]]", "C-=C", "Cl", "(C)"]
    bits = ["C", "c", "[NH3+]", "(", ")", "1", "2", "%12", "=", ".", "Br", "*", "/", "[R]"]
    for _ in range(1500):
        rows.append("".join(rng.choice(bits[: rng.choice([3, 8, 14])]) for _ in range(rng.randrange(1, 10))))
    got = one(spark, [(r,) for r in rows] + [(None,)], "s string", S.is_valid_structure(F.col("s")))
    want = [loop_reads(r) for r in rows]
    assert [(r, g) for r, g, w in zip(rows, got, want) if g != w] == []
    assert got[-1] is False and 100 < sum(want) < 1400


def test_tokens_and_atoms_by_class_equal_the_published_pattern(spark):
    rng = random.Random(11)
    signs = "BrClNOSPFIbcnosp()[].=#-+\\/:~@?>*$%0129Rz {}\n"
    rows = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(500)]
    atom = re.compile(r"^([A-Za-z]+$|\[|\*$)")
    want = [re.findall(S.TOKEN_PATTERN, r) for r in rows]
    assert one(spark, [(r,) for r in rows], "s string", S.tokenise(F.col("s"))) == want
    assert one(spark, [(r,) for r in rows], "s string", S.atom_tokens(F.col("s"))) == [[t for t in ts if atom.match(t)] for ts in want]


def test_readable_structures_are_judged_in_batches(spark):
    plan = spark.range(1).select(S.is_valid_structure(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_encoding_takes_a_place_per_atom_without_running_counts(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choices(["C", "Cl", "[ab]", "*", "(", ")", "%12", "1", "x", "[", "é", "=", ":"], k=rng.randint(0, 14))) for _ in range(300)]
    atom = re.compile(r"^([A-Za-z]+$|\[|\*$)")

    def loop(text, bins):
        ids, seen = [Q.SOS], 0
        for t in re.findall(S.TOKEN_PATTERN, text):
            ids += [Q.FIRST_CHAR + Q.CHARACTERS.index(c) if c in Q.CHARACTERS else Q.UNK for c in t]
            if atom.match(t):
                x, y = bins[seen] if seen < len(bins) else (0, 0)
                ids, seen = ids + [Q.FIRST_X + x, Q.first_y() + y], seen + 1
        return [*ids, Q.EOS]

    given = [(r, [(i % 64, 3 * i % 64) for i in range(rng.randint(0, 9))]) for r in rows]
    col = Q.encode(F.col("s"), F.col("b"))
    assert one(spark, given, "s string, b array<struct<x:int,y:int>>", col) == [loop(r, b) for r, b in given]
    plan = spark.range(1).select(Q.encode(F.col("id").cast("string"), F.expr("array(struct(1 AS x, 2 AS y))")))._jdf.queryExecution().toString()
    assert "aggregate(" not in plan
