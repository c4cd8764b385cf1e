"""Evaluation of two tables and sample advantages against plain loops."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from docmine.functions import scalars as N
from docmine.functions import structures as S
from docmine.operators import evaluation as E

IDS = "benchmark string, image_id int"


def test_evaluate_two_tables(spark):
    truth = spark.createDataFrame([("a", 1, "CC"), ("a", 2, "C("), ("a", 3, "CN"), ("a", 4, "CO"), ("a", 5, None), ("b", 1, "N")], f"{IDS}, smiles string")
    images = spark.createDataFrame([("a", i) for i in (1, 2, 3, 5, 5, 9)] + [("b", 1)], IDS)
    given = [("a", 1, "m", "CC"), ("a", 2, "m", "CC"), ("a", 3, "m", "CN("), ("b", 1, "m", "O"), ("b", 1, "m", "N"), ("a", 1, "n", None), ("a", 1, "other", "C")]
    preds = spark.createDataFrame(given, f"{IDS}, mode string, smiles string")
    scored = E.evaluate(truth, images, preds, ["m", "n"], lambda c: c, S.is_valid_structure, N.edit_similarity)
    records = {(r["benchmark"], r["image_id"]): r["status"] for r in E.evaluation_records(scored, "m").collect()}
    # Unreadable truth is bad, unreadable predictions have failed, images without truth are not asked.
    assert records == {("a", 1): "match", ("a", 2): "bad_truth", ("a", 3): "failed", ("a", 5): "bad_truth", ("b", 1): "match"}
    m = {(r["benchmark"], r["mode"]): r for r in E.benchmark_metrics(scored, ["benchmark", "mode"]).collect()}
    assert (m["a", "m"]["total"], m["a", "m"]["valid"], m["a", "m"]["failed_predictions"], m["a", "m"]["exact_match_acc"]) == (4, 2, 1, 50.0)
    assert (m["a", "n"]["failed_predictions"], m["a", "n"]["avg_similarity"]) == (2, 0.0)
    assert m["b", "m"]["exact_match_acc"] == 100.0


def test_sample_advantages(spark):
    rows = [(0, "x", 0.2), (0, "x", 0.6), (0, "y", 0.3), (1, "x", None), (1, "y", 0.5), (1, "z", None), (1, "z", None), (3, "x", None), (4, "x", 0.1), (4, "y", 0.7), (4, "y", 0.7)]
    table = spark.createDataFrame(rows, "batch int, image string, distance double")
    got = sorted((r["batch"], r["image"], r["reward"], r["advantage"]) for r in E.sample_advantages(table, "batch", "image", alpha=0.5).collect())
    want, base = [], None
    for b in sorted({r[0] for r in rows}):
        reward = [(i, -2.0 if d is None else -d, d is not None) for n, i, d in rows if n == b]
        for i, r, _ in reward:
            group = [x for j, x, _ in reward if j == i]
            if len(group) == 1:
                want.append((b, i, r, r - (r if base is None else base)))
            else:
                mean, std = statistics.mean(group), statistics.stdev(group)
                want.append((b, i, r, (r - mean) / std if std > 1e-8 else r - mean))
        valid = [r for _, r, ok in reward if ok]
        mean = statistics.mean(valid) if valid else -2.0
        base = mean if base is None else 0.5 * base + 0.5 * mean
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert all(g[2:] == pytest.approx(w[2:]) for g, w in zip(got, sorted(want), strict=True))


def test_mean_risk_over_groups(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 3.0), (2, -5.0, 7.0)], "image int, log_prob double, cost double")
    row = E.mean_risk(df, "image", F.col("cost")).first()
    assert (row["risk"], row["n_groups"]) == (pytest.approx(4.5), 2)


def test_class_softmax_joins_no_table_of_keys(spark):
    rows = [(s, k, float(((s or 0) * 7 + k * 3) % 5)) for s in (1, 2, None) for k in range(7)]
    df = spark.createDataFrame(rows, "s int, k int, logit double")
    soft = E.class_softmax(df, ["s"])
    assert "Join" not in soft._jdf.queryExecution().executedPlan().toString()
    got = {(r["s"], r["k"]): r["p"] for r in soft.collect()}
    for s in (1, 2, None):
        logits = {k: x for g, k, x in rows if g == s}
        total = sum(math.exp(x) for x in logits.values())
        assert all(got[s, k] == pytest.approx(math.exp(x) / total) for k, x in logits.items())


def test_symmetric_edges_send_each_row_once(spark):
    rng = random.Random(5)
    at = [(1, 0, 1), (1, 1, 0), (1, 2, 2), (2, 4, 3), (3, 0, 2)]
    rows = [(s, i, j, k, rng.choice((0.1, 0.2, 0.3))) for s, i, j in at for k in range(7)]
    edges = E.symmetrise_edges(spark.createDataFrame(rows, "sample_id int, i int, j int, k int, p double"))
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    swap, cells = {5: 6, 6: 5}, {}
    for s, i, j, k, p in rows:
        for cell in ((s, i, j, k), (s, j, i, swap.get(k, k))):
            cells.setdefault(cell, []).append(p)
    want = {}
    for (s, i, j, k), ps in cells.items():
        want[s, i, j] = max(want.get((s, i, j), (-1, 0)), (statistics.mean(ps), -k))
    got = {(r["sample_id"], r["i"], r["j"]): (r["p"], -r["code"]) for r in edges.collect()}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
