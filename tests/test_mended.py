"""Cases that once gave wrong results."""

import random

import pytest
from pyspark.sql import functions as F

from docmine import session
from docmine.functions import sequences as Q
from docmine.functions import text as T
from docmine.operators import evaluation, ordering, sampling, search
from docmine.sources import store
from docmine.streaming.jobs import FounderTable


@pytest.mark.parametrize("alpha", [0.001, 0.1, 0.5, 0.95, 0.99, 1.0])
def test_running_baseline_for_every_alpha(spark, alpha):
    rng = random.Random(1)
    values = [rng.uniform(-5, 5) for _ in range(700)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, t int, x double")
    got = ordering.ema_baseline(df, ["k"], {"_b": F.floor(F.col("t") / 100)}, ["t"], "x", alpha).orderBy("t").collect()
    want = None
    for row, v in zip(got, values, strict=True):
        want = v if want is None else (1 - alpha) * want + alpha * v
        assert row["baseline"] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_running_baseline_refuses_other_alphas(spark):
    df = spark.createDataFrame([("k", 1, 1.0)], "k string, t int, x double")
    with pytest.raises(ValueError):
        ordering.ema_baseline(df, ["k"], {"_b": F.lit(0)}, ["t"], "x", 0.0)


def test_stage_of_a_broken_build_is_not_reused(spark, tmp_path):
    path, rows = str(tmp_path / "stage"), lambda n: lambda: spark.range(n)
    assert store.reuse_or_build(spark, path, {"a": 1}, 3, rows(3)).count() == 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.reuse_or_build(spark, path, {"a": 2}, 7, broken)
    assert store.reuse_or_build(spark, path, {"a": 1}, 3, broken).count() == 3
    assert store.reuse_or_build(spark, path, {"a": 2}, 7, rows(7)).count() == 7


def test_rows_without_bits_fail_in_batch_and_stream(spark, tmp_path):
    rows = [(1, [1, 2, 3]), (2, [1, 2, 3]), (3, []), (4, None), (5, [])]
    df = spark.createDataFrame(rows, "id bigint, bits array<int>")
    want = {1: 1, 2: 1, 3: None, 4: None, 5: None}
    for cluster in (search.leader_clusters, search.component_clusters):
        assert {r["id"]: r["cluster"] for r in cluster(df).collect()} == want
    stats = search.cluster_stats(search.leader_clusters(df), df).first()
    assert (stats["total"], stats["processed"], stats["failed"], stats["clusters"]) == (5, 2, 3, 1)
    table = FounderTable(spark, str(tmp_path / "founders"))
    table.assign(df, 0)
    assert {r["id"]: r["cluster"] for r in table.clusters().collect()} == want


def test_a_query_without_bits_is_refused(spark):
    db = spark.createDataFrame([(1, [1, 2])], "id bigint, bits array<int>")
    query = spark.createDataFrame([(7, [1]), (8, [])], "id bigint, bits array<int>")
    assert [(r["query_id"], r["id"]) for r in search.substructure_screen(query.filter("id = 7"), db).collect()] == [(7, 1)]
    with pytest.raises(Exception, match="without bits"):
        search.substructure_screen(query, db).collect()


def test_white_space_of_any_kind_is_trimmed(spark):
    df = spark.createDataFrame([("a\r\n\tb\n\t\n",), ("\n\t1. A claim",), (" \t\r\n",)], "t string")
    got = df.select(T.list_items(F.col("t")).alias("l"), T.starts_numbered_item(F.col("t")).alias("n"), T.is_blank(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], False, False), (["1. A claim"], True, False), ([], False, True)]


def test_special_tokens_inside_break_the_grammar(spark):
    char = Q.FIRST_CHAR
    cases = [([1, char, 2, 0, 0], 0), ([1, char, 0, char, 2], 1), ([1, char, 1, char, 2], 1), ([1, char, 3, 2], 1), ([], 0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "ids array<int>")
    assert [r[0] for r in df.select(Q.grammar_violations(F.col("ids"))).collect()] == [n for _, n in cases]


def test_valid_ratio_counts_images(spark):
    df = spark.createDataFrame([(1, 0.2, True), (1, 0.9, False), (2, 0.9, False), (3, 0.4, True)], "image int, d double, ok boolean")
    row = evaluation.distance_stats(df, F.col("d"), F.col("ok"), (), "image").first()
    assert row["valid_ratio"] == pytest.approx(2 / 3) and row["min_distance"] == 0.2 and row["avg_distance"] == pytest.approx(0.3)


def test_a_split_needs_two_rows(spark):
    for n in (0, 1):
        with pytest.raises(Exception, match="at least two rows"):
            sampling.train_val_split(spark.range(n), ["id"], 0.1).collect()
    assert sorted(r["split"] for r in sampling.train_val_split(spark.range(2), ["id"], 0.5).collect()) == ["train", "val"]


def test_stored_tables_can_be_released(spark):
    stored = session.materialise(spark.range(3), "t")
    assert stored.count() == 3
    session.release(stored)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|NOT_FOUND"):
        spark.read.parquet(stored.scratch).count()
