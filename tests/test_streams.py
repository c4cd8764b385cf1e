"""Streams against the batch operators over the same rows, in several batches."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docmine.operators import ordering, pages, search
from docmine.streaming import jobs
from docmine.streaming.tables import BatchTable
from tests.test_jobs import shuffled_sets

PAGES = "doc_id bigint, page_index int, text string"
REGIONS = "doc_id bigint, page_index int, w int, h int, n_lines int, n_corners int"




def mining_rows(seed):
    rng = random.Random(seed)
    rows = [(d, p, rng.choice(["hit", "hit", "none", None])) for d in range(40) for p in range(rng.randrange(0, 5))]
    boxes = [(d, p, 200, rng.choice([200, 20]), 20, 20) for d in range(45) for p in range(5) if rng.random() < 0.7]
    rng.shuffle(rows)
    rng.shuffle(boxes)
    return rows, boxes


def test_mined_pages_equal_batch(spark, tmp_path):
    rows, boxes = mining_rows(3)
    allow = spark.range(38).withColumnRenamed("id", "doc_id")
    rule = F.col("text") == "hit"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for i in range(3):
        spark.createDataFrame(rows[i::3], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
        # Regions of the last pages come first.
        spark.createDataFrame(boxes[2 - i :: 3], REGIONS).coalesce(1).write.mode("append").parquet(str(tmp_path / "regions"))
        src = spark.readStream.schema(PAGES).parquet(str(tmp_path / "pages"))
        drawn = spark.readStream.schema(REGIONS).parquet(str(tmp_path / "regions"))
        jobs.stream_mine_pages(src, drawn, allow, rule, out, checkpoint).awaitTermination(120)
    mined = pages.mine_pages(spark.createDataFrame(rows, PAGES), allow, spark.createDataFrame(boxes, REGIONS), rule)
    got = spark.read.parquet(out)
    want = sorted((r["doc_id"], r["page_index"]) for r in mined.filter("saved").collect())
    assert sorted((r["doc_id"], r["page_index"]) for r in jobs.mined_pages(got).collect()) == want and len(want) > 5
    status = sorted(tuple(r) for r in pages.document_status(mined).collect())
    assert sorted(tuple(r) for r in jobs.mined_status(got).collect()) == status
    assert len({s for _, s, _ in status}) == 3


def test_idle_documents_are_closed(spark, tmp_path):
    allow = spark.range(10).withColumnRenamed("id", "doc_id")
    spark.createDataFrame([(1, 0, "hit"), (2, 0, "none")], PAGES).coalesce(1).write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([(1, 0, 200, 200, 20, 20), (1, 1, 200, 200, 20, 20)], REGIONS).coalesce(1).write.parquet(str(tmp_path / "regions"))
    src = spark.readStream.schema(PAGES).parquet(str(tmp_path / "pages"))
    drawn = spark.readStream.schema(REGIONS).parquet(str(tmp_path / "regions"))
    query = jobs.stream_mine_pages(src, drawn, allow, F.col("text") == "hit", str(tmp_path / "out"), str(tmp_path / "c"), idle_ms=500)
    mined = "doc_id bigint, page_index int, status string, n_pages bigint, version bigint, closed boolean"
    (tmp_path / "out").mkdir(exist_ok=True)
    try:
        for _ in range(40):
            rows = spark.read.schema(mined).parquet(str(tmp_path / "out"))
            if rows.filter("closed").count() == 2:
                break
            time.sleep(1)
    finally:
        query.stop()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"] for r in rows.filter("closed").collect()} == {1, 2}
    assert sorted(tuple(r) for r in jobs.mined_status(rows).collect()) == [(1, "saved", 1), (2, "no_text_hit", 0)]


def test_stream_funnel(spark, tmp_path):
    spark.createDataFrame([(i, 0, "hit" if i % 2 else "none") for i in range(10)], PAGES).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(PAGES).parquet(str(tmp_path / "in"))
    status = src.select(F.when(F.col("text") == "hit", "saved").otherwise("no_text_hit").alias("status"))
    jobs.stream_funnel(status, "funnel", str(tmp_path / "c2")).awaitTermination(60)
    assert dict(tuple(r) for r in spark.table("funnel").collect()) == {"saved": 5, "no_text_hit": 5}


@pytest.mark.parametrize("every", [1, 2, 16])
def test_batch_table_as_of_any_batch(spark, tmp_path, every):
    latest = lambda rows: rows.groupBy("k").agg(F.max_by("v", "batch").alias("v"))
    table = BatchTable(spark, str(tmp_path / "t"), "k bigint, v bigint", ["k"], latest, parts=8, every=every)
    rng, state, states = random.Random(every), {}, []
    for batch in range(6):
        rows = [(k, batch) for k in range(20) if rng.random() < 0.3]
        states.append(dict(state))
        # A batch that runs twice reads and leaves the same.
        for _ in range(2):
            keys = spark.createDataFrame(rows + [(50, 0)], "k bigint, v bigint")
            got = {r["k"]: r["v"] for r in table.as_of(batch, keys).collect()}
            assert got.items() <= state.items() and {k: state[k] for k, _ in rows if k in state}.items() <= got.items()
            table.add(batch, spark.createDataFrame(rows, "k bigint, v bigint"))
        state.update(rows)
    assert {r["k"]: r["v"] for r in table.as_of(6).collect()} == state


def test_stream_clusters_equal_leader(spark, tmp_path):
    schema = "id bigint, bits array<int>"
    rows = shuffled_sets(8, 24) + [(9000, []), (9001, None)]
    want = {r["id"]: r["cluster"] for r in search.leader_clusters(spark.createDataFrame(rows, schema)).collect()}
    table = jobs.FounderTable(spark, str(tmp_path / "t"), every=2)
    third = -(-len(rows) // 3)
    for i in range(3):
        spark.createDataFrame(rows[i * third : (i + 1) * third], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_assign_clusters(src, table, str(tmp_path / "c")).awaitTermination(120)
    assert {r["id"]: r["cluster"] for r in table.clusters().collect()} == want
    # A batch that is run again changes nothing.
    table.assign(spark.createDataFrame(rows[2 * third :], schema), 2)
    assert {r["id"]: r["cluster"] for r in table.clusters().collect()} == want


@pytest.mark.parametrize("alpha", [0.1, 0.95, 1.0])
def test_stream_baseline_equals_batch(spark, tmp_path, alpha):
    rng = random.Random(2)
    schema = "key string, ord bigint, id bigint, value double"
    rows = [(rng.choice(["a", "hot", "hot", "hot", None]), i // 2, i, rng.uniform(-3, 3)) for i in range(1500)]
    make = lambda: {"b": F.floor(F.col("ord") / 100)}
    batch = ordering.ema_baseline(spark.createDataFrame(rows, schema), ["key"], make(), ["ord", "id"], "value", alpha)
    want = {r["id"]: (r["step"], r["baseline"]) for r in batch.collect()}
    table = jobs.BaselineTable(spark, "key string", make, ["ord", "id"], "value", alpha, str(tmp_path / "t"), every=1)
    for part in (rows[:700], rows[700:710], rows[710:]):
        shuffled = rng.sample(part, len(part))
        spark.createDataFrame(shuffled, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_baseline(src, table, str(tmp_path / "c")).awaitTermination(120)
    got = {r["id"]: (r["step"], r["baseline"]) for r in table.rows().collect()}
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], rel=1e-9, abs=1e-9) for i in want)
    table.fold(spark.createDataFrame(rows[710:], schema), 2)
    assert {r["id"]: r["step"] for r in table.rows().collect()} == {i: s for i, (s, _) in want.items()}


def test_document_state_is_asked_by_runs_of_pages():
    """A page with its drawing counts once, in any order and batch, and a document's pages are
    not looked up one by one."""
    calls = []

    class Held:
        def __init__(self, name):
            self.name, self.rows = name, {}

        def exists(self):
            return bool(self.rows)

        def get(self):
            return self.rows[()]

        def update(self, value):
            self.rows[()] = value

        def containsKey(self, key):
            calls.append("contains")
            return key in self.rows

        def getValue(self, key):
            calls.append("get")
            return self.rows.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            self.rows[key] = value

    class Handle:
        def getMapState(self, name, *_):
            return Held(name)

        getValueState = getMapState

    document = jobs._Document(None)
    document.init(Handle())
    page, hit, drawn = 4, 1, 2

    def feed(rows):
        frame = pd.DataFrame(rows, columns=["page_index", "flags"])
        out = list(document.handleInputRows((7,), iter([frame]), None))
        return [r for f in out for r in f["page_index"].dropna().tolist()], [f["n_pages"].tolist()[-1] for f in out]

    assert feed([(p, drawn) for p in range(-3, 93, 3)]) == ([], [])
    assert len(calls) <= 10
    found, saved = feed([(p, page | (hit if p % 2 == 0 else 0)) for p in range(-3, 93)])
    assert sorted(found) == list(range(0, 93, 6)) and saved == [16]
    assert feed([(p, page | hit) for p in range(0, 93, 6)]) == ([], [])
    assert feed([(3, page | hit), (3, drawn), (1, drawn | hit), (1, hit)]) == ([3, 1], [18])
    assert len(calls) <= 40
