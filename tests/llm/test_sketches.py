"""Sketches that spare texts a way, and the tables a pipeline leaves behind."""

import os

import numpy as np
import pytest

import corpus_pipeline
from docmine.llm import jaccard_join
from tests.llm import fixtures as fx
from tests.llm.test_pipeline import COLUMNS, tables


@pytest.mark.parametrize("percent", [30, 60, 80, 95])
def test_sketches_miss_no_link(percent):
    rng = np.random.default_rng(percent)
    draw = lambda n: rng.integers(0, 1 << 63, n, np.uint64)
    sets = []
    for n in (1, 2, 5, 60, 64, 66, 120, 129, 250, 700):
        base = np.unique(draw(n))
        sets += [base, base.copy()]
        for share in (0.02, 0.1, 0.2, 0.4, 0.6):
            cut = max(1, int(n * share))
            sets += [np.unique(np.append(base[cut:], draw(cut))), np.append(base[: max(1, n - cut)], draw(0))]
    sizes, docs = np.array([len(s) for s in sets]), np.arange(len(sets))
    plain = [set(s.tolist()) for s in sets]
    second = rng.random(len(sets)) < 0.5
    for split in (np.zeros(len(sets), bool), second):
        keep = jaccard_join.may_link([jaccard_join.parity_sketch(s) for s in sets], sizes, docs, split, percent)
        for i in range(len(sets)):
            for j in range(i):
                if split.any() and split[i] == split[j]:
                    continue
                if 100 * len(plain[i] & plain[j]) >= percent * len(plain[i] | plain[j]):
                    assert keep[i] and keep[j]
    far = [np.unique(draw(200)) for _ in range(40)]
    none = np.zeros(40, bool)
    keep = jaccard_join.may_link([jaccard_join.parity_sketch(s) for s in far], np.full(40, 200), np.arange(40), none, max(80, percent))
    assert not keep.any()


def test_texts_of_few_documents_go_on(spark):
    rows = spark.range(20000).selectExpr("id as _doc", "string(id) as _text")
    rows = rows.unionByName(spark.createDataFrame([(None, "x"), (7, "again")], "_doc long, _text string"))
    ids = spark.createDataFrame([(7,), (19999,), (-3,)], "doc long")
    sent = jaccard_join.rows_of(rows, ids).collect()
    assert {(r._doc, r._text) for r in sent} >= {(7, "7"), (7, "again"), (19999, "19999")}
    assert len(sent) < 20
    assert jaccard_join.rows_of(rows, ids.limit(0)).collect() == []


def test_unlike_members_of_a_family_send_no_text(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 1 << 40, 80)) for _ in range(30)]
    texts.append(texts[4] + " one more")
    rows = spark.createDataFrame(list(enumerate(texts)), "_doc long, _text string")
    families = rows.selectExpr("0L as hub", "_doc as doc", "76L as n")
    taken = []
    whole = jaccard_join.rows_of
    monkeypatch.setattr(jaccard_join, "rows_of", lambda r, ids: taken.extend(x.doc for x in ids.collect()) or whole(r, ids))
    links = jaccard_join.family_links(families, rows, jaccard_join.set_sizes(rows, 5), 5, 80).collect()
    assert {frozenset(x) for x in links} == {frozenset((4, 30))}
    assert sorted(taken) == [4, 30]


def test_pipeline_keeps_no_table_of_an_earlier_stage(spark, tmp_path):
    rows, bench = tables()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file:")
    stages = [f"docmine-{name}-" for name, _ in corpus_pipeline.STAGES]
    left = lambda: {f for f in os.listdir(folder) if f.startswith(tuple(stages))}
    before = left()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [f.startswith(stages[-1]) for f in left() - before] == [True]
    assert out.count() > 30


def test_components_by_sketches_at_low_bounds(spark):
    rows = fx.awkward_rows()
    pairs = [(r[0], r[1]) for r in rows]
    out = jaccard_join.link_components(spark.createDataFrame(rows, fx.SCHEMA).repartition(3), 2, 40).collect()
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == fx.components(pairs, 2, 40)
