"""The streaming jobs over files written from the given tables, part after part."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.operators import pages as P
from docmine.plans.catalog.pages import REGIONS_SQL, RULE_SQL, lines, regions, rule
from docmine.plans.catalog.search import text_bits
from docmine.plans.registry import ORACLES, query
from docmine.session import materialise, release, scratch_path
from docmine.streaming import jobs

PARTS = 3


def streamed_mining(t):
    """Pages and regions arrive in three parts, those of one document in any of them and a
    region before or after its page."""
    spark, root, out = t.spark, scratch_path(t.spark, "arriving"), scratch_path(t.spark, "mined")
    part = lambda name: F.pmod(F.xxhash64(F.lit(name), "doc_id", "page_index"), F.lit(PARTS))
    hit = lines(t).select("doc_id", "page_index", rule().alias("hit"), part("page").alias("part"))
    boxes = regions(t).withColumn("part", part("region"))
    # Lines are cut and judged once for all parts.
    tables = [(name, materialise(df, name)) for name, df in (("pages", hit), ("regions", boxes))]
    for i in range(PARTS):
        for name, df in tables:
            df.filter(F.col("part") == i).drop("part").write.mode("append").parquet(f"{root}/{name}")
        read = lambda name, df: spark.readStream.schema(df.drop("part").schema).parquet(f"{root}/{name}")
        run = jobs.stream_mine_pages(read("pages", hit), read("regions", boxes), t.labels, F.col("hit"), out, f"{root}/checkpoint")
        run.awaitTermination()
    release(*[df for _, df in tables])
    return spark.read.parquet(out)


@query("streamed_page_funnel", ORACLES["mine_pages_funnel"])
def streamed_page_funnel(t):
    """Outcome counts of the page mining stream."""
    return P.funnel(jobs.mined_status(streamed_mining(t)))


@query(
    "streamed_page_status",
    f"""WITH {REGIONS_SQL},
    kept AS (SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM labels)),
    flags AS (SELECT k.doc_id, coalesce({RULE_SQL.replace('text', 'k.text')}, false) AS hit, d.doc_id IS NOT NULL AS drawn
      FROM kept k LEFT JOIN drawn d ON k.doc_id = d.doc_id AND k.page_index = d.page_index)
    SELECT doc_id, CASE WHEN bool_or(hit AND drawn) THEN 'saved' WHEN bool_or(hit) THEN 'no_structure' ELSE 'no_text_hit' END AS status,
      count(*) FILTER (hit AND drawn) AS n_pages FROM flags GROUP BY doc_id""",
)
def streamed_page_status(t):
    """Outcome and saved pages of every document, as the stream saw them last."""
    return jobs.mined_status(streamed_mining(t))


@query("streamed_leader_clusters")
def streamed_leader_clusters(t):
    """Documents in id order, in three parts; compared with the batch clusters in the tests.
    Every part joins the founders of those before it."""
    spark, root = t.spark, scratch_path(t.spark, "arriving")
    rows = materialise(text_bits(t.documents, "doc_id"), "arriving-bits")
    cuts = rows.select(F.percentile_approx("id", [i / PARTS for i in range(1, PARTS)])).first()[0] or [0] * (PARTS - 1)
    table = jobs.FounderTable(spark, threshold=0.5, every=2)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else F.col("id") > low
        rows.filter(inside if high is None else inside & (F.col("id") <= high)).write.mode("append").parquet(f"{root}/bits")
        src = spark.readStream.schema(rows.schema).parquet(f"{root}/bits")
        jobs.stream_assign_clusters(src, table, f"{root}/checkpoint").awaitTermination()
    release(rows)
    return table.clusters()


@query("streamed_baseline", ORACLES["running_baseline"])
def streamed_baseline(t):
    """Events in three parts by time; every part goes on from the baselines before it."""
    spark, root = t.spark, scratch_path(t.spark, "arriving")
    events = t.events.select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cuts = events.select(F.percentile_approx("us", [i / PARTS for i in range(1, PARTS)])).first()[0] or [0] * (PARTS - 1)
    user = events.schema["user_id"].dataType.simpleString()
    table = jobs.BaselineTable(
        spark, f"user_id {user}", lambda: {"hour": F.floor(F.col("us") / 3600000000)}, ["us", "event_id"], "value"
    )
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else F.col("us") > low
        events.filter(inside if high is None else inside & (F.col("us") <= high)).write.mode("append").parquet(f"{root}/events")
        src = spark.readStream.schema(events.schema).parquet(f"{root}/events")
        jobs.stream_baseline(src, table, f"{root}/checkpoint").awaitTermination()
    return table.rows().select("user_id", "event_id", "step", F.round(F.col("baseline") + 3.7e-10, 6).alias("baseline"))
