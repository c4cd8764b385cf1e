"""Incremental forms of page mining, founder clusters and the running baseline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from docmine.functions import geometry as G
from docmine.functions import scalars as N
from docmine.operators import search
from docmine.operators.ordering import ema_baseline
from docmine.operators.pages import keep_allowed
from docmine.session import materialise, release, scratch_path
from docmine.streaming.tables import BatchTable

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Document(StatefulProcessor):
    """One document: what is known of each page, whether a text hit was seen, how many pages
    are saved. Pages and drawings of a document may come in any order and batch. A state row
    holds what is known of ``RUN`` pages in a row, two bits each, since every look at the
    state is a call to another process."""

    HIT, DRAWN, PAGE = 1, 2, 4
    RUN = 31

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("page_runs", "run int", "flags bigint")
        self.document = handle.getValueState("document", "hit boolean, saved bigint, version bigint, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        hit, saved, version, closed = tuple(self.document.get()) if self.document.exists() else (False, 0, 0, False)
        if closed:
            return
        fresh = [(p, f) for frame in rows for p, f in zip(frame["page_index"].tolist(), frame["flags"].tolist(), strict=True)]
        known, stored, found, before = {}, {}, [], (hit, saved, version)
        both = self.HIT | self.DRAWN
        for page, flags in fresh:
            run, shift = page // self.RUN, 2 * (page % self.RUN)
            if run not in known:
                stored[run] = (self.pages.getValue((run,)) or (0,))[0]
                known[run] = stored[run]
            old = known[run] >> shift & both
            known[run] |= (flags & both) << shift
            hit |= bool(flags & self.HIT)
            if old != both and old | flags & both == both:
                found.append(page)
        for run, flags in known.items():
            if flags != stored[run]:
                self.pages.updateValue((run,), (flags,))
        if not any(f & self.PAGE for _, f in fresh) and version == 0:
            # Drawings alone make no document.
            return
        saved += len(found)
        status = "saved" if saved else "no_structure" if hit else "no_text_hit"
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if (hit, saved, version) != before or version == 0:
            version += 1
            self.document.update((hit, saved, version, False))
            yield self._frame(key[0], found, status, saved, version, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hit, saved, version, _ = tuple(self.document.get())
        status = "saved" if saved else "no_structure" if hit else "no_text_hit"
        self.pages.clear()
        self.document.update((hit, saved, version + 1, True))
        yield self._frame(key[0], [], status, saved, version + 1, True)

    @staticmethod
    def _frame(doc, pages, status, saved, version, closed) -> pd.DataFrame:
        rows = [(doc, p, None, saved, version, closed) for p in pages] + [(doc, None, status, saved, version, closed)]
        frame = pd.DataFrame(rows, columns=["doc_id", "page_index", "status", "n_pages", "version", "closed"])
        return frame.astype({"page_index": "Int32"})

    def close(self) -> None:
        pass


def stream_mine_pages(
    pages: DataFrame, regions: DataFrame, allow: DataFrame, rule: Column, out: str, checkpoint: str,
    doc: str = "doc_id", page: str = "page_index", idle_ms: int | None = None,
) -> StreamingQuery:
    """Page mining of arriving pages and regions, as parquet rows (doc_id, page_index, status,
    n_pages, version, closed): one per saved page and, where status is set, one for every
    change of a document's outcome (``mined_pages``, ``mined_status``). The allow-list, the
    text rule and the structure rule are those of ``mine_pages``.

    State is kept per document in RocksDB. Pages of a document may arrive in several batches,
    before or after their regions. With ``idle_ms`` a document nothing came for in that time
    is closed: its pages leave the state and later ones are ignored; such a query runs until
    it is stopped, one batch a second at most. A page counts once however often it arrives;
    a null rule is no hit.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    id_, at = F.col(doc).cast("bigint").alias("doc_id"), F.col(page).cast("int").alias("page_index")
    hit = F.when(rule, _Document.HIT).otherwise(0)
    text = keep_allowed(pages, allow, doc).select(id_, at, hit.bitwiseOR(F.lit(_Document.PAGE)).alias("flags"))
    drawn = keep_allowed(regions.filter(G.is_structure_region(F.col("w"), F.col("h"), F.col("n_lines"), F.col("n_corners"))), allow, doc)
    seen = text.unionByName(drawn.select(id_, at, F.lit(_Document.DRAWN).alias("flags")))
    mined = seen.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=_Document(idle_ms),
        outputStructType="doc_id bigint, page_index int, status string, n_pages bigint, version bigint, closed boolean",
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )
    # A run over what is there would go on for ever with timers, whose batches need no rows.
    trigger = {"availableNow": True} if idle_ms is None else {"processingTime": "1 second"}
    return (
        mined.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def mined_pages(rows: DataFrame) -> DataFrame:
    """Saved pages among the rows of ``stream_mine_pages``."""
    return rows.filter("page_index IS NOT NULL").select("doc_id", "page_index")


def mined_status(rows: DataFrame) -> DataFrame:
    """The last status of every document."""
    last = F.max_by(F.struct("status", "n_pages"), "version").alias("last")
    return rows.filter("status IS NOT NULL").groupBy("doc_id").agg(last).select("doc_id", "last.status", "last.n_pages")


def stream_funnel(statuses: DataFrame, name: str, checkpoint: str, status: str = "status") -> StreamingQuery:
    """Running outcome counts, complete after each batch; the state is one row per status."""
    counts = statuses.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.writeStream.format("memory")
        .queryName(name)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class FounderTable:
    """Founders' buckets as a table by bucket (see ``BatchTable``), clusters one folder per
    batch: a repeated batch replaces its own rows."""

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: float = 0.5, every: int = 16):
        self.spark = spark
        self.path = path or scratch_path(spark, "founders")
        self.threshold = threshold
        # Of a bucket's founders only the least is ever joined.
        fold = lambda rows: rows.groupBy("bucket").agg(F.min("id").alias("id"))
        self.founders = BatchTable(spark, f"{self.path}/founders", "id bigint, bucket binary", ["bucket"], fold, every=every)

    def assign(self, batch_df: DataFrame, batch_id: int) -> None:
        """Rows join the least earlier founder they share a bucket with; the rest settle
        their founders among themselves in id order."""
        usable, failed = search.with_bits(batch_df)
        buckets = materialise(search.lsh_buckets(usable, self.threshold), "batch-buckets")
        old = self.founders.as_of(batch_id, buckets)
        joined = (
            buckets.join(old.select("bucket", F.col("id").alias("cluster")), "bucket")
            .groupBy("id")
            .agg(F.min("cluster").alias("cluster"))
        )
        joined = materialise(joined, "batch-joined")
        rest = materialise(buckets.join(joined, "id", "left_anti"), "batch-open")
        lead_buckets = rest if rest.isEmpty() else rest.join(search.founders(rest), "id", "left_semi")
        self.founders.add(batch_id, lead_buckets)
        posts = lead_buckets.groupBy("bucket").agg(F.min("id").alias("cluster"))
        new = rest.join(posts, "bucket").groupBy("id").agg(F.min("cluster").alias("cluster"))
        named = failed.select(F.col("id").cast("bigint").alias("id"), F.col("cluster").cast("bigint").alias("cluster"))
        joined.unionByName(new).unionByName(named).write.mode("overwrite").parquet(f"{self.path}/clusters/batch={batch_id}")
        release(buckets, joined, rest)

    def clusters(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/clusters").select("id", "cluster")


def stream_assign_clusters(fingerprints: DataFrame, table: FounderTable, checkpoint: str) -> StreamingQuery:
    return (
        fingerprints.writeStream.foreachBatch(table.assign)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class BaselineTable:
    """Running baselines of a stream: each batch is folded in blocks like a batch table
    (``ema_baseline``), started from the last baseline of every key before it. A hot key's
    rows are spread over the batch's tasks; one row per key is carried on."""

    def __init__(
        self, spark: SparkSession, keys: str, buckets: Callable[[], dict[str, Column]], order: list[str], value: str,
        alpha: float = 0.1, path: str | None = None, every: int = 16,
    ):
        """``keys`` with their types (``"user_id bigint"``), ``buckets`` gives a coarse prefix
        of ``order`` (see ``rank_in_order``)."""
        self.spark, self.buckets, self.order, self.value, self.alpha = spark, buckets, order, value, alpha
        self.path = path or scratch_path(spark, "baseline")
        self.keys = T.StructType.fromDDL(keys).names
        latest = lambda rows: rows.groupBy(*self.keys).agg(
            F.max_by("start", "batch").alias("start"), F.max_by("seen", "batch").alias("seen")
        )
        self.last = BatchTable(spark, f"{self.path}/last", f"{keys}, start double, seen bigint", self.keys, latest, every=every)

    def fold(self, batch_df: DataFrame, batch_id: int) -> None:
        rows = materialise(batch_df, "batch-rows")
        before = self.last.as_of(batch_id, rows)
        run = ema_baseline(rows, self.keys, self.buckets(), self.order, self.value, self.alpha, start=before)
        out = f"{self.path}/rows/batch={batch_id}"
        run.write.mode("overwrite").parquet(out)
        done = self.spark.read.schema(run.schema).parquet(out)
        ends = done.groupBy(*self.keys).agg(F.max_by("baseline", "step").alias("start"), F.max("step").alias("seen"))
        self.last.add(batch_id, ends)
        release(rows)

    def rows(self) -> DataFrame:
        """Every row with its step and baseline."""
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")


def stream_baseline(rows: DataFrame, table: BaselineTable, checkpoint: str) -> StreamingQuery:
    """Rows of a key must arrive in order from batch to batch; inside a batch any order does."""
    return (
        rows.writeStream.foreachBatch(table.fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pair_distances(vectors: DataFrame, pairs: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Distance and same flag of listed pairs (a, b) of embedded items."""
    a = vectors.select(F.col(key).alias("a"), F.col("result").alias("_a"))
    b = vectors.select(F.col(key).alias("b"), F.col("result").alias("_b"))
    d = N.l2_distance(F.col("_a"), F.col("_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", d.alias("distance"), (d < threshold).alias("same"))
