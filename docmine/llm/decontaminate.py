"""Benchmark passages in documents: item-sized windows, verified on weighted shingles.

DataFrame functions only. A document and an item are held against each other if the document
has one of the item's rarest shingles (so many of them that a passage must have one). Windows
as long as the item are then laid at every shingle of the item's in the document, and each is
verified exactly. A window that begins elsewhere is never better than the one at the next
such shingle, so this judges all windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions.binding import let
from docmine.session import materialise, release

#: Item shingles up to which their table is broadcast (24 bytes each); beyond it is shuffled.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; none for a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, width: int) -> Column:
    """Hash of every run of ``width`` words, in order."""
    return let(
        words,
        lambda w: F.when(
            F.size(w) >= width,
            F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def rarest(item_weights: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(item, size, width, h, item_total): per item its shingles held at the fewest places, with
    a weight of more than what a passage may lack (100 - percent of the item's)."""
    of_item = Window.partitionBy("item", "size")
    ranked = item_weights.join(held, ["width", "h"], "left").withColumns(
        {
            "item_total": F.sum("weight").over(of_item),
            "upto": F.sum("weight").over(of_item.orderBy(F.coalesce("places", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    return ranked.filter(100 * (F.col("upto") - F.col("weight")) <= (100 - percent) * F.col("item_total")).select(
        "item", "size", "width", "h", "item_total"
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, similarity, word_start, n_windows): documents holding a passage whose
    shingles of ``width`` words, weighted by their number, have 100 * common >= percent * all.

    Words are lower-case runs of letters and digits. A passage is a window of as many words as
    the item, or of those that are left at the document's end. ``word_start`` is where the
    first of the most similar windows begins, ``n_windows`` how many windows that begin with a
    shingle of the item's are over the bar. An item shorter than ``width`` is one shingle of
    its own length; an item without words matches nothing.

    Null texts hold nothing; rows without an id and items without one are left out; rows
    that share an id are judged by themselves and reported as one document; empty tables give
    no rows.
    """
    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), words_of(F.col(item_text)).alias("w"))
    items = materialise(
        items.withColumn("size", F.size("w")).filter("size > 0").withColumn("width", F.least(F.lit(width), "size")), "items"
    )
    # At most ``width`` different widths.
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    if not widths:
        widths = [width]
    item_shingles = None
    for v in widths:
        one = items.filter(F.col("width") == v).select("item", "size", "width", F.explode(shingles_of(F.col("w"), v)).alias("h"))
        item_shingles = one if item_shingles is None else item_shingles.unionByName(one)
    item_weights = materialise(item_shingles.groupBy("item", "size", "width", "h").agg(F.count(F.lit(1)).alias("weight")), "item-weights")
    small = F.broadcast if item_weights.count() <= BROADCAST_ROWS else lambda frame: frame

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("row"), words_of(F.col(text)).alias("words"))
    hits = None
    for v in widths:
        held = item_weights.filter(F.col("width") == v).select("h").distinct()
        n = F.greatest(F.size("words") - (v - 1), F.lit(0)).alias("n")
        one = rows.select("doc", "row", n, F.posexplode(shingles_of(F.col("words"), v)).alias("pos", "h")).join(small(held), "h")
        one = one.select("doc", "row", "n", F.lit(v).alias("width"), "pos", "h")
        hits = one if hits is None else hits.unionByName(one)
    # Equal rows under one id are one.
    hits = materialise(hits.distinct(), "hits")

    places = hits.groupBy("width", "h").agg(F.count(F.lit(1)).alias("places"))
    keys = materialise(rarest(item_weights, places, percent), "item-keys")
    near = hits.join(small(keys), ["width", "h"]).select("doc", "row", "width", "item", "size", "item_total").distinct()
    own = near.join(hits, ["doc", "row", "width"]).join(small(item_weights), ["item", "size", "width", "h"])
    own = own.select("doc", "row", "item", "size", "n", "item_total", "pos", "h", "weight", F.floor(F.col("pos") / F.col("item_total")).alias("bucket"))
    own = materialise(own, "own-hits")

    # A window has at most as many places as the item has shingles, so it lies in two buckets.
    pair = ["doc", "row", "item", "size"]
    counts = own.groupBy(*pair, "bucket", "item_total").agg(F.count(F.lit(1)).alias("c"))
    both = counts.select(*pair, "item_total", "c", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"))
    full = both.groupBy(*pair, "bucket", "item_total").agg(F.sum("c").alias("c")).filter(100 * F.col("c") >= percent * F.col("item_total"))
    starts = own.join(full.select(*pair, "bucket"), [*pair, "bucket"], "left_semi")
    starts = starts.select(*pair, "n", "item_total", F.col("pos").alias("start"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    inside = starts.join(own.select(*pair, "bucket", "pos", "h", "weight"), [*pair, "bucket"])
    inside = inside.filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("item_total")))
    window = [*pair, "start", "n", "item_total"]
    shared = inside.groupBy(*window, "h", "weight").agg(F.count(F.lit(1)).alias("times"))
    common = shared.groupBy(*window).agg(F.sum(F.least("times", "weight")).alias("common"))
    union = F.least(F.col("item_total"), F.col("n") - F.col("start")) + F.col("item_total") - F.col("common")
    found = common.filter(100 * F.col("common") >= percent * union).withColumn("similarity", F.col("common") / union)
    best = found.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("near_start"))).alias("b"), F.count(F.lit(1)).alias("n_windows")
    )
    out = materialise(best, "leaks").select(
        F.col("doc").alias(key), F.col("item").alias(item), F.col("b.similarity").alias("similarity"),
        (-F.col("b.near_start")).alias("word_start"), "n_windows",
    )
    release(items, item_weights, hits, keys, own)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage (see ``find_leaks``)."""
    gone = find_leaks(docs, benchmark, key=key, **options).select(F.col(key).alias("__dm_gone")).distinct()
    return docs.join(gone, docs[key] == gone["__dm_gone"], "left_anti")
