"""Page layout: box joins, reading order, claim spans, crop geometry.

A page is one raster, so the number of its boxes has a physical limit; operators that
walk a page in order work per (document, page). Box pairs are only formed between boxes
that share a vertical band, never between all boxes of a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions import geometry as G
from docmine.functions import text as T
from docmine.session import materialise

PAGE = ("doc_id", "page_index")
BOX = ("x0", "y0", "x1", "y1")


def _other(df: DataFrame, cols: Sequence[str], prefix: str = "o_") -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) if c in cols else F.col(c) for c in df.columns])


def nearest_same_column(
    lines: DataFrame, reach: float = 80.0, min_overlap: float = 0.3, none: float = 1000.0, keys=PAGE
) -> DataFrame:
    """Vertical centre distance to the nearest other box of the same column.

    Boxes within ``reach`` are found in neighbouring bands. Only boxes without such a
    neighbour are compared with the rest of their page: they stand at least ``reach``
    apart in their column, so a page holds few of them. The result is exact.
    """
    boxes = lines.select(*keys, *BOX).distinct()
    mine, theirs = G.box(), G.box("o_")
    width = mine[2] - mine[0]
    shared = F.greatest(F.lit(0.0), F.least(mine[2], theirs[2]) - F.greatest(mine[0], theirs[0]))
    same_box = (
        (mine[0] == theirs[0]) & (mine[1] == theirs[1]) & (mine[2] == theirs[2]) & (mine[3] == theirs[3])
    )
    partner = ~same_box & ((width <= 0) | (shared >= width * min_overlap))
    gap = F.abs(G.centre_y(mine) - G.centre_y(theirs))
    band = F.floor(G.centre_y(mine) / reach)
    banded = boxes.withColumn("_band", band)
    probes = boxes.withColumn("_band", F.explode(F.array(band - 1, band, band + 1)))
    near = (
        probes.join(_other(banded, BOX), [*keys, "_band"])
        .filter(partner)
        .groupBy(*keys, *BOX)
        .agg(F.min(gap).alias("_d"))
        .filter(F.col("_d") <= reach)
    )
    lonely = boxes.join(near, [*keys, *BOX], "left_anti")
    far = (
        lonely.join(_other(boxes, BOX), list(keys))
        .filter(partner)
        .groupBy(*keys, *BOX)
        .agg(F.min(gap).alias("_d"))
    )
    found = near.unionByName(far)
    return (
        lines.join(found, [*keys, *BOX], "left")
        .withColumn("min_y_distance", F.coalesce("_d", F.lit(none)))
        .drop("_d")
    )


def drop_isolated_small(lines: DataFrame, max_area: float = 2000, min_distance: float = 80) -> DataFrame:
    return lines.filter(
        ~((G.area(G.box()) < max_area) & (F.col("min_y_distance") > min_distance))
    )


def drop_covered(
    lines: DataFrame, blocks: DataFrame, page_width: float, threshold: float = 0.5, band: float = 200.0, keys=PAGE
) -> DataFrame:
    """Drop lines covered by a non-text block over ``threshold`` of their area.

    Blocks wider than half the page reach over its full width. Covering more than half of
    a line includes its centre, so a line meets only the blocks of its centre's band.
    """
    if threshold < 0.5:
        raise ValueError("threshold below 0.5 would need another band rule")
    wide = F.col("x1") - F.col("x0") > page_width / 2
    cover = blocks.filter(~F.col("label").isin("text", "formula")).select(
        *keys,
        F.when(wide, F.lit(0.0)).otherwise(F.col("x0")).alias("o_x0"),
        F.col("y0").alias("o_y0"),
        F.when(wide, F.lit(float(page_width))).otherwise(F.col("x1")).alias("o_x1"),
        F.col("y1").alias("o_y1"),
        F.explode(
            F.sequence(F.floor(F.col("y0") / band), F.floor(F.greatest("y0", "y1") / band))
        ).alias("_band"),
    )
    staged = lines.withColumn("_band", F.floor(G.centre_y(G.box()) / band))
    same = F.lit(True)
    renamed = cover.select(*[F.col(c).alias(f"_c_{c}") if c in (*keys, "_band") else F.col(c) for c in cover.columns])
    for k in (*keys, "_band"):
        same = same & (F.col(k) == F.col(f"_c_{k}"))
    covered = (G.area(G.box()) > 0) & (
        G.overlap_area(G.box(), G.box("o_")) / G.area(G.box()) > threshold
    )
    return staged.join(renamed, same & covered, "left_anti").drop("_band")


def assign_points_to_boxes(
    points: DataFrame, boxes: DataFrame, value: str, order: str, band: float = 200.0, keys=PAGE
) -> DataFrame:
    """Each box takes the value of the first line whose top-left corner lies in it (edges
    included); boxes without one get null."""
    spread = boxes.withColumn(
        "_band",
        F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.greatest("y0", "y1") / band))),
    )
    corners = points.select(
        *keys,
        F.col("x0").alias("_px"),
        F.col("y0").alias("_py"),
        F.col(value).alias("_value"),
        F.col(order).alias("_order"),
        F.floor(F.col("y0") / band).alias("_band"),
    )
    hits = (
        spread.join(corners, [*keys, "_band"])
        .filter(G.contains_point(G.box(), F.col("_px"), F.col("_py")))
        .groupBy(*keys, "block_id")
        .agg(F.min_by("_value", "_order").alias(value))
    )
    return boxes.join(hits, [*keys, "block_id"], "left")


def merge_items(lines: DataFrame, blocks: DataFrame, keys=PAGE) -> DataFrame:
    """Image blocks and text lines under common names."""
    images = blocks.filter("label = 'image'").select(
        *keys, F.lit("image").alias("type"), F.col("content"), *BOX, F.col("block_id").alias("item_id")
    )
    texts = lines.select(
        *keys, F.lit("text").alias("type"), F.col("text").alias("content"), *BOX, F.col("line_id").alias("item_id")
    )
    return images.unionByName(texts)


def column_side(page_width: float) -> Column:
    return F.when(G.centre_x(G.box()) < page_width / 2, "left").otherwise("right")


def reading_order(items: DataFrame, page_width: float, y_tol: float = 15, keys=PAGE) -> DataFrame:
    """Left column first; inside a column by row group of ``y_tol`` pixels, then by x."""
    order = Window.partitionBy(*keys).orderBy(
        column_side(page_width), F.floor(G.centre_y(G.box()) / y_tol), G.centre_x(G.box()), "type", "item_id"
    )
    return items.withColumn("pos", F.row_number().over(order))


def claim_pages(
    ordered: DataFrame,
    page_width: float,
    phrases: Sequence[str] = T.CLAIM_SENTENCES,
    topics: Sequence[str] = T.EXCLUDED_TOPICS,
    mark: str = "R",
    same_line: float = 15,
    keys=PAGE,
) -> DataFrame:
    """Claim span of each page and its status.

    The items of a page (a bounded list) are brought together once; the claim row, the
    first image after it and the first numbered row after that are then looked up in the
    list. Items may carry ``reread``, a second reading of the same box.
    Status: null without a claim phrase, else no_image, topic_excluded, no_marker,
    cross_page, no_text or saved; ``span`` holds the kept items of a saved page.
    """
    if "reread" not in ordered.columns:
        ordered = ordered.withColumn("reread", F.lit(None).cast("string"))
    padded = ordered.select(
        *keys,
        F.struct(
            "pos",
            "type",
            F.coalesce("content", F.lit("")).alias("content"),
            F.coalesce("reread", F.lit("")).alias("reread"),
            (F.col("x0") - 10).alias("x0"),
            F.col("y0"),
            F.col("x1"),
            (F.col("y1") + 5).alias("y1"),
        ).alias("item"),
    )
    pages = padded.groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))

    def first(cond):
        return F.try_element_at(F.filter("items", cond), F.lit(1))["pos"]

    is_image = lambda i: i["type"] == "image"
    pages = pages.withColumn("claim", first(lambda i: T.any_phrase(i["content"], phrases)))
    pages = pages.withColumn("image", first(lambda i: is_image(i) & (i["pos"] > F.col("claim"))))
    before = F.array_join(
        F.transform(F.filter("items", lambda i: i["pos"] < F.col("image")), lambda i: i["content"]), ""
    )
    shown = F.try_element_at(F.filter("items", lambda i: i["pos"] == F.col("image")), F.lit(1))
    numbered = lambda i: (
        T.starts_numbered_item(i["content"]) | T.starts_numbered_item(i["reread"])
    )
    pages = pages.withColumn(
        "end", first(lambda i: (i["type"] == "text") & (i["pos"] > F.col("image")) & numbered(i))
    )
    pages = pages.withColumn(
        "stop", F.try_element_at(F.filter("items", lambda i: i["pos"] == F.col("end")), F.lit(1))
    )

    def side(i):
        return (i["x0"] + i["x1"]) / 2.0 < page_width / 2

    def level(i):
        return (i["y0"] + i["y1"]) / 2.0

    def beside_stop(i):
        stop = F.col("stop")
        return (side(i) == side(stop)) & (F.abs(level(i) - level(stop)) < same_line)

    tail = F.filter(
        "items",
        lambda i: (i["pos"] >= F.col("image")) & (i["pos"] < F.col("end")) & ~beside_stop(i),
    )
    pages = pages.withColumn("tail", tail)
    head = F.filter(
        "items", lambda i: (i["pos"] >= F.col("claim")) & (i["pos"] <= F.col("image"))
    )
    status = (
        F.when(F.col("claim").isNull(), None)
        .when(F.col("image").isNull(), "no_image")
        .when(T.excluded_topic(before, topics), "topic_excluded")
        .when(~T.has_marker(shown["content"], shown["reread"], mark), "no_marker")
        .when(F.col("end").isNull(), "cross_page")
        .when(~F.exists("tail", lambda i: i["type"] == "text"), "no_text")
        .otherwise("saved")
    )
    return pages.withColumn("status", status).select(
        *keys, "claim", "image", "end", "status",
        F.when(F.col("status") == "saved", F.array_distinct(F.concat(head, "tail"))).alias("span"),
    )


def claim_documents(pages: DataFrame) -> DataFrame:
    """The first decisive page settles a document; cross-page pages pass on."""
    decisive = F.col("status").isin("saved", "no_image", "topic_excluded", "no_marker")
    return pages.groupBy("doc_id").agg(
        F.min_by("status", F.when(decisive, F.col("page_index"))).alias("_s"),
        F.min(F.when(decisive, F.col("page_index"))).alias("_p"),
        F.coalesce(F.bool_or(F.col("status") == "cross_page"), F.lit(False)).alias("_cross"),
        F.coalesce(F.bool_or(F.col("status") == "no_text"), F.lit(False)).alias("_bare"),
    ).select(
        "doc_id",
        F.when(F.col("_p").isNotNull(), F.col("_s"))
        .when(F.col("_cross"), "cross_page")
        .when(F.col("_bare"), "no_text")
        .otherwise("no_claim")
        .alias("status"),
        F.col("_p").alias("page_index"),
    )


def claim_span_rows(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Boxes of the saved page of each saved document."""
    saved = documents.filter("status = 'saved'").select("doc_id", "page_index")
    return (
        pages.join(saved, list(PAGE), "left_semi")
        .select(*PAGE, F.explode("span").alias("i"))
        .select(*PAGE, "i.pos", "i.type", "i.content", "i.x0", "i.y0", "i.x1", "i.y1")
    )


def crop_regions(
    span: DataFrame, page_width: float, page_height: float, gap: float = 95, margin: float = 0, keys=PAGE
) -> DataFrame:
    """Crop rectangles: boxes of a column form islands split by vertical gaps; islands are
    widened to their column and stacked left column first. Adds the paste offset and the
    canvas size."""
    column = Window.partitionBy(*keys, "side").orderBy("pos")
    marked = span.withColumn("side", column_side(page_width)).withColumn(
        "_break", F.when(F.col("y0") - F.lag("y1").over(column) > gap, 1).otherwise(0)
    )
    islands = marked.withColumn(
        "island", F.sum("_break").over(column.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    )
    left = F.col("side") == "left"
    boxes = islands.groupBy(*keys, "side", "island").agg(
        F.min("x0").alias("_x0"), F.min("y0").alias("_y0"), F.max("x1").alias("_x1"), F.max("y1").alias("_y1")
    ).select(
        *keys,
        "side",
        "island",
        F.when(left, F.lit(page_width / 8)).otherwise(
            F.least(F.lit(page_width / 2), F.col("_x0") - margin)
        ).alias("x0"),
        F.greatest(F.lit(0.0), F.col("_y0") - margin).alias("y0"),
        F.when(left, F.greatest(F.lit(page_width / 2), F.col("_x1") + margin)).otherwise(
            F.lit(page_width * 7 / 8)
        ).alias("x1"),
        F.least(F.lit(float(page_height)), F.col("_y1") + margin).alias("y1"),
    )
    pixels = boxes.withColumns({c: F.bround(c).cast("int") for c in BOX})
    page = Window.partitionBy(*keys)
    stacked = page.orderBy("side", "island").rowsBetween(Window.unboundedPreceding, -1)
    height = F.col("y1") - F.col("y0")
    return pixels.withColumns(
        {
            "offset_y": F.coalesce(F.sum(height).over(stacked), F.lit(0)).cast("int"),
            "canvas_w": F.max(F.col("x1") - F.col("x0")).over(page),
            "canvas_h": F.sum(height).over(page).cast("int"),
        }
    )


def chain_lines(
    lines: DataFrame, seed: Column, v_gap: float = 10, h_tol: float = 5, keys=PAGE
) -> DataFrame:
    """Text continued over the lines below each seed line.

    Going down by y from a seed (its ``seed`` text starts the chain): a line further than
    ``v_gap`` below the current bottom ends the chain, one centred within ``h_tol`` of the
    seed is appended and moves the bottom, others are passed over.
    """
    item = F.struct(
        "y0", "line_id", F.coalesce("text", F.lit("")).alias("text"), seed.alias("seed"),
        G.centre_x(G.box()).alias("cx"), "y1",
    )
    pages = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))

    def chain(base, place):
        start = F.struct(base["seed"].alias("out"), base["y1"].alias("bottom"), F.lit(False).alias("done"))

        def step(acc, line):
            done = acc["done"] | (line["y0"] - acc["bottom"] > v_gap)
            take = ~done & (F.abs(line["cx"] - base["cx"]) <= h_tol)
            return F.struct(
                F.when(take, F.concat(acc["out"], line["text"])).otherwise(acc["out"]).alias("out"),
                F.when(take, line["y1"]).otherwise(acc["bottom"]).alias("bottom"),
                done.alias("done"),
            )

        rest = F.slice(F.col("items"), place + F.lit(2), F.size("items"))
        return F.aggregate(rest, start, step, lambda acc: acc["out"])

    found = F.filter(
        F.transform(
            "items",
            lambda i, at: F.when(
                i["seed"].isNotNull(), F.struct(i["line_id"].alias("line_id"), chain(i, at).alias("full"))
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return pages.select(*keys, F.explode(found).alias("s")).select(*keys, "s.line_id", "s.full")


def mine_claim_regions(
    lines: DataFrame, blocks: DataFrame, page_width: float, page_height: float, documents: DataFrame | None = None, **rules
) -> tuple[DataFrame, DataFrame]:
    """Noise bands, isolated and covered lines removed, reading order, claim span, crops.

    Returns (document statuses, crop regions): one status for each of ``documents`` (default:
    those with a line), ``no_claim`` for one without a line left. The cleaned lines and the claim pages are
    read more than once, so each is stored as a stage table.
    """
    kept = lines.filter(~G.in_noise_band(G.box(), F.lit(float(page_width))))
    near = drop_isolated_small(nearest_same_column(kept))
    free = materialise(drop_covered(near, blocks, page_width), "free-lines")
    # A page whose text lines are all gone is skipped.
    with_text = free.select(*PAGE).distinct()
    items = merge_items(free, blocks).join(with_text, list(PAGE), "left_semi")
    pages = materialise(
        claim_pages(reading_order(items, page_width), page_width, **rules), "claim-pages"
    )
    settled = claim_documents(pages)
    offered = (lines if documents is None else documents).select("doc_id").distinct()
    statuses = offered.join(settled, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("no_claim")))
    return statuses, crop_regions(claim_span_rows(pages, settled), page_width, page_height)
