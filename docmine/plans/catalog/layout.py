"""Layout queries over boxes derived from document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import geometry as G
from docmine.functions import text as T
from docmine.operators import layout as L
from docmine.operators import ordering as O
from docmine.operators import pages as P
from docmine.plans import derive as D
from docmine.plans.registry import query

W, H = D.PAGE_WIDTH, D.PAGE_HEIGHT

KEPT_SQL = f"""
kept AS (SELECT * FROM layout_lines WHERE NOT (y0 > 275 AND y1 < 360)
  AND NOT ((x0 + x1) / 2 > {W} * 0.45 AND (x0 + x1) / 2 < {W} * 0.50))"""
NEAR_SQL = (
    KEPT_SQL
    + """,
near AS (
  SELECT a.doc_id, a.page_index, a.line_id, a.text, a.x0, a.y0, a.x1, a.y1,
    coalesce(min(abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2)), 1000.0) AS min_y_distance
  FROM kept a LEFT JOIN kept b ON a.doc_id = b.doc_id AND a.page_index = b.page_index
    AND NOT (a.x0 = b.x0 AND a.y0 = b.y0 AND a.x1 = b.x1 AND a.y1 = b.y1)
    AND (a.x1 - a.x0 <= 0 OR greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) >= (a.x1 - a.x0) * 0.3)
  GROUP BY ALL)"""
)
FREE_SQL = (
    NEAR_SQL
    + f""",
cover AS (SELECT doc_id, page_index, CASE WHEN x1 - x0 > {W} / 2 THEN 0 ELSE x0 END AS x0, y0,
  CASE WHEN x1 - x0 > {W} / 2 THEN {W} ELSE x1 END AS x1, y1 FROM layout_blocks WHERE label NOT IN ('text', 'formula')),
big AS (SELECT * FROM near WHERE NOT ((x1 - x0) * (y1 - y0) < 2000 AND min_y_distance > 80)),
free AS (SELECT * FROM big n WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.doc_id = n.doc_id AND c.page_index = n.page_index
  AND greatest(0, least(n.x1, c.x1) - greatest(n.x0, c.x0)) * greatest(0, least(n.y1, c.y1) - greatest(n.y0, c.y0))
    / ((n.x1 - n.x0) * (n.y1 - n.y0)) > 0.5))"""
)
ORDER_SQL = (
    FREE_SQL
    + f""",
items AS (
  SELECT b.doc_id, b.page_index, 'image' AS type, content, b.x0, b.y0, b.x1, b.y1, block_id AS item_id FROM layout_blocks b
    WHERE label = 'image' AND EXISTS (SELECT 1 FROM free f WHERE f.doc_id = b.doc_id AND f.page_index = b.page_index)
  UNION ALL SELECT doc_id, page_index, 'text', text, x0, y0, x1, y1, line_id FROM free),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY (x0 + x1) / 2 >= {W} / 2,
  floor((y0 + y1) / 2 / 15), (x0 + x1) / 2, type, item_id)::INTEGER AS pos FROM items)"""
)
CLAIM_SQL = (
    ORDER_SQL
    + f""",
padded AS (SELECT doc_id, page_index, pos, type, content, x0 - 10 AS x0, y0, x1, y1 + 5 AS y1,
  contains(content, 'What is claimed is') AS phrase FROM ordered),
c1 AS (SELECT doc_id, page_index, min(pos) FILTER (phrase) AS claim FROM padded GROUP BY 1, 2),
c2 AS (SELECT p.doc_id, p.page_index, any_value(claim) AS claim, min(pos) FILTER (type = 'image' AND pos > claim) AS image
  FROM padded p JOIN c1 USING (doc_id, page_index) GROUP BY 1, 2),
c3 AS (SELECT p.doc_id, p.page_index, any_value(claim) AS claim, any_value(image) AS image,
  min(pos) FILTER (type = 'text' AND pos > image AND regexp_matches(trim(content), '^\\d+\\.\\s')) AS stop,
  coalesce(string_agg(content, '' ORDER BY pos) FILTER (pos < image), '') AS before,
  max(content) FILTER (pos = image) AS shown
  FROM padded p JOIN c2 USING (doc_id, page_index) GROUP BY 1, 2),
stops AS (SELECT c.*, s.x0 AS sx0, s.x1 AS sx1, s.y0 AS sy0, s.y1 AS sy1 FROM c3 c
  LEFT JOIN padded s ON s.doc_id = c.doc_id AND s.page_index = c.page_index AND s.pos = c.stop),
tails AS (SELECT p.*, s.claim, s.image, s.stop FROM padded p JOIN stops s USING (doc_id, page_index)
  WHERE pos >= image AND pos < stop AND NOT (((x0 + x1) / 2 < {W} / 2) = ((sx0 + sx1) / 2 < {W} / 2)
    AND abs((y0 + y1) / 2 - (sy0 + sy1) / 2) < 15)),
page_status AS (SELECT s.doc_id, s.page_index, claim, image, stop,
  CASE WHEN claim IS NULL THEN NULL WHEN image IS NULL THEN 'no_image'
    WHEN contains(lower(before), 'polypeptide') OR contains(lower(before), 'amino acid sequence') THEN 'topic_excluded'
    WHEN NOT contains(shown, 'R') THEN 'no_marker' WHEN stop IS NULL THEN 'cross_page'
    WHEN NOT EXISTS (SELECT 1 FROM tails t WHERE t.doc_id = s.doc_id AND t.page_index = s.page_index AND t.type = 'text') THEN 'no_text'
    ELSE 'saved' END AS status FROM stops s),
doc_first AS (SELECT doc_id, min(page_index) FILTER (status IN ('saved', 'no_image', 'topic_excluded', 'no_marker')) AS p,
  coalesce(bool_or(status = 'cross_page'), false) AS cross_page, coalesce(bool_or(status = 'no_text'), false) AS bare FROM page_status GROUP BY 1),
doc_status AS (SELECT d.doc_id, CASE WHEN p IS NOT NULL THEN s.status WHEN cross_page THEN 'cross_page' WHEN bare THEN 'no_text' ELSE 'no_claim' END AS status,
  p AS page_index FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN doc_first f ON f.doc_id = d.doc_id LEFT JOIN page_status s ON s.doc_id = d.doc_id AND s.page_index = f.p),
span AS (
  SELECT p.doc_id, p.page_index, p.pos, p.x0, p.y0, p.x1, p.y1 FROM padded p JOIN doc_status d ON p.doc_id = d.doc_id AND p.page_index = d.page_index AND d.status = 'saved'
    JOIN stops s ON s.doc_id = p.doc_id AND s.page_index = p.page_index WHERE p.pos BETWEEN s.claim AND s.image
  UNION SELECT t.doc_id, t.page_index, t.pos, t.x0, t.y0, t.x1, t.y1 FROM tails t JOIN doc_status d ON t.doc_id = d.doc_id AND t.page_index = d.page_index AND d.status = 'saved')"""
)
CROP_SQL = (
    CLAIM_SQL
    + f""",
sided AS (SELECT *, CASE WHEN (x0 + x1) / 2 < {W} / 2 THEN 'left' ELSE 'right' END AS side FROM span),
breaks AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY doc_id, page_index, side ORDER BY pos) > 95 THEN 1 ELSE 0 END AS b FROM sided),
islands AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, page_index, side ORDER BY pos)::INTEGER AS island FROM breaks),
boxes AS (SELECT doc_id, page_index, side, island,
  round_even(CASE WHEN side = 'left' THEN {W} / 8 ELSE least({W} / 2, min(x0)) END, 0)::INTEGER AS x0,
  round_even(greatest(0, min(y0)), 0)::INTEGER AS y0,
  round_even(CASE WHEN side = 'left' THEN greatest({W} / 2, max(x1)) ELSE {W} * 7 / 8 END, 0)::INTEGER AS x1,
  round_even(least({H}, max(y1)), 0)::INTEGER AS y1 FROM islands GROUP BY 1, 2, 3, 4)
SELECT *, coalesce(sum(y1 - y0) OVER (PARTITION BY doc_id, page_index ORDER BY side, island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS offset_y,
  max(x1 - x0) OVER (PARTITION BY doc_id, page_index) AS canvas_w, (sum(y1 - y0) OVER (PARTITION BY doc_id, page_index))::INTEGER AS canvas_h FROM boxes"""
)


def tables(t):
    return D.layout_lines(t.documents), D.layout_blocks(t.documents)


def kept_lines(t):
    return tables(t)[0].filter(~G.in_noise_band(G.box(), F.lit(float(W))))


@query(
    "lines_in_text_area",
    f"WITH {D.LAYOUT_SQL}, {KEPT_SQL} SELECT doc_id, page_index, count(*) AS n FROM kept GROUP BY 1, 2",
)
def lines_in_text_area(t):
    """Lines left after the page-number band and the line-number gutter."""
    return kept_lines(t).groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_column_distance",
    f"WITH {D.LAYOUT_SQL}, {NEAR_SQL} SELECT doc_id, page_index, line_id, min_y_distance FROM near",
)
def nearest_column_distance(t):
    return L.nearest_same_column(kept_lines(t)).select("doc_id", "page_index", "line_id", "min_y_distance")


@query(
    "large_or_close_lines",
    f"WITH {D.LAYOUT_SQL}, {NEAR_SQL} SELECT doc_id, page_index, line_id FROM near WHERE NOT ((x1 - x0) * (y1 - y0) < 2000 AND min_y_distance > 80)",
)
def large_or_close_lines(t):
    return L.drop_isolated_small(L.nearest_same_column(kept_lines(t))).select("doc_id", "page_index", "line_id")


@query(
    "uncovered_lines",
    f"WITH {D.LAYOUT_SQL}, {FREE_SQL} SELECT doc_id, page_index, line_id FROM layout_lines n WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.doc_id = n.doc_id AND c.page_index = n.page_index "
    "AND greatest(0, least(n.x1, c.x1) - greatest(n.x0, c.x0)) * greatest(0, least(n.y1, c.y1) - greatest(n.y0, c.y0)) / ((n.x1 - n.x0) * (n.y1 - n.y0)) > 0.5)",
)
def uncovered_lines(t):
    lines, blocks = tables(t)
    return L.drop_covered(lines, blocks, W).select("doc_id", "page_index", "line_id")


@query(
    "block_first_line",
    f"""WITH {D.LAYOUT_SQL} SELECT b.doc_id, b.page_index, b.block_id, arg_min(l.text, l.line_id) AS text
    FROM layout_blocks b LEFT JOIN layout_lines l ON b.doc_id = l.doc_id AND b.page_index = l.page_index
      AND l.x0 BETWEEN b.x0 AND b.x1 AND l.y0 BETWEEN b.y0 AND b.y1 GROUP BY 1, 2, 3""",
)
def block_first_line(t):
    """First line whose corner lies in each block."""
    lines, blocks = tables(t)
    return L.assign_points_to_boxes(lines, blocks, "text", "line_id").select(
        "doc_id", "page_index", "block_id", "text"
    )


@query(
    "page_reading_order",
    f"WITH {D.LAYOUT_SQL}, {ORDER_SQL} SELECT doc_id, page_index, type, item_id, pos FROM ordered",
)
def page_reading_order(t):
    lines, blocks = tables(t)
    near = L.drop_isolated_small(L.nearest_same_column(kept_lines(t)))
    free = L.drop_covered(near, blocks, W)
    pages = free.select("doc_id", "page_index").distinct()
    items = L.merge_items(free, blocks).join(pages, ["doc_id", "page_index"], "left_semi")
    return L.reading_order(items, W).select("doc_id", "page_index", "type", "item_id", "pos")


@query(
    "claim_document_status",
    f"WITH {D.LAYOUT_SQL}, {CLAIM_SQL} SELECT doc_id, status, page_index FROM doc_status",
)
def claim_document_status(t):
    return L.mine_claim_regions(*tables(t), W, H, t.documents)[0]


@query(
    "claim_funnel",
    f"WITH {D.LAYOUT_SQL}, {CLAIM_SQL} SELECT status, count(*) AS n FROM doc_status GROUP BY 1",
)
def claim_funnel(t):
    return P.funnel(L.mine_claim_regions(*tables(t), W, H, t.documents)[0])


@query("claim_crop_regions", f"WITH {D.LAYOUT_SQL}, {CROP_SQL}")
def claim_crop_regions(t):
    return L.mine_claim_regions(*tables(t), W, H)[1]


@query(
    "column_islands",
    f"""WITH {D.LAYOUT_SQL},
    sided AS (SELECT *, CASE WHEN (x0 + x1) / 2 < {W} / 2 THEN 'left' ELSE 'right' END AS side FROM layout_lines),
    breaks AS (SELECT *, CASE WHEN y0 - lag(y1) OVER (PARTITION BY doc_id, page_index, side ORDER BY y0, line_id) > 95 THEN 1 ELSE 0 END AS b FROM sided)
    SELECT doc_id, page_index, side, line_id, sum(b) OVER (PARTITION BY doc_id, page_index, side ORDER BY y0, line_id)::INTEGER AS island FROM breaks""",
)
def column_islands(t):
    """Vertical gaps split a column into islands; 500-pixel bands are the buckets."""
    sided = tables(t)[0].withColumn("side", L.column_side(W))
    out = O.split_islands(
        sided, ["doc_id", "page_index", "side"], F.floor(F.col("y0") / 500), ["y0", "line_id"],
        F.col("y0"), F.col("y1"), 95,
    )
    return out.select("doc_id", "page_index", "side", "line_id", "island")


@query(
    "padded_boxes",
    f"WITH {D.LAYOUT_SQL} SELECT doc_id, page_index, block_id, (x0 - 5)::INTEGER AS x0, (y0 - 5)::INTEGER AS y0, (x1 + 5)::INTEGER AS x1, (y1 + 5)::INTEGER AS y1 FROM layout_blocks",
)
def padded_boxes(t):
    pad = G.pad(G.box(), 5, 5, 5, 5)
    named = [p.alias(n) for p, n in zip(pad, L.BOX)]
    return tables(t)[1].select("doc_id", "page_index", "block_id", *named)


@query(
    "box_measures",
    f"""WITH {D.LAYOUT_SQL} SELECT doc_id, page_index, block_id, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy,
    round((x1 - x0) / (y1 - y0), 6) AS aspect, x1 >= 1000 AND x0 <= 2000 AND y1 >= 500 AND y0 <= 900 AS touches FROM layout_blocks""",
)
def box_measures(t):
    b = G.box()
    window = tuple(F.lit(float(v)) for v in (1000, 500, 2000, 900))
    return tables(t)[1].select(
        "doc_id", "page_index", "block_id",
        G.area(b).alias("area"), G.centre_x(b).alias("cx"), G.centre_y(b).alias("cy"),
        F.round(G.aspect(b[2] - b[0], b[3] - b[1]), 6).alias("aspect"),
        G.overlaps(b, window).alias("touches"),
    )


@query(
    "numbered_items",
    f"WITH {D.LAYOUT_SQL} SELECT doc_id, count(*) FILTER (regexp_matches(trim(text), '^\\d+\\.\\s')) AS numbered, count(*) AS n FROM layout_lines GROUP BY 1",
)
def numbered_items(t):
    return tables(t)[0].groupBy("doc_id").agg(
        F.count_if(T.starts_numbered_item(F.col("text"))).alias("numbered"), F.count(F.lit(1)).alias("n")
    )


@query(
    "merged_items",
    f"WITH {D.LAYOUT_SQL} SELECT type, count(*) AS n FROM (SELECT 'image' AS type FROM layout_blocks WHERE label = 'image' UNION ALL SELECT 'text' FROM layout_lines) GROUP BY 1",
)
def merged_items(t):
    return L.merge_items(*tables(t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("chained_lines")
def chained_lines(t):
    """Lines continued below each claim line; the fold depends on the data, so it is
    checked against a plain loop in the tests instead of SQL."""
    lines = tables(t)[0]
    seed = F.when(F.col("text").startswith("What is claimed is: "), F.regexp_replace("text", "^What is claimed is: ", ""))
    return L.chain_lines(lines, seed, v_gap=120, h_tol=200)
