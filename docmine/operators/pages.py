"""Document and page selection: allow-lists, text rules, hit pages, outcome funnels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmine.functions import geometry as G
from docmine.functions import text as T
from docmine.functions.binding import let


def cut_fixed_width(
    lines: DataFrame, fields: Sequence[tuple[str, int, int]], min_len: int, column: str = "value"
) -> DataFrame:
    """Columns from fixed character places (1-based start, length); short lines are dropped."""
    return lines.filter(F.length(column) >= min_len).select(
        *[F.substring(column, start, length).alias(name) for name, start, length in fields]
    )


def filter_subclass(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    if isinstance(codes, str):
        raise TypeError("codes is a list of whole codes, not a string")
    return df.filter(F.col(column).isin(list(codes)))


def keep_allowed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed. The listed keys are reduced to one row each first; Spark
    broadcasts them only when they prove small."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exclude_already(df: DataFrame, taken: DataFrame, key: str | Sequence[str]) -> DataFrame:
    names = [key] if isinstance(key, str) else list(key)
    return df.join(taken.select(*names).distinct(), names, "left_anti")


def mark_membership(df: DataFrame, other: DataFrame, key: str, flag: str = "member") -> DataFrame:
    """Flag every row by whether its key occurs in the other table."""
    marks = other.select(key).distinct().withColumn("_in", F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.col("_in").isNotNull()).drop("_in")


def hit_pages(pages: DataFrame, rule: Column, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Matching page numbers in long form; documents without a hit are absent."""
    return pages.filter(rule).select(doc, page).distinct()


def hit_page_list(pages: DataFrame, rule: Column, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Matching page numbers of one document as a sorted list; the list holds page numbers
    only and is as long as the document has pages."""
    return (
        pages.filter(rule)
        .groupBy(doc)
        .agg(F.sort_array(F.collect_set(page)).alias("pages"))
    )


def first_hit_page(pages: DataFrame, rule: Column, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    return pages.filter(rule).groupBy(doc).agg(F.min(page).alias("first_hit"))


def pages_from_first_hit(pages: DataFrame, rule: Column, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """All pages from the first matching one to the end, still one row per page."""
    first = first_hit_page(pages, rule, doc, page)
    return pages.join(first, doc).filter(F.col(page) >= F.col("first_hit"))


def tail_from_first_hit(page_texts: Column, hit: Callable[[Column], Column]) -> Column:
    """The same on an array of page texts held in one row: ``struct<first_hit, n_pages,
    text>``, null without a hit. No shuffle: a document is one row."""

    def cut(pages, first):
        tail = F.slice(pages, first.cast("int"), F.size(pages))
        return F.when(
            first > 0,
            F.struct(
                (first - 1).cast("int").alias("first_hit"),
                F.size(tail).alias("n_pages"),
                F.array_join(tail, "\n").alias("text"),
            ),
        )

    def search(pages):
        return let(F.array_position(F.transform(pages, hit), True), lambda first: cut(pages, first))

    return let(page_texts, search)


def structure_pages(regions: DataFrame, doc: str = "doc_id", page: str = "page_index") -> DataFrame:
    """Pages with at least one region that looks like a drawn structure."""
    keep = G.is_structure_region(F.col("w"), F.col("h"), F.col("n_lines"), F.col("n_corners"))
    return regions.filter(keep).select(doc, page).distinct()


def mine_pages(
    pages: DataFrame,
    allow: DataFrame,
    regions: DataFrame,
    rule: Column,
    doc: str = "doc_id",
    page: str = "page_index",
) -> DataFrame:
    """Allowed pages with the two outcomes: text rule, then structure rule on its hits."""
    kept = keep_allowed(pages, allow, doc).select(doc, page, rule.alias("text_hit"))
    drawn = structure_pages(regions, doc, page).withColumn("_drawn", F.lit(True))
    return (
        kept.join(drawn, [doc, page], "left")
        .withColumn("saved", F.col("text_hit") & F.col("_drawn").isNotNull())
        .drop("_drawn")
    )


def document_status(mined: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One terminal status per document."""
    return mined.groupBy(doc).agg(
        F.bool_or("text_hit").alias("_hit"),
        F.bool_or("saved").alias("_saved"),
        F.count_if("saved").alias("n_pages"),
    ).select(
        doc,
        F.when(F.col("_saved"), "saved")
        .when(F.col("_hit"), "no_structure")
        .otherwise("no_text_hit")
        .alias("status"),
        "n_pages",
    )


def funnel(statuses: DataFrame, status: str = "status") -> DataFrame:
    return statuses.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def mine_claims(
    pages: DataFrame,
    regions: DataFrame,
    start_rule: Column,
    hint_rule: Column,
    doc: str = "doc_id",
    page: str = "page_index",
) -> DataFrame:
    """Claim section per document: pages from the first preamble on; saved when one of
    them shows a structure. The text hint is reported and does not filter."""
    base = pages.select(doc, page, start_rule.alias("_start"), hint_rule.alias("_hint"))
    first = base.filter("_start").groupBy(doc).agg(F.min(page).alias("_first"))
    drawn = structure_pages(regions, doc, page).withColumn("_drawn", F.lit(True))
    tail = base.join(first, doc, "left").join(drawn, [doc, page], "left")
    inside = F.col(page) >= F.col("_first")
    return tail.groupBy(doc).agg(
        F.max("_first").alias("first_hit"),
        F.count_if(inside).alias("n_pages"),
        F.coalesce(F.bool_or(inside & F.col("_hint")), F.lit(False)).alias("hint"),
        F.coalesce(F.bool_or(inside & F.col("_drawn").isNotNull()), F.lit(False)).alias("_found"),
    ).select(
        doc,
        "first_hit",
        "n_pages",
        "hint",
        F.when(F.col("first_hit").isNull(), "no_claims")
        .when(F.col("_found"), "saved")
        .otherwise("no_structure")
        .alias("status"),
    )


def mine_examples(
    pages: DataFrame, survivors: DataFrame, doc: str = "doc_id", page: str = "page_index", text: str = "text",
    pattern: str = T.WORKED_EXAMPLE,
) -> DataFrame:
    """Worked-example pages of the documents that survived an earlier stage."""
    kept = keep_allowed(pages, survivors, doc)
    return hit_pages(kept, T.is_worked_example(F.col(text), pattern), doc, page)


def mine_names(
    answers: DataFrame, resolver: DataFrame, doc: str = "doc_id", response: str = "response"
) -> tuple[DataFrame, DataFrame]:
    """Listed names resolved by a lookup table: (distinct compounds, failure counts)."""
    names = answers.select(doc, F.explode(T.list_items(F.col(response))).alias("name"))
    table = resolver.groupBy("name").agg(F.max("structure").alias("structure"))
    resolved = names.join(table, "name", "left")
    compounds = resolved.filter("structure is not null").select(doc, "name", "structure").distinct()
    return compounds, fail_rate(resolved, F.col("structure").isNull())


def fail_rate(df: DataFrame, failed: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count_if(failed).alias("failed"),
        F.count(F.lit(1)).alias("attempts"),
    ).withColumn(
        "fail_rate", F.coalesce(F.try_divide("failed", "attempts"), F.lit(0.0))
    )


def describe_input(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One row per column, expected or present: is it there, how many values, rows in all."""
    present = df.columns
    sums = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in present]
    )
    pairs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            F.lit(c in expected).alias("expected"),
            (F.col(c) if c in present else F.lit(0)).cast("bigint").alias("non_null"),
            F.col("_rows").alias("n_rows"),
        )
        for c in [*present, *[e for e in expected if e not in present]]
    ]
    return sums.select(F.inline(F.array(*pairs)))
