"""Comparing two versions of a corpus of structure strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.functions.text import is_valid_label


def audit_pair(raw: DataFrame, norm: DataFrame, key: str, column: str = "smiles") -> DataFrame:
    """Rows of both versions side by side by id, with a changed flag. ``side`` tells rows
    that exist in one version only; those are count mismatches."""
    a = raw.select(key, F.col(column).alias("raw"), F.lit(True).alias("_in_raw"))
    b = norm.select(key, F.col(column).alias("norm"), F.lit(True).alias("_in_norm"))
    side = (
        F.when(F.col("_in_norm").isNull(), "raw_only").when(F.col("_in_raw").isNull(), "norm_only").otherwise("both")
    )
    return (
        a.join(b, key, "full")
        .withColumn("side", side)
        .withColumn("changed", (F.col("side") == "both") & ~F.col("raw").eqNullSafe(F.col("norm")))
        .drop("_in_raw", "_in_norm")
    )


def new_labels(raw: Column, norm: Column) -> Column:
    """Distinct bracket contents the change brought in."""
    return F.array_except(S.bracket_contents(norm), S.bracket_contents(raw))


def check_flags(raw: Column, norm: Column) -> dict[str, Column]:
    bad = F.filter(new_labels(raw, norm), lambda label: ~is_valid_label(label))
    return {
        "residual_star": S.bare_stars(norm) > 0,
        "broken_brackets": ~S.brackets_balanced(norm) & S.brackets_balanced(raw),
        "fragments_changed": S.dot_count(raw) != S.dot_count(norm),
        "invalid_labels": F.size(bad),
    }


def audit_counts(pairs: DataFrame) -> DataFrame:
    """Totals over the changed rows; all but ``changed`` should be zero."""
    flagged = pairs.withColumns(check_flags(F.col("raw"), F.col("norm")))
    hit = lambda c: F.count_if(F.col("changed") & F.col(c))
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("side") != "both").alias("count_mismatch"),
        F.count_if("changed").alias("changed"),
        hit("residual_star").alias("residual_star"),
        hit("broken_brackets").alias("broken_brackets"),
        hit("fragments_changed").alias("fragments_changed"),
        F.coalesce(F.sum(F.when(F.col("changed"), F.col("invalid_labels"))), F.lit(0)).alias("invalid_labels"),
    )


def label_distribution(df: DataFrame, labels: Column, top: int = 30) -> DataFrame:
    """Most frequent labels with the totals over all labels."""
    counts = df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "label").limit(top)
    return best.select(
        "*",
        counts.agg(F.sum("n")).scalar().alias("total"),
        counts.agg(F.count(F.lit(1))).scalar().alias("unique_labels"),
    )


def replaced_labels(raw: Column, norm: Column) -> Column:
    """Labels standing in ``norm`` where ``raw`` (numbered stars already renamed) has a bare
    star; null when the token counts differ."""
    first = S.tokenise(S.numbered_labels(raw))
    second = S.tokenise(norm)
    pairs = F.arrays_zip(first.alias("a"), second.alias("b"))
    hits = F.filter(pairs, lambda p: (p["a"] == "*") & p["b"].rlike(r"^\[.*\]$"))
    labels = F.transform(hits, lambda p: F.regexp_replace(p["b"], r"^\[|\]$", ""))
    return F.when(F.size(first) == F.size(second), labels)


def fallback_audit(df: DataFrame, raw: str, norm: str, labels: str) -> DataFrame:
    """Each row's outcome when the labels are derived a second time and compared.

    no_marker: nothing to label; fallback_ok / fallback_broken: no usable labels and all
    stars are (not) ``R``; match, order_only, mismatch, token_mismatch otherwise.
    """
    count = S.bare_stars(S.numbered_labels(F.col(raw)))
    actual = replaced_labels(F.col(raw), F.col(norm))
    expected = F.col(labels)
    usable = expected.isNotNull() & (F.size(expected) == count)
    all_r = (S.bare_stars(F.col(norm)) == 0) & F.forall(
        F.coalesce(actual, F.array(F.lit("?"))), lambda x: x == "R"
    )
    outcome = (
        F.when(count == 0, "no_marker")
        .when(~usable & all_r, "fallback_ok")
        .when(~usable, "fallback_broken")
        .when(actual.isNull(), "token_mismatch")
        .when(actual == expected, "match")
        .when(F.sort_array(actual) == F.sort_array(expected), "order_only")
        .otherwise("mismatch")
    )
    return df.withColumn("outcome", outcome)


def id_subset_check(structures: DataFrame, atoms: DataFrame, key: str = "mol_id", column: str = "smiles") -> DataFrame:
    """Numbers of ``[n*]`` labels that no wildcard atom of the molecule carries."""
    texts = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\[(\d+)\*\]"), F.lit(1)))
    wanted = structures.select(key, F.explode(texts).alias("text")).select(
        key, F.col("text").cast("int").alias("isotope"), F.lit(1).alias("_wanted"), F.lit(0).alias("_had")
    )
    had = atoms.filter("symbol = '*' and isotope > 0").select(key, "isotope", F.lit(0).alias("_wanted"), F.lit(1).alias("_had"))
    # Both sides meet in one aggregation, so that each table is read once and none is joined.
    met = wanted.unionByName(had).groupBy(key, "isotope").agg(F.max("_wanted").alias("_wanted"), F.max("_had").alias("_had"))
    return (
        met.filter("_wanted = 1")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("numbers"), F.count_if(F.col("_had") == 0).alias("missing"))
        .withColumn("ok", F.col("missing") == 0)
    )
