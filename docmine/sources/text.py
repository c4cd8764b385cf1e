"""Text sources: fixed width, delimited, one structure per line, record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmine.operators.pages import cut_fixed_width


def read_fixed_width(
    spark: SparkSession, path: str, fields: Sequence[tuple[str, int, int]], min_len: int
) -> DataFrame:
    """Columns by character place; undecodable bytes are left out, short lines dropped."""
    raw = spark.read.text(path)
    clean = raw.select(F.replace(F.col("value"), F.lit("�"), F.lit("")).alias("value"))
    return cut_fixed_width(clean, fields, min_len)


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", header: bool = True
) -> DataFrame:
    """Delimited text with a declared schema; blanks behind the separator are ignored."""
    return spark.read.csv(
        path, schema=schema, sep=sep, header=header, ignoreLeadingWhiteSpace=True, quote='"', escape='"'
    )


def read_structure_lines(spark: SparkSession, path: str) -> DataFrame:
    """One structure per line, an optional name behind white space."""
    parts = F.split(F.trim(F.col("value")), r"\s+", 2)
    return spark.read.text(path).filter(F.trim("value") != "").select(
        parts[0].alias("smiles"), F.get(parts, 1).alias("name")
    )


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Records ended by ``$$$$``: the molecule block and a map of the properties."""
    prop = r"(?m)^>[^\n]*<([^>\n]+)>[^\n]*\n([^\n]*)"
    record = F.rtrim(F.col("value"))
    names = F.regexp_extract_all("value", F.lit(prop), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(prop), F.lit(2))
    return (
        spark.read.text(path, lineSep="$$$$\n")
        .filter(record != "")
        .select(
            F.regexp_extract("value", r"(?s)^(.*?M  END)", 1).alias("molblock"),
            F.map_from_arrays(names, values).alias("properties"),
        )
    )


def with_row_ids(df: DataFrame, order: Sequence[str], bucket, name: str = "row_id") -> DataFrame:
    """Stable sequential ids over a stated order; ``bucket`` is a coarse prefix of it."""
    from docmine.operators.ordering import rank_in_order

    ranked = rank_in_order(df, [], {"b": bucket}, [F.col(c) for c in order], "_rank")
    return ranked.withColumn(name, F.col("_rank") - 1).drop("_rank")
