"""Sinks and stage tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder of CSV per key; keys without rows write nothing. A hot key is spread over
    many tasks and files."""
    df.write.mode("overwrite").partitionBy(key).option("header", True).csv(path)


def write_key_list(df: DataFrame, key: str, path: str) -> None:
    """Distinct keys, sorted, one per line."""
    df.select(F.col(key).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def append_rejects(df: DataFrame, key: str, path: str, batch: str | int) -> None:
    """Keys that failed a stage. A batch owns its folder, so a rerun replaces its rows."""
    df.select(F.col(key).cast("string").alias("value")).distinct().write.mode("overwrite").text(f"{path}/batch={batch}")


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as one JSON record per row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_structure_lines(df: DataFrame, path: str, smiles: str = "smiles", name: str | None = None) -> None:
    line = F.col(smiles) if name is None else F.concat_ws(" ", smiles, name)
    df.select(line.alias("value")).write.mode("append").text(path)


def write_sdf(df: DataFrame, path: str, block: str = "molblock", properties: str = "properties") -> None:
    """Records of block, properties and the end mark."""
    lines = F.transform(
        F.map_entries(properties), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n"))
    )
    text = F.concat_ws("\n", F.col(block), F.array_join(lines, "\n"), F.lit("$$$$"))
    df.select(text.alias("value")).write.mode("append").text(path)


def reuse_or_build(
    spark: SparkSession, path: str, params: dict, n_items: int, build: Callable[[], DataFrame]
) -> DataFrame:
    """A stored stage when its parameters and input count agree, else a fresh one.

    Every set of parameters has a folder of its own, and a marker is written behind the data:
    data without a marker are those of a broken write and are built anew."""
    wanted = json.dumps({"params": params, "n_items": n_items}, sort_keys=True)
    own = f"{path}/{hashlib.md5(wanted.encode()).hexdigest()}"
    try:
        stored = spark.read.text(f"{own}/params").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    if stored is None or stored[0] != wanted:
        build().write.mode("overwrite").parquet(f"{own}/data")
        spark.range(1).select(F.lit(wanted).alias("value")).write.mode("overwrite").text(f"{own}/params")
    return spark.read.parquet(f"{own}/data")
