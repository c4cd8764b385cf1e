"""Contiguous shards of near equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.session import materialise


def byte_shards(docs: DataFrame, order: list[Column], size: Column, shards: int) -> DataFrame:
    """Adds ``shard``, ``slot`` (position in the shard, from 0) and ``size`` to every row.

    Rows are laid out in the given order by a range partitioning, which also cuts one hot
    key by the later order columns. Each partition's total is summed, the totals become
    running starts, and a row's place on the global byte line is its partition's start plus
    the running sum inside the partition. The line is cut into ``shards`` equal lengths; a
    row goes where its middle lies, so a shard is off by one row's size at most and is
    contiguous in the order. Only the per-partition totals meet in one task.

    Nulls in ``size`` count as 0, null order keys come first, rows equal in all order keys
    may swap, an empty table gives no rows. Columns of ``docs`` are kept; added names
    (``shard``, ``slot``, ``size``) replace columns of the same name.
    """
    spark = docs.sparkSession
    keys = [f"_k{i}" for i in range(len(order))]
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    laid = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        *[c.alias(k) for c, k in zip(order, keys, strict=True)],
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stored, since a second sampling of the ranges could cut them elsewhere.
    laid = materialise(laid.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "shards")

    totals = laid.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(everything).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        laid.withColumns({"_end": F.sum("size").over(inside), "_row": F.count(F.lit(1)).over(inside)})
        .join(starts, F.col("_part") == F.col("_p"))
        .withColumn("_twice", 2 * (F.col("_byte0") + F.col("_end")) - F.col("size"))
        .withColumn(
            "shard",
            F.when(F.col("_all") == 0, F.lit(0))
            .otherwise(F.least(F.lit(shards - 1), F.expr(f"(_twice * {shards}) div (2 * _all)")))
            .cast("int"),
        )
        .withColumn("_row", F.col("_row0") + F.col("_row") - 1)
    )
    placed = materialise(placed.drop("_byte0", "_row0", "_all", "_end", "_twice", "_p", "_part", *keys), "placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first")).withColumnRenamed("shard", "_s")
    return placed.join(first, F.col("shard") == F.col("_s")).select(
        *[F.col(f"`{c}`") for c in keep], "size", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Documents in shards of near equal bytes: a text's UTF-8 bytes plus 8 a row.

    The order is the text's digest, then doc_id: copies of a text lie side by side and share
    a shard unless a cut falls among them. A null text is laid out as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).alias("_n"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("_d"))
    out = byte_shards(rows, [F.col("_d"), F.col("doc_id")], F.col("_n") + 8, shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
