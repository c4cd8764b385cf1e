"""Ranks, quotas and ordered scans that keep working when one key holds most rows.

Each operator cuts a group into buckets that follow the order (a hash prefix, a time
slot, a page row), ranks or folds inside a bucket, and stitches the buckets with the
small table of bucket totals. No task ever sees a whole group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions.text import hash_order


def bucket_offsets(df: DataFrame, keys: Sequence[str], buckets: Sequence[str]) -> DataFrame:
    """Rows per (key, bucket), rows of the key before the bucket, rows of the key."""
    sizes = df.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = group.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(before), F.lit(0))
    ).withColumn("_total", F.sum("_size").over(group))


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]):
    """Join condition that also matches nulls."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[c])
    return cond


def _with_offsets(df, keys, buckets, extra=None):
    on = [*keys, *buckets]
    offsets = bucket_offsets(df, keys, buckets)
    if extra is not None:
        offsets = extra(offsets)
    # Renamed so that null keys can be matched as well.
    renamed = offsets.select(
        *[F.col(c).alias(f"_o_{c}") for c in on],
        *[c for c in offsets.columns if c not in on],
    )
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return df.join(renamed, cond).drop(*[f"_o_{c}" for c in on])


def rank_in_order(
    df: DataFrame,
    keys: Sequence[str],
    buckets: dict[str, Column],
    order: Sequence[Column],
    rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Exact ``row_number`` per key over (buckets, order); ``buckets`` must be a coarse
    prefix of the wanted order."""
    named = {f"_b{i}_{n}": c for i, (n, c) in enumerate(buckets.items())}
    staged = df.withColumns(named)
    joined = _with_offsets(staged, keys, list(named))
    inner = Window.partitionBy(*keys, *named).orderBy(*order)
    out = joined.withColumn(rank, F.col("_before") + F.row_number().over(inner))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_size", "_before", "_total", *named)


def take_in_order(
    df: DataFrame,
    keys: Sequence[str],
    quota: Column | int,
    buckets: dict[str, Column],
    order: Sequence[Column],
    rank: str | None = None,
) -> DataFrame:
    """First ``quota`` rows per key. Buckets behind the quota are dropped before any
    sort, so only rows near the cut are ranked."""
    limit = F.lit(quota) if isinstance(quota, int) else quota
    named = {f"_b{i}_{n}": c for i, (n, c) in enumerate(buckets.items())}
    staged = df.withColumns(named)
    joined = _with_offsets(staged, keys, list(named)).filter(F.col("_before") < limit)
    inner = Window.partitionBy(*keys, *named).orderBy(*order)
    name = rank or "_rank"
    out = joined.withColumn(name, F.col("_before") + F.row_number().over(inner)).filter(
        F.col(name) <= limit
    )
    drop = ["_size", "_before", "_total", *named] + ([] if rank else [name])
    return out.drop(*drop)


def _hash_bucket(column: str, digits: int) -> dict[str, Column]:
    return {"h": F.substring(F.col(column), 1, digits)}


def rank_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    seed: int | str,
    rank: str = "rank",
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Seeded random rank per key; 16**digits hash buckets share a group."""
    staged = df.withColumn("_hash", hash_order(seed, *[F.col(c) for c in ids]))
    order = [F.col("_hash"), *[F.col(c) for c in ids]]
    return rank_in_order(staged, keys, _hash_bucket("_hash", digits), order, rank, total).drop("_hash")


def take_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    quota: Column | int,
    ids: Sequence[str],
    seed: int | str,
    digits: int = 3,
) -> DataFrame:
    """Seeded sample without replacement: ``quota`` rows per key (all rows: no keys)."""
    staged = df.withColumn("_hash", hash_order(seed, *[F.col(c) for c in ids]))
    order = [F.col("_hash"), *[F.col(c) for c in ids]]
    return take_in_order(staged, keys, quota, _hash_bucket("_hash", digits), order).drop("_hash")


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Attach group aggregates through a join instead of a window: a hot group collapses
    in the map-side aggregation and its rows are split by the skew join."""
    sums = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    renamed = sums.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *stats)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return df.join(renamed, cond).drop(*[f"_g_{k}" for k in keys])


def split_islands(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    start: Column,
    end: Column,
    gap: float,
    island: str = "island",
) -> DataFrame:
    """Gaps and islands: a new island where ``start - previous end > gap`` in order.

    ``bucket`` follows the order (time slot, page band). Breaks are counted inside a
    bucket, the one between buckets comes from the bucket table.
    """
    staged = df.withColumns({"_bucket": bucket, "_start": start, "_end": end})
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    marked = staged.withColumn("_prev", F.lag("_end").over(inner)).withColumn(
        "_break", F.when(F.col("_start") - F.col("_prev") > gap, 1).otherwise(0)
    )
    place = F.struct(*order)
    spans = marked.groupBy(*keys, "_bucket").agg(
        F.sum("_break").alias("_breaks"),
        F.min_by("_start", place).alias("_first"),
        F.max_by("_end", place).alias("_last"),
    )
    across = Window.partitionBy(*keys).orderBy("_bucket")
    opened = spans.withColumn(
        "_open",
        F.when(F.col("_first") - F.lag("_last").over(across) > gap, 1).otherwise(0),
    )
    shifted = opened.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        F.col("_bucket").alias("_g_bucket"),
        (
            F.sum(F.col("_breaks") + F.col("_open")).over(
                across.rowsBetween(Window.unboundedPreceding, 0)
            )
            - F.col("_breaks")
        ).alias("_shift"),
    )
    cond = F.col("_bucket") == F.col("_g_bucket")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    running = inner.rowsBetween(Window.unboundedPreceding, 0)
    return (
        marked.withColumn("_run", F.sum("_break").over(running))
        .join(shifted, cond)
        .withColumn(island, (F.col("_shift") + F.col("_run")).cast("int"))
        .drop("_bucket", "_start", "_end", "_prev", "_break", "_run", "_shift", "_g_bucket",
              *[f"_g_{k}" for k in keys])
    )


def ema_baseline(
    df: DataFrame,
    keys: Sequence[str],
    buckets: dict[str, Column],
    order: Sequence[str],
    value: str,
    alpha: float = 0.1,
    out: str = "baseline",
    block: int = 256,
    start: DataFrame | None = None,
) -> DataFrame:
    """Running baseline ``b = (1-a) b + a x``, started by the first value, after each row.

    The recurrence is affine, so it is folded per block of ``block`` rows and carried
    over; a block decays the older past by (1-a)**block, which leaves the double range
    after a fixed number of blocks, so the carry reads only that many. With ``start``, a
    table (keys, start, seen), a key goes on from the baseline ``start`` after ``seen`` rows.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    keep = 1.0 - alpha
    ranked = rank_in_order(df, keys, buckets, [F.col(c) for c in order], "_rank")
    if start is None:
        ranked = ranked.withColumns({"_start": F.lit(None).cast("double"), "_seen": F.lit(0).cast("bigint")})
    else:
        renamed = start.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("start").alias("_start"), F.col("seen").alias("_seen"))
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        ranked = ranked.join(renamed, cond, "left").drop(*[f"_g_{k}" for k in keys]).withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    step = (F.col("_seen") + F.col("_rank")).alias("step")
    own = [F.col(c) for c in df.columns]
    if keep == 0:
        return ranked.select(*own, step, F.col(value).cast("double").alias(out))
    # Inside a block values are scaled by up to keep**-block, which must stay a double.
    block = max(1, min(block, int(500 / -math.log(keep))))
    staged = ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / block)).withColumn(
        "_pos", ((F.col("_rank") - 1) % block + 1).cast("double")
    )
    # The first row of all weighs 1, every later one alpha.
    first = (F.col("_rank") == 1) & F.col("_start").isNull()
    weighted = staged.withColumn("_w", F.when(first, F.col(value)).otherwise(F.col(value) * alpha))
    inner = (
        Window.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    local = weighted.withColumn(
        "_local",
        F.sum(F.col("_w") * F.pow(F.lit(keep), -F.col("_pos"))).over(inner)
        * F.pow(F.lit(keep), F.col("_pos")),
    )
    ends = local.groupBy(*keys, "_block").agg(F.max_by("_local", "_rank").alias("_tail"))
    decay = keep**block
    reach = int(math.ceil(745.0 / (-math.log(keep) * block))) + 1
    past = Window.partitionBy(*keys).orderBy("_block").rowsBetween(-reach, -1)
    carry = ends.select(
        *[F.col(k).alias(f"_g_{k}") for k in keys],
        F.col("_block").alias("_g_block"),
        F.aggregate(
            F.collect_list("_tail").over(past), F.lit(0.0), lambda acc, b: acc * decay + b
        ).alias("_carry"),
    )
    cond = F.col("_block") == F.col("_g_block")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return (
        local.join(carry, cond)
        .withColumn("_before", F.coalesce("_start", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_rank").cast("double")))
        .select(*own, step, (F.col("_local") + F.col("_carry") * F.pow(F.lit(keep), F.col("_pos")) + F.col("_before")).alias(out))
    )
