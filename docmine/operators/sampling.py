"""Seeded samples: quotas per group, stratified and cluster-balanced draws, splits.

Random choices are ordered by md5(seed | id), so they do not depend on partitioning.
Quotas are computed on the table of group sizes, never on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions.scalars import digitise
from docmine.session import materialise
from docmine.operators.ordering import rank_by_hash, take_by_hash, take_in_order

DEFAULT_BINS = {
    "num_atoms": [0, 10, 20, 30, 50, 100, float("inf")],
    "num_rings": [0, 1, 2, 3, 5, float("inf")],
}


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 42) -> DataFrame:
    """``n`` rows without replacement (all rows when there are fewer)."""
    return take_by_hash(df, [], n, ids, seed)


def take_per_group(
    df: DataFrame, keys: Sequence[str], quota: Column | int, ids: Sequence[str], seed: int | str = 42
) -> DataFrame:
    return take_by_hash(df, keys, quota, ids, seed)


def train_val_split(
    df: DataFrame, ids: Sequence[str], val_fraction: float, seed: int | str = 42
) -> DataFrame:
    """Exact-size split, both sides non-empty; fewer than two rows, also none, is an error."""
    ranked = rank_by_hash(df, [], ids, seed, "_r", "_n")
    wanted = F.greatest(F.lit(1), F.floor(F.col("_n") * (1 - val_fraction)))
    n_train = F.least(wanted, F.col("_n") - 1)
    side = F.when(F.col("_r") <= n_train, "train").otherwise("val")
    out = ranked.withColumn("split", side).drop("_r", "_n")
    # The guard adds no row; it is there to fail, which an empty table's own rows cannot.
    short = F.when(F.col("_n") < 2, F.raise_error("a split needs at least two rows").cast("boolean"))
    guard = df.agg(F.count(F.lit(1)).alias("_n")).filter(short.otherwise(F.lit(False)))
    return out.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def balanced_quotas(sizes: DataFrame, n: int, strategy: str) -> DataFrame:
    """Rows wanted from each group: equal shares or shares of the square root of the size.

    The totals are scalar subqueries over the table of sizes.
    """
    groups = sizes.agg(F.count(F.lit(1))).scalar()
    roots = sizes.agg(F.sum(F.sqrt("size"))).scalar()
    if strategy == "equal":
        share = F.floor(F.lit(n) / groups)
    elif strategy == "sqrt":
        # Guard against shares a rounding error below a whole number.
        share = F.floor(F.lit(float(n)) * F.sqrt("size") / roots + 1e-9)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return sizes.select(
        "*", F.least(F.greatest(F.lit(1), share), F.col("size")).cast("bigint").alias("quota")
    )


def _apply_quotas(df, quotas, keys, ids, seed):
    renamed = quotas.select(*[F.col(k).alias(f"_q_{k}") for k in keys], F.col("quota").alias("_quota"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_q_{k}"))
    with_quota = df.join(renamed, cond).drop(*[f"_q_{k}" for k in keys])
    return take_by_hash(with_quota, keys, F.col("_quota"), ids, seed).drop("_quota")


def sample_balanced(
    df: DataFrame, keys: Sequence[str], n: int, ids: Sequence[str], strategy: str = "equal", seed: int | str = 42
) -> DataFrame:
    """Quota per group, at least one; a random cut when the quotas exceed ``n``. Never
    topped up. Returns the ids and keys of the drawn rows."""
    slim = materialise(df.select(*ids, *keys), "balanced")
    quotas = balanced_quotas(group_sizes(slim, keys), n, strategy)
    drawn = _apply_quotas(slim, quotas, keys, ids, seed)
    return sample_n(drawn, n, ids, f"{seed}-cut")


def waterfill(sizes: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Equal quotas, then the shortage filled from the largest group down.

    Returns keys, size, quota; the running total walks the table of groups only.
    """
    base = balanced_quotas(sizes, n, "equal")
    order = Window.orderBy(F.desc("size"), *keys)
    everything = Window.partitionBy()
    spare = F.col("size") - F.col("quota")
    filled_before = F.coalesce(
        F.sum(spare).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    shortage = F.lit(n) - F.sum("quota").over(everything)
    staged = base.withColumns({"_before": filled_before, "_short": shortage})
    extra = F.greatest(F.lit(0), F.least(F.col("size") - F.col("quota"), F.col("_short") - F.col("_before")))
    return staged.withColumn("quota", (F.col("quota") + extra).cast("bigint")).drop("_before", "_short")


def sample_stratified(
    df: DataFrame, keys: Sequence[str], n: int, ids: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """Equal quota per stratum, cut when over ``n``, filled from the largest strata when
    under. Rows are told apart by id, so equal values under two ids both count. Returns the
    ids and keys of the drawn rows; the strata are computed once and stored."""
    slim = materialise(df.select(*ids, *keys), "strata")
    drawn = _apply_quotas(slim, waterfill(group_sizes(slim, keys), keys, n), keys, ids, seed)
    return sample_n(drawn, n, ids, f"{seed}-cut")


def add_strata(df: DataFrame, bins: dict[str, Sequence[float]]) -> tuple[DataFrame, list[str]]:
    """Bin index columns for numeric property columns."""
    names = {f"{c}_bin": digitise(F.col(c).cast("double"), edges) for c, edges in bins.items()}
    return df.withColumns(names), list(names)


def sample_triplets(
    items: DataFrame, item: str, key: str, hard_probability: float, seed: int | str = 42
) -> DataFrame:
    """Anchor, positive and negative id per row.

    Rows stand in seeded rings, one per key and one over all rows. The positive is the
    next row of the key's ring. A hard negative, with the given probability, is the row
    after that; any other negative lies a hashed shift ahead in the ring of all rows.
    Neither is ever the anchor. Keys of one row have no positive and drop out.
    """
    slim = items.select(F.col(item).alias("anchor"), F.col(key).alias("_key"))
    ringed = rank_by_hash(slim, ["_key"], ["anchor"], f"{seed}-key", "_r", "_n")
    ringed = rank_by_hash(ringed, [], ["anchor"], f"{seed}-all", "_g", "_all")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}-draw"), "anchor")), 1, 8), 16, 10).cast("bigint")
    staged = ringed.withColumn("_draw", draw).withColumn(
        "hard", (F.col("_draw") % 10000 < int(round(hard_probability * 10000))) & (F.col("_n") > 2)
    )
    ahead = lambda rank, total, by: F.pmod(F.col(rank) - 1 + by, F.col(total)) + 1
    shift = F.pmod(F.floor(F.col("_draw") / 10000), F.col("_all") - 1) + 1
    wanted = staged.filter("_n > 1").select(
        "anchor", "_key", "hard",
        ahead("_r", "_n", F.lit(1)).alias("_pos_r"),
        ahead("_r", "_n", F.lit(2)).alias("_hard_r"),
        ahead("_g", "_all", shift).alias("_easy_g"),
    )
    by_key = staged.select(F.col("_key").alias("k"), F.col("_r").alias("r"), F.col("anchor").alias("id"))
    by_all = staged.select(F.col("_g").alias("g"), F.col("anchor").alias("id"))
    pos = by_key.select(F.col("k").alias("_key"), F.col("r").alias("_pos_r"), F.col("id").alias("positive"))
    hard = by_key.select(F.col("k").alias("_key"), F.col("r").alias("_hard_r"), F.col("id").alias("_hard_id"))
    easy = by_all.select(F.col("g").alias("_easy_g"), F.col("id").alias("_easy_id"))
    return (
        wanted.join(pos, ["_key", "_pos_r"])
        .join(hard, ["_key", "_hard_r"])
        .join(easy, ["_easy_g"])
        .select(
            "anchor", "positive", "hard",
            F.when(F.col("hard"), F.col("_hard_id")).otherwise(F.col("_easy_id")).alias("negative"),
        )
    )


def top_n(df: DataFrame, keys: Sequence[str], n: int, score: str, ids: Sequence[str], slots: int = 64) -> DataFrame:
    """Best ``n`` rows per key by a score in [0, 1], ties by id; score slots split a key."""
    bucket = {"slot": F.floor((1 - F.col(score)) * slots)}
    return take_in_order(df, keys, n, bucket, [F.desc(score), *[F.col(c) for c in ids]], rank="rank")
