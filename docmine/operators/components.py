"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.session import materialise, release


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least vertex next to u, through a join: the hot centre of a
    star collapses in the aggregate and its edges are split by the skew join."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_u")
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def connected_components(
    edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100
) -> DataFrame:
    """(vertex, component) for every vertex with an edge; the component is its least vertex.

    A round hangs each vertex's larger neighbours on its least neighbour, then each
    vertex on its least smaller neighbour. The edge table never grows, and a round ends
    in a stored table, so lost executors cost one round at most; only the last one is kept.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter(F.col("u") != F.col("v"))
    current = materialise(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    last = None
    for _ in range(max_rounds):
        both = current.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        large = _with_min(both.select("e.u", "e.v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = large.filter("u <> v").distinct()
        small = _with_min(stars)
        hung = small.select(
            F.explode(
                F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        ).select("e.u", "e.v")
        before, current = current, materialise(hung.filter("u <> v").distinct(), "cc")
        release(before)
        # One summary row decides whether a round changed anything.
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
