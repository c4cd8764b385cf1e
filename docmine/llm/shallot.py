"""Exact k-means over integer vectors by Shallot search: remembered second-nearest centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmine.session import materialise, release

#: Components beyond this are an error: their squared distances could leave 64 bits.
TOP = 1 << 26
#: Relative margin by which floating bounds are widened before they exclude anything.
MARGIN = 1e-9

STATE = "vec_id {key}, v binary, cluster int, second int, upper double, lower double, moved boolean"
ROUND = STATE + ", part int, change long, total array<long>"


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows with exactly ``dims`` components, none null or non-finite, each
    turned into floor(scale * component)."""
    e = F.col(vector)
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.filter((F.size(e) == dims) & finite)
    return kept.select(F.col(key).alias("vec_id"), F.transform(e, lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def packed_vectors(kept: DataFrame, kind: str, dims: int) -> DataFrame:
    """(vec_id, v): components as little-endian 32-bit integers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(x) and max(x.max(), -x.min()) > TOP:
                raise ValueError(f"a component lies beyond {TOP} after scaling; its distances do not fit 64 bits")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _binary(x.astype("<i4"), dims)], names=["vec_id", "v"])

    return kept.mapInArrow(run, f"vec_id {kind}, v binary")


def _binary(x: np.ndarray, dims: int) -> pa.Array:
    rows = x.size // dims
    ends = np.arange(rows + 1, dtype=np.int32) * (4 * dims)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view("<i4").reshape(-1, dims).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows to one centroid, or row by row, in integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Nearest and second-nearest centroid of many vectors.

    ``near[c]`` lists the centroids by their distance from centroid c. A vector's search
    starts from the closer of the two centroids it remembers and goes along that list; the
    ball, whose radius is the vector's distance to the start plus its second-best distance
    so far, shrinks with every better find, and a vector leaves when the next centroid lies
    outside it. What is left is compared by exact squared distance, ties by number.
    """

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.c = np.array(centroids, np.int64).reshape(len(centroids), -1)
        apart = np.sqrt(((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(axis=2).astype(float))
        self.near = np.argsort(apart, axis=1, kind="stable")
        # The start itself stands first in its list, also beside centroids equal to it.
        for j, row in enumerate(self.near):
            self.near[j] = np.concatenate([[j], row[row != j]])
        self.reach = np.take_along_axis(apart, self.near, axis=1)
        self.gap = self.reach[:, 1] if len(self.c) > 1 else np.full(1, np.inf)
        self.scanned = 0

    def full(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, second, squared distances to both) by all centroids."""
        d = np.stack([squared(x, c) for c in self.c], axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        one = order[:, 0]
        two = order[:, 1] if len(self.c) > 1 else one
        rows = np.arange(len(x))
        return one, two, d[rows, one], d[rows, two]

    def nearest(self, x: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same by ball search from remembered centroids."""
        a, b = squared(x, self.c[own]), squared(x, self.c[other])
        swap = (b < a) | ((b == a) & (other < own))
        one, two = np.where(swap, other, own), np.where(swap, own, other)
        da, db = np.where(swap, b, a), np.where(swap, a, b)
        self.scanned += 2 * len(x)
        start, root = one.copy(), np.sqrt(da.astype(float))
        live = np.arange(len(x))
        for step in range(1, len(self.c)):
            ball = root[live] + np.sqrt(db[live].astype(float))
            live = live[self.reach[start[live], step] <= ball * (1 + MARGIN) + MARGIN]
            if not len(live):
                break
            j = self.near[start[live], step]
            fresh = (j != own[live]) & (j != other[live])
            at, j = live[fresh], j[fresh]
            self.scanned += len(at)
            d = squared(x[at], self.c[j])
            first = (d < da[at]) | ((d == da[at]) & (j < one[at]))
            then = ~first & ((d < db[at]) | ((d == db[at]) & (j < two[at])))
            f, t = at[first], at[then]
            two[f], db[f] = one[f], da[f]
            one[f], da[f] = j[first], d[first]
            two[t], db[t] = j[then], d[then]
        return one, two, da, db


def _assign(search: Search, shift: np.ndarray | None, dims: int, kind: pa.DataType):
    """A pass over the rows: bounds are carried by the centroids' shifts, rows whose bounds
    cross are searched, and each task adds up what entered and left its clusters."""
    names = ["vec_id", "v", "cluster", "second", "upper", "lower", "moved", "part", "change", "total"]
    k = len(search.c)

    def batch_of(ids, v, cluster, second, upper, lower, moved, part, change, total):
        kinds = [kind, pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = (ids, v, cluster, second, upper, lower, moved, part, change, total)
        n = max(len(c) for c in columns if c is not None)
        arrays = [pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), dims)
            if shift is None:
                one, two, da, db = search.full(x)
                upper, lower = np.sqrt(da.astype(float)), np.sqrt(db.astype(float))
                before = None
            else:
                before = batch.column("cluster").to_numpy()
                one, two = before.astype(np.int64), batch.column("second").to_numpy().astype(np.int64)
                upper = batch.column("upper").to_numpy() + shift[one]
                # The largest shift of any centroid but the own one.
                most = np.array([np.delete(shift, j).max(initial=0.0) for j in range(k)])
                lower = batch.column("lower").to_numpy() - most[one]
                bound = np.maximum(lower, search.gap[one] - upper)
                open_ = np.flatnonzero(upper * (1 + MARGIN) + MARGIN >= bound)
                exact = squared(x[open_], search.c[one[open_]])
                upper[open_] = np.sqrt(exact.astype(float))
                bound = np.maximum(lower[open_], search.gap[one[open_]] - upper[open_])
                open_ = open_[upper[open_] * (1 + MARGIN) + MARGIN >= bound]
                one[open_], two[open_], da, db = search.nearest(x[open_], one[open_], two[open_])
                upper[open_], lower[open_] = np.sqrt(da.astype(float)), np.sqrt(db.astype(float))
            moved = np.ones(len(x), bool) if before is None else one != before
            np.add.at(total, one[moved], x[moved])
            np.add.at(change, one[moved], 1)
            if before is not None:
                np.subtract.at(total, before[moved], x[moved])
                np.subtract.at(change, before[moved], 1)
            yield batch_of(batch.column("vec_id"), batch.column("v"), one.astype(np.int32), two.astype(np.int32), upper, lower, moved, None, None, None)
        parts = np.flatnonzero((change != 0) | (total != 0).any(axis=1))
        if len(parts):
            yield batch_of(None, None, None, None, None, None, None, parts.astype(np.int32), change[parts], total[parts].tolist())

    return run


def _hash_of(key: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def cluster(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept
    vector (see ``integer_vectors``) after ``rounds`` rounds and a last assignment.

    Centroids start as the kept vectors with the smallest sha256 of ``seed:vec_id``, in that
    order; with fewer vectors than ``clusters`` there are as many centroids as vectors. A
    round assigns every vector to its nearest centroid (ties: smaller number) and moves every
    non-empty centroid to floor(sum / count) per component; empty ones stay. Distances are
    squared, in 64-bit integers.

    Each round reads the rows stored by the round before with their remembered second
    centroid and bounds, and stores them anew with, per task, the sums of vectors that entered
    less those that left each cluster. The driver holds centroids and sums of clusters only.

    Rows with null, short, long or non-finite vectors are left out. Rows without an id are
    clustered but start no centroid, unless no row has one. Rows that share an id are
    vectors of their own; as starts they are ordered by components. An empty table gives
    no rows. A scaled component beyond 2**26 is an error.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, dims, scale, key, vector)
    kind = kept.schema["vec_id"].dataType.simpleString()
    arrow = pa.Table.from_batches([], schema=_arrow_schema(kept)).schema.field("vec_id").type
    start = kept.orderBy(F.col("vec_id").isNull(), _hash_of(F.col("vec_id"), seed), "x").limit(clusters)
    centroids = [tuple(r["x"]) for r in start.select("x", "vec_id").collect()]
    if not centroids:
        nothing = f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    rows, before = packed_vectors(kept, kind, dims), None
    shift, k = None, len(centroids)
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    for number in range(rounds + 1):
        stored = materialise(rows.mapInArrow(_assign(Search(centroids), shift, dims, arrow), ROUND.format(key=kind)), "round")
        if before is not None:
            release(before)
        before = stored
        rows = stored.filter("part IS NULL").select("vec_id", "v", "cluster", "second", "upper", "lower")
        if number == rounds:
            break
        parts = stored.filter("part IS NOT NULL").select("part", F.posexplode(F.array_append("total", F.col("change"))).alias("at", "s"))
        # One row per cluster and component, the number of vectors behind the components.
        for part, at, s in parts.groupBy("part", "at").agg(F.sum("s")).collect():
            if at == dims:
                counts[part] += s
            else:
                sums[part][at] += s
        fresh = [tuple(s // n for s in total) if n else c for c, n, total in zip(centroids, counts, sums, strict=True)]
        steps = [sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) for a, b in zip(centroids, fresh, strict=True)]
        shift, centroids = np.sqrt(np.array(steps, float)) * (1 + MARGIN), fresh
    measured = _distances(rows, centroids, dims, kind)
    per = measured.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "c int, centroid_sha256 string")
    per = per.join(F.broadcast(named), F.col("cluster") == F.col("c")).select("c", "cluster_inertia", "centroid_sha256")
    total = per.agg(F.sum("cluster_inertia").alias("inertia"))
    # One row per cluster.
    small = F.broadcast(per.join(F.broadcast(total)))
    out = measured.join(small, F.col("cluster") == F.col("c"))
    return out.select(F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _distances(rows: DataFrame, centroids: list[tuple[int, ...]], dims: int, kind: str) -> DataFrame:
    """(vec_id, cluster, distance): the exact squared distance to the own centroid."""
    c = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy(zero_copy_only=False)
            d = squared(_matrix(batch.column("v"), dims), c[own]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
