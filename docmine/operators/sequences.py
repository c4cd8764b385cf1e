"""Sequence tables: training rows from stored molecules, token accuracy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.functions import sequences as Q
from docmine.functions import structures as S
from docmine.functions import text as T


def sequence_rows(
    rows: DataFrame, key: str, smiles: str, coords: str, extent: int = 384, n_bins: int = 64,
    max_atoms: int = 100, max_length: int = 600,
) -> DataFrame:
    """Token ids of molecules given as text columns, with a status per row.

    Labels are normalised, foreign characters rejected, coordinates parsed, scaled to the
    image and binned, the sequence written; rows too long or with too many atoms are marked.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [None if t is None else S.plain_quick_normalise(t) for t in batch.column(1).to_pylist()]
            has, cuts, p = _points(batch.column(2))
            x, y = (_bins(p[i::2], cuts, extent, n_bins, flip) for i, flip in ((0, False), (1, True)))
            ids, ends, atoms = Q.write_ids(norms, x, y, cuts, n_bins)
            known = pa.array([t is not None for t in norms], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            columns = [
                batch.column(0), pa.array(norms, pa.string()), pc.if_else(known, lists, pa.scalar(None, lists.type)),
                pc.if_else(known, pa.array(atoms.astype(np.int32)), pa.scalar(None, pa.int32())), pa.array(has),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "norm", "ids", "n_atoms", "has_coords"])

    parsed = rows.select(key, smiles, F.from_json(coords, "array<array<double>>").alias("_points"))
    counted = parsed.mapInArrow(run, f"`{key}` {kind}, norm string, ids array<int>, n_atoms int, has_coords boolean")
    status = (
        F.when(T.is_blank(F.col("norm")), "blank")
        .when(~T.in_alphabet(F.col("norm")), "foreign_character")
        .when(~F.col("has_coords"), "bad_coords")
        .when((F.col("n_atoms") < 1) | (F.col("n_atoms") > max_atoms), "atom_count")
        .when(F.size("ids") > max_length, "too_long")
        .otherwise("ok")
    )
    return counted.select(key, "norm", "ids", "n_atoms", "has_coords", status.alias("status"))


def _points(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with usable points, offsets of their points, x and y of all points in turn). As in
    ``Q.parse_coords`` every entry has to be a pair, and there has to be one."""
    pairs, cuts = Q.flat_lists(lists)
    sizes = pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False)
    values = pairs.flatten()
    inner = Q.offsets(sizes)
    empty = Q.offsets(values.is_null().to_numpy(zero_copy_only=False))
    bad = Q.offsets((sizes != 2) | (empty[inner[1:]] > empty[inner[:-1]]))
    counts = np.diff(cuts)
    has = (counts > 0) & (bad[cuts[1:]] == bad[cuts[:-1]])
    kept = np.repeat(np.repeat(has, counts), sizes)
    return has, Q.offsets(counts * has), values.to_numpy(zero_copy_only=False).astype(np.float64)[kept]


def _bins(p: np.ndarray, cuts: np.ndarray, extent: int, n_bins: int, flip: bool) -> np.ndarray:
    """Bins of one coordinate, scaled to the image by its range in each row. Not-a-number counts
    as larger than any number, as in Spark."""
    sizes = np.diff(cuts)
    heads = cuts[:-1][sizes > 0]
    if not len(p):
        return np.zeros(0, np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        low, high = np.fmin.reduceat(p, heads), np.maximum.reduceat(p, heads)
        span = np.maximum(high - low, 1e-6)
        low, high, span = (np.repeat(v, sizes[sizes > 0]) for v in (low, high, span))
        value = ((high - p) if flip else (p - low)) / span * extent
        inside = np.fmin(np.maximum(value, 0.0), extent - 1)
        return np.clip(np.floor(inside / extent * n_bins), 0, n_bins - 1).astype(np.int64)


def sequence_metrics(pairs: DataFrame, n_bins: int = 64, keys=()) -> DataFrame:
    """Accuracy over (target, pred) id pairs: symbols, coordinates, each axis; and the mean
    bin distance per axis where the prediction is a bin of that axis (null if it never is)."""
    t, p = F.col("target"), F.col("pred")
    x, y = Q.is_x(t, n_bins), Q.is_y(t, n_bins)
    hit = (t == p).cast("double")
    off = F.abs(p - t).cast("double")
    rate = lambda cond: F.coalesce(F.avg(F.when(cond, hit)), F.lit(0.0))
    return pairs.groupBy(*keys).agg(
        rate(~x & ~y & (t != Q.PAD)).alias("symbol_acc"),
        rate(x | y).alias("coord_acc"),
        rate(x).alias("x_acc"),
        rate(y).alias("y_acc"),
        F.avg(F.when(x & Q.is_x(p, n_bins), off)).alias("x_mae"),
        F.avg(F.when(y & Q.is_y(p, n_bins), off)).alias("y_mae"),
    )


def bond_accuracy(cells: DataFrame, keys=()) -> DataFrame:
    """Share of equal codes over ordered atom pairs off the diagonal."""
    return cells.filter(F.col("i") != F.col("j")).groupBy(*keys).agg(
        F.avg((F.col("code") == F.col("pred")).cast("double")).alias("bond_acc")
    )
