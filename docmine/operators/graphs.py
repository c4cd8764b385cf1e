"""Molecule graphs as atom and bond tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.functions.binding import let
from docmine.functions.text import is_valid_label


def wildcard_atoms(atoms: DataFrame) -> DataFrame:
    """Bare wildcard atoms (no isotope, charge, hydrogens or map number) with clean labels."""
    label = S.clean_symbol(F.coalesce("label", F.lit("*"))) if "label" in atoms.columns else F.lit("R")
    bare = atoms.filter(
        (F.col("symbol") == "*")
        & (F.col("isotope") == 0)
        & (F.col("charge") == 0)
        & (F.col("explicit_h") == 0)
        & (F.col("map_num") == 0)
    )
    return bare.withColumn("label", F.when(is_valid_label(label), label).otherwise("R"))


def bond_rows(edges: DataFrame, atom_counts: DataFrame | None = None, key: str = "mol_id") -> DataFrame:
    """Both directions of every bond: codes up to 4 are symmetric, 5 and 6 swap. With atom
    counts given, bonds with an end out of range are dropped."""
    if atom_counts is not None:
        edges = edges.join(atom_counts.select(key, F.col("n_atoms")), key).filter(
            F.col("u").between(0, F.col("n_atoms") - 1) & F.col("v").between(0, F.col("n_atoms") - 1)
        ).drop("n_atoms")
    back = F.when(F.col("code") <= 4, F.col("code")).otherwise(11 - F.col("code"))
    both = F.array(
        F.struct(F.col("u").alias("u"), F.col("v").alias("v"), F.col("code").alias("code")),
        F.struct(F.col("v").alias("u"), F.col("u").alias("v"), back.alias("code")),
    )
    return edges.select(key, F.explode(both).alias("b")).select(key, "b.u", "b.v", "b.code")


def gross_formula(atoms: DataFrame, key: str = "mol_id") -> DataFrame:
    """Element counts per molecule, and as one text in alphabetical order.

    The list per molecule has one entry per element, so it is short whatever the size of
    the molecule."""
    counts = atoms.groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("symbol", "n")
    lists = counts.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    text = F.transform("e", lambda s: F.concat(s["symbol"], F.when(s["n"] > 1, s["n"].cast("string")).otherwise("")))
    return lists.select(key, F.array_join(text, "").alias("formula"))


def mass(atoms: DataFrame, weights: DataFrame, key: str = "mol_id") -> DataFrame:
    """Sum of element weights; atoms without a weight make the mass null."""
    counts = atoms.groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(weights, "symbol", "left")
    return weighed.groupBy(key).agg(
        F.when(F.count_if(F.col("weight").isNull()) == 0, F.sum(F.col("n") * F.col("weight"))).alias("mass")
    )


def mass_composition(atoms: DataFrame, weights: DataFrame, key: str = "mol_id") -> DataFrame:
    """Percentage of the mass per element. After the count a molecule has one row per
    element, so the window over it is small."""
    counts = atoms.groupBy(key, "symbol").agg(F.count(F.lit(1)).alias("n"))
    parts = counts.join(weights, "symbol").withColumn("part", F.col("n") * F.col("weight"))
    total = F.sum("part").over(Window.partitionBy(key))
    return parts.select(key, "symbol", (F.try_divide("part", total) * 100).alias("pct"))


def degree(bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    ends = bonds.select(key, F.explode(F.array("u", "v")).alias("idx"))
    return ends.groupBy(key, "idx").agg(F.count(F.lit(1)).alias("degree"))


def leaf_atoms(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """Atoms of degree one other than stars."""
    # Atoms and bond ends meet in one aggregation; tables dealt out by molecule are not shuffled.
    listed = atoms.filter("symbol <> '*'").select(key, "idx", F.lit(0).alias("_end"))
    ends = bonds.select(key, F.explode(F.array("u", "v")).alias("idx"), F.lit(1).alias("_end"))
    met = listed.unionByName(ends).groupBy(key, "idx").agg(F.sum("_end").alias("_degree"), F.min("_end").alias("_least"))
    return met.filter("_degree = 1 AND _least = 0").select(key, "idx")


def change_candidates(bonds: DataFrame) -> DataFrame:
    """Bonds whose order may change: single and double ones."""
    return bonds.filter(F.col("code").isin(1, 2))


def symbol_class_counts(atoms: DataFrame, key: str = "mol_id") -> DataFrame:
    """Hydrogens (null while unknown for a star), pseudo atoms and label sites."""
    star = F.col("symbol") == "*"
    h = F.col("explicit_h") + F.when(F.col("symbol") == "H", 1).otherwise(0)
    kind = F.col("_kind")
    return atoms.withColumn("_kind", S.classify_label(F.col("symbol"))).groupBy(key).agg(
        F.when(F.count_if(star) == 0, F.sum(h)).alias("n_hydrogens"),
        F.count_if(kind.isin("abbreviation", "other") & ~star).alias("n_pseudo"),
        F.count_if(star | (kind == "rgroup")).alias("n_rsites"),
    )


def _forest(mol: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(molecule, atom, least atom of its part) of every atom that is not the least of its part.
    ``mol`` counts up from 0."""
    starts = np.flatnonzero(np.diff(mol, prepend=-1))
    if not len(u):
        return mol, u, v
    top = np.maximum(u, v)
    spans = np.zeros(int(mol[-1]) + 1, np.int64)
    spans[mol[starts]] = np.maximum.reduceat(np.minimum(top, 1 << 40), starts) + 1
    ids = None
    if min(u.min(), v.min()) < 0 or spans.sum() > 8 * len(u) + 1024:
        # Atoms far apart are numbered anew.
        ids, both = np.unique(np.concatenate([u, v]), return_inverse=True)
        keys, places = np.unique(np.concatenate([mol, mol]) * len(ids) + both, return_inverse=True)
        owner, atom = keys // len(ids), ids[keys % len(ids)]
        a, b = places[: len(u)], places[len(u) :]
    else:
        base = np.cumsum(spans) - spans
        owner = np.repeat(np.arange(len(spans)), spans)
        atom = np.arange(len(owner)) - base[owner]
        a, b = u + base[mol], v + base[mol]
    root = np.arange(len(owner))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high > low
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        # Roots hang on smaller roots; of several bonds to one root, one counts in a round.
        root[high] = low
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    hung = np.flatnonzero(root != np.arange(len(root)))
    return owner[hung], atom[hung], atom[root[hung]]


def bond_closures(bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """(key, n_bonds, _merged) per molecule: its bonds, and its atoms minus components, the
    number of bonds that join two parts. Rows come sorted by molecule; a task holds a batch of
    bonds and, of a molecule that goes on in the next, one bond per atom at most."""
    kind = bonds.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(keys, counts, merged):
            return pa.RecordBatch.from_arrays(
                [keys, pa.array(counts, pa.int64()), pa.array(merged, pa.int64())], names=[key, "n_bonds", "_merged"]
            )

        open_key, n, held = None, 0, (np.zeros(0, np.int64),) * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            new = np.ones(len(keys), bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(new)
            counts = np.diff(np.append(heads, len(keys)))
            real = pc.fill_null(pc.not_equal(batch.column(1), batch.column(2)), False).to_numpy(zero_copy_only=False)
            mol = (np.cumsum(new) - 1)[real]
            u, v = (pc.fill_null(batch.column(i), 0).to_numpy()[real] for i in (1, 2))
            if open_key is not None and open_key[0].equals(keys[0]):
                counts[0] += n
                mol = np.concatenate([np.zeros(len(held[0]), np.int64), mol])
                u, v = np.concatenate([held[0], u]), np.concatenate([held[1], v])
            elif open_key is not None:
                yield rows(open_key, [n], [len(held[0])])
            owner, atom, least = _forest(mol, u, v)
            last = len(heads) - 1
            yield rows(keys.take(pa.array(heads[:-1])), counts[:-1], np.bincount(owner, minlength=len(heads))[:-1])
            open_key, n = keys.slice(int(heads[-1]), 1), int(counts[-1])
            held = (atom[owner == last], least[owner == last])
        if open_key is not None:
            yield rows(open_key, [n], [len(held[0])])

    ends = bonds.filter(F.col(key).isNotNull()).select(key, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    # The window sorts the rows of a molecule together; those dealt out by molecule stay where they are.
    together = ends.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return together.filter("_row > 0").select(key, "u", "v").mapInArrow(run, f"`{key}` {kind}, n_bonds long, _merged long")


def merged_atoms(bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """Atoms minus components per molecule (``_merged``), the number of bonds that join two
    parts."""
    return bond_closures(bonds, key).filter("_merged > 0").select(key, "_merged")


def graph_counts(atoms: DataFrame, bonds: DataFrame, key: str = "mol_id") -> DataFrame:
    """Atoms, heavy and hetero atoms, bonds, components and rings (edges - atoms + components)."""
    heavy = ~F.col("symbol").isin("H", "*")
    a = atoms.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_atoms"),
        F.count_if(heavy).alias("n_heavy"),
        F.count_if(heavy & ~F.col("symbol").isin("C")).alias("n_hetero"),
    )
    zero = F.lit(0)
    return (
        a.join(bond_closures(bonds, key), key, "left")
        .select(
            key, "n_atoms", "n_heavy", "n_hetero",
            F.coalesce("n_bonds", zero).alias("n_bonds"),
            (F.col("n_atoms") - F.coalesce("_merged", zero)).alias("n_components"),
            (F.coalesce("n_bonds", zero) - F.coalesce("_merged", zero)).alias("n_rings"),
        )
    )


def normalise_nodes(nodes: DataFrame, key: str, flip_y: bool = True, floor: float = 1e-6) -> DataFrame:
    """Coordinates scaled to [0, 1] per molecule; y runs downwards when flipped. The window
    holds one molecule's nodes."""
    whole = Window.partitionBy(key)
    stats = nodes.withColumns(
        {f"_{a}{n}": f(a).over(whole) for a in "xy" for n, f in ((0, F.min), (1, F.max))}
    )
    span = lambda a: F.greatest(F.col(f"_{a}1") - F.col(f"_{a}0"), F.lit(floor))
    y = F.col("_y1") - F.col("y") if flip_y else F.col("y") - F.col("_y0")
    return stats.withColumns(
        {"x": (F.col("x") - F.col("_x0")) / span("x"), "y": y / span("y")}
    ).drop("_x0", "_x1", "_y0", "_y1")


def molblock_atoms(block: Column) -> Column:
    """Atom symbols of a V2000 block with their index: ``array<struct<idx,symbol>>``.

    The fourth line starts with the atom count; that many lines follow, lines with fewer
    than four fields are skipped. Any fault gives an empty list."""
    return let(F.split(block, "\n"), _listed_atoms)


def _listed_atoms(lines: Column) -> Column:
    count = F.try_element_at(F.split(F.trim(F.try_element_at(lines, F.lit(4))), r"\s+"), F.lit(1)).try_cast("int")
    body = F.slice(lines, F.lit(5), F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)))
    fields = F.transform(body, lambda line: F.split(F.trim(line), r"\s+"))
    symbols = F.transform(F.filter(fields, lambda f: F.size(f) >= 4), lambda f: f[3])
    listed = F.transform(symbols, lambda s, i: F.struct(i.alias("idx"), s.alias("symbol")))
    usable = lines.isNotNull() & (F.size(lines) >= 5) & count.isNotNull()
    return F.when(usable, listed).otherwise(F.array().cast("array<struct<idx:int,symbol:string>>"))
