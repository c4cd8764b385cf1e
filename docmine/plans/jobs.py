"""Composite jobs: balanced sampling, corpus normalisation, table preparation, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.functions.runs import token_bits
from docmine.operators import sampling, search
from docmine.session import materialise


def structure_strata(structures: DataFrame) -> tuple[DataFrame, list[str]]:
    """Heavy-atom and ring bins of the structure strings that can be read; the others have
    failed and are in no stratum."""
    counted = structures.filter(S.is_valid_structure(F.col("smiles"))).withColumns(
        {"num_atoms": S.heavy_atoms(F.col("smiles")), "num_rings": S.ring_count(F.col("smiles"))}
    )
    return sampling.add_strata(counted, sampling.DEFAULT_BINS)


def convert_estrings(df: DataFrame, key: str, text: str) -> DataFrame:
    """Annotated strings to plain structure text with the outcome category."""
    return df.select(key, S.convert_estring(F.col(text)).alias("c")).select(key, "c.smiles", "c.category")


def structure_bits(structures: DataFrame, n: int = 3, slots: int = 2048) -> DataFrame:
    """(id, bits) of structure strings from hashed token runs."""
    return token_bits(structures, "mol_id", "smiles", S.TOKENS, n, slots)


def balanced_structure_sample(
    structures: DataFrame, n: int, threshold: float = 0.5, strategy: str = "sqrt", seed: int = 42,
    clustering: str = "components",
) -> DataFrame:
    """(mol_id, cluster): property strata give ten candidates per wanted row, near-duplicate
    clusters are formed among them, and the clusters are drawn from evenly."""
    strata, keys = structure_strata(structures)
    # Stored, as the draw reads the strata several times and would judge all structures again.
    slim = materialise(strata.select("mol_id", "smiles", *keys), "strata")
    chosen = sampling.sample_stratified(slim, keys, 10 * n, ["mol_id"], seed).select("mol_id")
    bits = structure_bits(slim.join(materialise(chosen, "chosen"), "mol_id", "left_semi"))
    cluster = search.component_clusters if clustering == "components" else search.leader_clusters
    clusters = cluster(bits, threshold).select(F.col("id").alias("mol_id"), "cluster")
    return sampling.sample_balanced(clusters, ["cluster"], n, ["mol_id"], strategy, seed)
