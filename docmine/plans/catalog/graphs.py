"""Molecule-graph queries over atoms and bonds derived from documents, and two graphs of
the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.operators import audit as A
from docmine.operators import graphs as R
from docmine.operators.components import connected_components
from docmine.plans import derive as D
from docmine.plans.registry import query

# Standard atomic weights of the elements the fragments hold.
WEIGHTS = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "S": 32.06, "Cl": 35.45, "Br": 79.904}
WEIGHTS_SQL = "weights AS (SELECT symbol, weight::DOUBLE AS weight FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items()) + ") w(symbol, weight))"


def tables(t):
    return D.atoms(t.documents), D.bonds(t.documents)


def weights(t):
    return t.spark.createDataFrame(list(WEIGHTS.items()), "symbol string, weight double")


@query(
    "wildcard_atom_labels",
    f"WITH {D.ATOMS_SQL} SELECT mol_id, idx, 'R' AS label FROM atoms WHERE symbol = '*' AND isotope = 0 AND charge = 0 AND explicit_h = 0 AND map_num = 0",
)
def wildcard_atom_labels(t):
    return R.wildcard_atoms(D.atoms(t.documents)).select("mol_id", "idx", "label")


@query(
    "bond_directions",
    f"WITH {D.BONDS_SQL} SELECT code, count(*) AS n, sum(u)::BIGINT AS u_sum, sum(v)::BIGINT AS v_sum FROM (SELECT u, v, code FROM bonds UNION ALL SELECT v, u, CASE WHEN code <= 4 THEN code ELSE 11 - code END FROM bonds) GROUP BY 1",
)
def bond_directions(t):
    """Both directions of each bond; wedge codes swap."""
    return R.bond_rows(D.bonds(t.documents)).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("u_sum"), F.sum("v").alias("v_sum")
    )


@query(
    "gross_formulas",
    f"WITH {D.ATOMS_SQL}, c AS (SELECT mol_id, symbol, count(*) AS n FROM atoms GROUP BY 1, 2) SELECT mol_id, string_agg(symbol || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY symbol) AS formula FROM c GROUP BY 1",
)
def gross_formulas(t):
    return R.gross_formula(D.atoms(t.documents))


@query(
    "formula_twins",
    f"""WITH {D.ATOMS_SQL}, c AS (SELECT mol_id, symbol, count(*) AS n FROM atoms GROUP BY 1, 2),
    f AS (SELECT mol_id, string_agg(symbol || CASE WHEN n > 1 THEN n::VARCHAR ELSE '' END, '' ORDER BY symbol) AS formula FROM c GROUP BY 1)
    SELECT formula, count(*) AS n, min(mol_id) AS first_id FROM f GROUP BY 1 HAVING count(*) > 1""",
)
def formula_twins(t):
    """Structures sharing a gross formula, one row per formula instead of all pairs."""
    formulas = R.gross_formula(D.atoms(t.documents))
    return formulas.groupBy("formula").agg(
        F.count(F.lit(1)).alias("n"), F.min("mol_id").alias("first_id")
    ).filter("n > 1")


@query(
    "molecule_mass",
    f"WITH {D.ATOMS_SQL}, {WEIGHTS_SQL} SELECT mol_id, CASE WHEN count(*) = count(weight) THEN round(sum(weight), 4) END AS mass FROM atoms LEFT JOIN weights USING (symbol) GROUP BY 1",
)
def molecule_mass(t):
    return R.mass(D.atoms(t.documents), weights(t)).withColumn("mass", F.round("mass", 4))


@query(
    "mass_composition",
    f"WITH {D.ATOMS_SQL}, {WEIGHTS_SQL}, p AS (SELECT mol_id, symbol, sum(weight) AS part FROM atoms JOIN weights USING (symbol) GROUP BY 1, 2) "
    "SELECT mol_id, symbol, round(part / sum(part) OVER (PARTITION BY mol_id) * 100, 4) AS pct FROM p",
)
def mass_composition(t):
    out = R.mass_composition(D.atoms(t.documents), weights(t))
    return out.withColumn("pct", F.round("pct", 4))


@query(
    "atom_degrees",
    f"WITH {D.BONDS_SQL} SELECT degree, count(*) AS n FROM (SELECT mol_id, i, count(*) AS degree FROM (SELECT mol_id, u AS i FROM bonds UNION ALL SELECT mol_id, v FROM bonds) GROUP BY 1, 2) GROUP BY 1",
)
def atom_degrees(t):
    return R.degree(D.bonds(t.documents)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query(
    "leaf_atoms",
    f"WITH {D.BONDS_SQL}, d AS (SELECT mol_id, i, count(*) AS degree FROM (SELECT mol_id, u AS i FROM bonds UNION ALL SELECT mol_id, v FROM bonds) GROUP BY 1, 2) SELECT a.mol_id, a.idx FROM atoms a JOIN d ON a.mol_id = d.mol_id AND a.idx = d.i WHERE degree = 1 AND symbol <> '*'",
)
def leaf_atoms(t):
    return R.leaf_atoms(*tables(t))


@query(
    "bond_change_candidates",
    f"WITH {D.BONDS_SQL} SELECT mol_id, count(*) AS n FROM bonds WHERE code IN (1, 2) GROUP BY 1",
)
def bond_change_candidates(t):
    return R.change_candidates(D.bonds(t.documents)).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n"))


KIND_SQL = (
    f"CASE WHEN symbol IN {tuple(S.RGROUP_SYMBOLS)!r} THEN 'rgroup' WHEN symbol IN {tuple(S.ABBREVIATIONS)!r} THEN 'abbreviation' "
    f"WHEN regexp_matches('[' || symbol || ']', '{S.BRACKET_ATOM}') THEN 'element' ELSE 'other' END"
)


@query(
    "symbol_class_counts",
    f"WITH {D.ATOMS_SQL} SELECT mol_id, CASE WHEN count(*) FILTER (symbol = '*') = 0 THEN sum(explicit_h + (symbol = 'H')::INTEGER)::BIGINT END AS n_hydrogens, "
    f"count(*) FILTER (symbol <> '*' AND {KIND_SQL} IN ('abbreviation', 'other')) AS n_pseudo, count(*) FILTER (symbol = '*' OR {KIND_SQL} = 'rgroup') AS n_rsites FROM atoms GROUP BY 1",
)
def symbol_class_counts(t):
    return R.symbol_class_counts(D.atoms(t.documents))


@query("graph_counts")
def graph_counts(t):
    """Counts per molecule with components and rings; checked against union-find in the tests
    (the recursive SQL closure does not finish on the whole table)."""
    return R.graph_counts(*tables(t))


@query(
    "graph_sizes",
    f"WITH {D.BONDS_SQL}, a AS (SELECT mol_id, count(*) AS n_atoms, count(*) FILTER (symbol NOT IN ('H', '*')) AS n_heavy, count(*) FILTER (symbol NOT IN ('H', '*', 'C')) AS n_hetero FROM atoms GROUP BY 1), "
    "b AS (SELECT mol_id, count(*) AS n_bonds FROM bonds GROUP BY 1) SELECT mol_id, n_atoms, n_heavy, n_hetero, coalesce(n_bonds, 0) AS n_bonds FROM a LEFT JOIN b USING (mol_id)",
)
def graph_sizes(t):
    """The part of the graph counts that needs no closure."""
    atoms, bonds = tables(t)
    heavy = ~F.col("symbol").isin("H", "*")
    a = atoms.groupBy("mol_id").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.count_if(heavy).alias("n_heavy"),
        F.count_if(heavy & (F.col("symbol") != "C")).alias("n_hetero"),
    )
    b = bonds.groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_bonds"))
    return a.join(b, "mol_id", "left").fillna(0, ["n_bonds"])


@query(
    "supply_components",
    "WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem), "
    "both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "walk(v, r) USING KEY (v) AS (SELECT a AS v, min(a) AS r FROM both_ways GROUP BY a UNION "
    "SELECT g.b, min(w.r) FROM walk w JOIN both_ways g ON g.a = w.v JOIN recurring.walk o ON o.v = g.b WHERE w.r < o.r GROUP BY g.b) "
    "SELECT v AS vertex, r AS component FROM walk",
)
def supply_components(t):
    """Parts and suppliers linked by shipments."""
    edges = t.lineitem.select(
        F.col("l_partkey").alias("u"), (-1 - F.col("l_suppkey")).alias("v")
    )
    return connected_components(edges)


@query(
    "normalised_coordinates",
    f"WITH {D.ATOMS_SQL}, s AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM atoms WINDOW w AS (PARTITION BY mol_id)) "
    "SELECT mol_id, idx, round((x - x0) / greatest(x1 - x0, 1e-6), 6) AS x, round((y1 - y) / greatest(y1 - y0, 1e-6), 6) AS y FROM s",
)
def normalised_coordinates(t):
    nodes = D.atoms(t.documents).select("mol_id", "idx", "x", "y")
    out = R.normalise_nodes(nodes, "mol_id")
    return out.select("mol_id", "idx", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "isotope_subsets",
    f"""WITH {D.ATOMS_SQL}, w AS (SELECT DISTINCT mol_id, unnest(regexp_extract_all(smiles, '\\[(\\d+)\\*\\]', 1))::INTEGER AS isotope FROM structures),
    have AS (SELECT DISTINCT mol_id, isotope FROM atoms WHERE symbol = '*' AND isotope > 0 AND idx % 5 <> 0)
    SELECT w.mol_id, count(*) AS numbers, count(*) - count(h.mol_id) AS missing, count(*) = count(h.mol_id) AS ok FROM w LEFT JOIN have h ON w.mol_id = h.mol_id AND w.isotope = h.isotope GROUP BY 1""",
)
def isotope_subsets(t):
    """Numbers written in the text that no wildcard atom carries; every fifth atom of the
    table has lost its number."""
    atoms = D.atoms(t.documents).withColumn("isotope", F.when(F.col("idx") % 5 == 0, 0).otherwise(F.col("isotope")))
    return A.id_subset_check(D.by_molecule(t.documents), atoms)


@query(
    "atom_labels",
    f"WITH {D.ATOMS_SQL} SELECT label, count(*) AS n FROM (SELECT CASE WHEN symbol IN {tuple(S.ORGANIC_SYMBOLS)!r} AND isotope = 0 AND charge = 0 AND explicit_h = 0 THEN symbol "
    "ELSE '[' || CASE WHEN isotope <> 0 THEN isotope::VARCHAR ELSE '' END || symbol || CASE WHEN explicit_h > 1 THEN 'H' || explicit_h WHEN explicit_h = 1 THEN 'H' ELSE '' END "
    "|| CASE charge WHEN 1 THEN '+' WHEN -1 THEN '-' ELSE '' END || ']' END AS label FROM atoms) GROUP BY 1",
)
def atom_labels(t):
    label = S.atom_label(F.col("symbol"), F.col("isotope"), F.col("explicit_h"), F.col("charge"))
    return D.atoms(t.documents).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "molblock_symbols",
    f"""WITH {D.STRUCTURES_SQL}, l AS (SELECT mol_id, h0, {D.atom_tokens_sql('smiles')} AS toks FROM structures),
    r AS (SELECT mol_id, h0, toks, unnest(range(0, len(toks))) AS i FROM l WHERE h0 % 12 <> 0)
    SELECT mol_id, i::INTEGER AS idx, toks[i + 1] AS symbol FROM r WHERE h0 % 12 <> 1 OR i < 3""",
)
def molblock_symbols(t):
    """Molecule blocks written from the atom tokens and read back. Blocks with a broken count
    give no rows, a small count cuts the list."""
    tokens = F.col("tokens")
    lines = F.transform(tokens, lambda s: F.concat(F.lit("    0.0000    0.0000    0.0000 "), s, F.lit("  0  0")))
    count = F.when(F.col("h0") % 12 == 0, "abc").when(F.col("h0") % 12 == 1, "3").otherwise(F.size(tokens).cast("string"))
    block = F.concat_ws("\n", F.lit("name"), F.lit(" "), F.lit(""), F.concat(F.lit(" "), count, F.lit("  0")), F.array_join(lines, "\n"), F.lit("M  END"))
    return (
        D.structures(t.documents)
        .select("mol_id", "h0", S.atom_tokens(F.col("smiles")).alias("tokens"))
        .select("mol_id", F.inline(R.molblock_atoms(block)))
    )
