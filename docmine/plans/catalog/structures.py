"""Structure-string queries over strings derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.functions import text as T
from docmine.operators import audit as A
from docmine.plans import derive as D
from docmine.plans import jobs as J
from docmine.plans.registry import query

PIECES = "regexp_extract_all({}, '(?s)(\\[[^\\]]*\\]?|[^\\[])', 1)"
RENAMED = "regexp_replace(smiles, '\\[(\\d+)\\*\\]', '[R\\1]', 'g')"
STARS = "(length(regexp_replace({0}, '\\[[^\\]]*\\]', '', 'g')) - length(replace(regexp_replace({0}, '\\[[^\\]]*\\]', '', 'g'), '*', '')))::INTEGER"
QUICK = f"CASE WHEN contains({RENAMED}, '*') THEN array_to_string(list_transform({PIECES.format(RENAMED)}, lambda p: CASE WHEN p = '*' THEN '[R]' ELSE p END), '') ELSE {RENAMED} END"
BRACKET = S.BRACKET_ATOM
KEY_SQL = (
    "array_to_string(list_transform(regexp_extract_all(translate(regexp_replace(@S@, ':\\d+\\]', ']', 'g'), '/\\', ''), '"
    + S.TOKEN_PATTERN
    + "', 1), lambda k: CASE WHEN regexp_matches(k, '^\\[R\\d+\\]$') THEN regexp_replace(k, '^\\[R(\\d+)\\]$', '[\\1*]') "
    "WHEN starts_with(k, '[') AND NOT regexp_matches(k, '" + BRACKET + "') THEN '*' ELSE k END), '')"
)
# Structures normalised with their labels; the label list loses its last entry in some rows.
LABELLED_SQL = (
    D.STRUCTURES_SQL
    + f""",
given AS (SELECT mol_id, source, smiles, h0, CASE WHEN h0 % 10 = 0 THEN labels[1:len(labels) - 1] WHEN h0 % 10 = 1 THEN NULL
    ELSE list_transform(labels, lambda l: CASE WHEN regexp_matches(regexp_replace(l, '[.,;:!+\\-*#]+$', ''), '^\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{0,5}}$') THEN regexp_replace(l, '[.,;:!+\\-*#]+$', '') ELSE 'R' END) END AS labels,
    {RENAMED} AS renamed FROM structures),
counted AS (SELECT *, {STARS.format('renamed')} AS stars, {PIECES.format('renamed')} AS ps FROM given),
filled AS (SELECT *, labels IS NOT NULL AND len(labels) = stars AS usable, CASE WHEN stars = 0 THEN renamed ELSE array_to_string(list_transform(ps, lambda p, i:
    CASE WHEN p <> '*' THEN p WHEN labels IS NOT NULL AND len(labels) = stars
      THEN '[' || labels[len(list_filter(ps[1:i], lambda x: x = '*'))] || ']' ELSE '[R]' END), '') END AS norm FROM counted)"""
)


def labelled(t):
    """Structures with cleaned star labels, some of them short by one or missing."""
    clean = F.transform(
        "labels",
        lambda s: F.when(T.is_valid_label(S.clean_symbol(s)), S.clean_symbol(s)).otherwise("R"),
    )
    cut = F.slice("labels", F.lit(1), F.greatest(F.size("labels") - 1, F.lit(0)))
    given = F.when(F.col("h0") % 10 == 0, cut).when(F.col("h0") % 10 == 1, None).otherwise(clean)
    base = D.structures(t.documents).withColumn("labels", given)
    return base.withColumn("norm", S.normalise_with_labels(F.col("smiles"), F.col("labels")))


@query(
    "token_lists",
    f"WITH {D.STRUCTURES_SQL} SELECT mol_id, array_to_string({D.tokens_sql('smiles')}, ' ') AS tokens, len({D.atom_tokens_sql('smiles')})::INTEGER AS n_atoms FROM structures",
)
def token_lists(t):
    smiles = F.col("smiles")
    return D.structures(t.documents).select(
        "mol_id", F.array_join(S.tokenise(smiles), " ").alias("tokens"), S.count_atoms(smiles).alias("n_atoms")
    )


@query("quick_normalised", f"WITH {D.STRUCTURES_SQL} SELECT mol_id, {QUICK} AS norm FROM structures")
def quick_normalised(t):
    return D.structures(t.documents).select("mol_id", S.quick_normalise(F.col("smiles")).alias("norm"))


@query("labelled_structures", f"WITH {LABELLED_SQL} SELECT mol_id, norm FROM filled")
def labelled_structures(t):
    return labelled(t).select("mol_id", "norm")


@query(
    "clean_symbols",
    f"WITH {D.STRUCTURES_SQL} SELECT label, CASE WHEN label IN ('*', 'R#') OR regexp_replace(label, '[.,;:!+\\-*#]+$', '') = '' THEN 'R' ELSE regexp_replace(label, '[.,;:!+\\-*#]+$', '') END AS clean, count(*) AS n FROM (SELECT unnest(labels) AS label FROM structures) GROUP BY ALL",
)
def clean_symbols(t):
    labels = D.structures(t.documents).select(F.explode("labels").alias("label"))
    return labels.groupBy("label", S.clean_symbol(F.col("label")).alias("clean")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bare_star_counts",
    f"WITH {D.STRUCTURES_SQL} SELECT {STARS.format('smiles')} AS stars, count(*) AS n FROM structures GROUP BY 1",
)
def bare_star_counts(t):
    return D.structures(t.documents).groupBy(S.bare_stars(F.col("smiles")).alias("stars")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "text_keys",
    f"WITH {D.STRUCTURES_SQL} SELECT mol_id, {KEY_SQL.replace('@S@', 'smiles')} AS key, translate(smiles, '/\\@', '') AS flat FROM structures",
)
def text_keys(t):
    """Comparison key of each structure, and the text without any stereo marks."""
    smiles = F.col("smiles")
    return D.structures(t.documents).select(
        "mol_id", S.text_key(smiles).alias("key"), S.strip_stereo(smiles).alias("flat")
    )


@query(
    "structure_checks",
    f"""WITH {D.STRUCTURES_SQL}, marks AS (SELECT mol_id, smiles, list_transform(regexp_extract_all(smiles, '[\\[\\]]'), lambda c: CASE WHEN c = '[' THEN 1 ELSE -1 END) AS s FROM structures)
    SELECT mol_id, len(s) = 0 OR (list_sum(s) = 0 AND list_min(list_transform(range(1, len(s) + 1), lambda i: list_sum(s[1:i]))) >= 0) AS balanced,
      (length(smiles) - length(replace(smiles, '.', '')))::INTEGER AS dots,
      len(list_filter({D.atom_tokens_sql('smiles')}, lambda t: NOT regexp_matches(t, '^\\[\\d*H[+-]?\\d*\\]$')))::INTEGER AS heavy,
      (len(list_filter({D.tokens_sql('smiles')}, lambda t: regexp_matches(t, '^(%\\d\\d|\\d)$'))) // 2)::INTEGER AS rings FROM marks""",
)
def structure_checks(t):
    smiles = F.col("smiles")
    return D.structures(t.documents).select(
        "mol_id", S.brackets_balanced(smiles).alias("balanced"), S.dot_count(smiles).alias("dots"),
        S.heavy_atoms(smiles).alias("heavy"), S.ring_count(smiles).alias("rings"),
    )


@query(
    "bracket_label_rows",
    f"""WITH {D.STRUCTURES_SQL}, lists AS (SELECT mol_id, {D.atom_tokens_sql('smiles')} AS toks FROM structures),
    rows AS (SELECT mol_id, toks, unnest(range(0, len(toks))) AS i FROM lists)
    SELECT mol_id, i::INTEGER AS atom_idx, regexp_replace(toks[i + 1], '^\\[|\\]$', '', 'g') AS label FROM rows WHERE starts_with(toks[i + 1], '[')""",
)
def bracket_label_rows(t):
    rows = D.structures(t.documents).select("mol_id", F.explode(S.bracket_labels(F.col("smiles"))).alias("b"))
    return rows.select("mol_id", "b.atom_idx", "b.label")


CLASS_SQL = (
    f"CASE WHEN label IN {tuple(S.RGROUP_SYMBOLS)!r} THEN 'rgroup' WHEN label IN {tuple(S.ABBREVIATIONS)!r} THEN 'abbreviation' "
    f"WHEN regexp_matches('[' || label || ']', '{BRACKET}') THEN 'element' ELSE 'other' END"
)
EXPAND_SQL = (
    "CASE " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in S.ABBREVIATIONS.items())
    + f" WHEN regexp_matches(label, '^R\\d+$') THEN '[' || label[2:] || '*]' WHEN label IN {tuple(S.RGROUP_SYMBOLS)!r} THEN '*' ELSE '[' || label || ']' END"
)
PART_WORDS_SQL = "SELECT unnest(string_split(p_name || ' ' || p_brand || ' R' || p_size || ' Me Ts CO2H Ar ' || upper(p_type[1]) || lower(p_type[2]), ' ')) AS label FROM part"


def part_words(t):
    mixed = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1)))
    text = F.concat_ws(
        " ", "p_name", "p_brand", F.concat(F.lit("R"), F.col("p_size")), F.lit("Me Ts CO2H Ar"), mixed
    )
    return t.part.select(F.explode(F.split(text, " ")).alias("label"))


@query("label_classes", f"SELECT label, {CLASS_SQL} AS kind, count(*) AS n FROM ({PART_WORDS_SQL}) GROUP BY 1, 2")
def label_classes(t):
    words = part_words(t)
    return words.groupBy("label", S.classify_label(F.col("label")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("expanded_labels", f"SELECT label, {EXPAND_SQL} AS fragment, count(*) AS n FROM ({PART_WORDS_SQL}) GROUP BY 1, 2")
def expanded_labels(t):
    """Shorthand labels written out."""
    words = part_words(t).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return words.select("label", S.expand_abbreviation(F.col("label")).alias("fragment"), "n")


@query("masked_labels")
def masked_labels(t):
    """Labels swapped for isotopes, with the map back; checked against a plain loop in the tests."""
    parts = S.mask_labels(F.col("smiles"))
    alias = S.alias_labels(F.col("smiles"))
    return D.structures(t.documents).select("mol_id", "smiles", parts.alias("p"), alias.alias("a")).select(
        "mol_id", "smiles", "p.masked", F.to_json("p.mapping").alias("mapping"),
        F.col("a.masked").alias("aliased"), F.to_json("a.mapping").alias("aliases"),
    )


ESTRING_SQL = f"""WITH {D.ESTRINGS_SQL},
parts AS (SELECT mol_id, estring, contains(estring, '<sep>') AS sep, split_part(estring, '<sep>', 1) AS backbone,
  trim(regexp_extract(estring, '(?s)<sep>(.*)$', 1)) AS tail FROM estrings),
tagged AS (SELECT *, regexp_extract_all(tail, '<a>(\\d+):(.+?)</a>', 1) AS nums, regexp_extract_all(tail, '<a>(\\d+):(.+?)</a>', 2) AS labs FROM parts),
cats AS (SELECT *, CASE WHEN NOT sep THEN 'drop_tag' WHEN tail = '' THEN 'pure' WHEN regexp_matches(tail, '</?r>|</?c>|\\?') THEN 'drop_tag'
  WHEN len(nums) = 0 THEN 'pure' ELSE 'wild' END AS cat, {D.tokens_sql('backbone')} AS toks, {D.atom_tokens_sql('backbone')} AS ats,
  list_transform(nums, lambda n: n::INTEGER) AS idx,
  list_transform(labs, lambda l: CASE WHEN regexp_replace(regexp_replace(l, '\\[(\\w+)\\]', '\\1', 'g'), '''+$', '') IN ('<dum>', 'dum', '') THEN 'R'
    ELSE regexp_replace(regexp_replace(l, '\\[(\\w+)\\]', '\\1', 'g'), '''+$', '') END) AS lab FROM tagged),
written AS (SELECT *, CASE WHEN cat = 'pure' THEN backbone WHEN cat = 'wild' AND list_max(idx) < len(ats) THEN
  array_to_string(list_transform(toks, lambda t, i: CASE WHEN t = '*' AND list_contains(idx, len(list_filter(toks[1:i - 1], lambda x: {D.IS_ATOM_SQL.format('x')})))
    THEN '[' || lab[list_position(idx, len(list_filter(toks[1:i - 1], lambda x: {D.IS_ATOM_SQL.format('x')})))] || ']' ELSE t END), '') END AS smiles FROM cats)
"""


@query(
    "converted_estrings",
    ESTRING_SQL + "SELECT mol_id, smiles, CASE WHEN cat = 'wild' AND smiles IS NULL THEN 'fail' ELSE cat END AS category FROM written",
)
def converted_estrings(t):
    return J.convert_estrings(D.estrings(t.documents), "mol_id", "estring")


@query(
    "estring_categories",
    ESTRING_SQL + "SELECT CASE WHEN cat = 'wild' AND smiles IS NULL THEN 'fail' ELSE cat END AS category, count(*) AS n FROM written GROUP BY 1",
)
def estring_categories(t):
    converted = J.convert_estrings(D.estrings(t.documents), "mol_id", "estring")
    return converted.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "inline_labels",
    f"""WITH {D.STRUCTURES_SQL}, noted AS (SELECT mol_id, replace(smiles, '[2*]', 'C') || ' $' || array_to_string(labels, ';;') || ';$ ext' AS note FROM structures),
    parts AS (SELECT mol_id, split_part(note, ' ', 1) AS s, list_filter(string_split(regexp_extract(note, '\\$(.*)\\$', 1), ';'), lambda x: x <> '') AS ls FROM noted),
    cut AS (SELECT *, string_split(s, '*') AS ps FROM parts)
    SELECT mol_id, CASE WHEN len(ps) = 1 THEN s WHEN len(ls) >= len(ps) - 1 THEN array_to_string(list_transform(ps, lambda p, i: CASE WHEN i = 1 THEN p ELSE '[' || ls[i - 1] || ']' || p END), '') END AS smiles FROM cut""",
)
def inline_labels(t):
    """Stars take the labels of a trailing annotation."""
    base = F.replace(F.col("smiles"), F.lit("[2*]"), F.lit("C"))
    note = F.concat(base, F.lit(" $"), F.array_join("labels", ";;"), F.lit(";$ ext"))
    return D.structures(t.documents).select("mol_id", S.inline_labels(note).alias("smiles"))


@query(
    "label_topk",
    f"""WITH {D.STRUCTURES_SQL}, c AS (SELECT label, count(*) AS n FROM (SELECT unnest(regexp_extract_all(smiles, '\\[([^\\]]+)\\]', 1)) AS label FROM structures) GROUP BY 1)
    SELECT label, n, (SELECT sum(n)::BIGINT FROM c) AS total, (SELECT count(*) FROM c) AS unique_labels FROM c ORDER BY n DESC, label LIMIT 30""",
)
def label_topk(t):
    return A.label_distribution(D.structures(t.documents), S.bracket_contents(F.col("smiles")), 30)


PAIR_SQL = (
    LABELLED_SQL
    + """,
pairs AS (SELECT mol_id, smiles AS raw, CASE h0 % 50 WHEN 3 THEN smiles WHEN 4 THEN norm || '[r1]' WHEN 5 THEN norm || ']' WHEN 6 THEN replace(norm, '.', '') ELSE norm END AS norm FROM filled)"""
)


def audited(t):
    """Normalised corpus with planted faults against the raw one."""
    base = labelled(t)
    h = F.col("h0") % 50
    faulty = (
        F.when(h == 3, F.col("smiles"))
        .when(h == 4, F.concat("norm", F.lit("[r1]")))
        .when(h == 5, F.concat("norm", F.lit("]")))
        .when(h == 6, F.replace(F.col("norm"), F.lit("."), F.lit("")))
        .otherwise(F.col("norm"))
    )
    raw = base.select("mol_id", "smiles")
    return A.audit_pair(raw, base.select("mol_id", faulty.alias("smiles")), "mol_id")


BALANCE = "(len({0}) = 0 OR (list_sum({0}) = 0 AND list_min(list_transform(range(1, len({0}) + 1), lambda i: list_sum({0}[1:i]))) >= 0))"


@query(
    "audit_counts",
    f"""WITH {PAIR_SQL},
    m AS (SELECT *, raw IS DISTINCT FROM norm AS changed, list_transform(regexp_extract_all(raw, '[\\[\\]]'), lambda c: CASE WHEN c = '[' THEN 1 ELSE -1 END) AS rs,
      list_transform(regexp_extract_all(norm, '[\\[\\]]'), lambda c: CASE WHEN c = '[' THEN 1 ELSE -1 END) AS ns,
      regexp_extract_all(raw, '\\[([^\\]]+)\\]', 1) AS rl, list_distinct(regexp_extract_all(norm, '\\[([^\\]]+)\\]', 1)) AS nl FROM pairs)
    SELECT count(*) AS n_rows, 0::BIGINT AS count_mismatch, count(*) FILTER (changed) AS changed, count(*) FILTER (changed AND {STARS.format('norm')} > 0) AS residual_star,
      count(*) FILTER (changed AND NOT {BALANCE.format('ns')} AND {BALANCE.format('rs')}) AS broken_brackets,
      count(*) FILTER (changed AND length(raw) - length(replace(raw, '.', '')) <> length(norm) - length(replace(norm, '.', ''))) AS fragments_changed,
      coalesce(sum(len(list_filter(nl, lambda l: NOT list_contains(rl, l) AND NOT regexp_matches(l, '^\\p{{Lu}}[\\p{{L}}\\p{{N}}]{{0,5}}$')))) FILTER (changed), 0)::BIGINT AS invalid_labels FROM m""",
)
def audit_counts(t):
    return A.audit_counts(audited(t))


@query(
    "audit_new_labels",
    f"""WITH {PAIR_SQL}, l AS (SELECT mol_id, regexp_extract_all(raw, '\\[([^\\]]+)\\]', 1) AS rl, list_distinct(regexp_extract_all(norm, '\\[([^\\]]+)\\]', 1)) AS nl FROM pairs)
    SELECT mol_id, array_to_string(list_sort(list_filter(nl, lambda x: NOT list_contains(rl, x))), ',') AS added, len(list_filter(nl, lambda x: NOT list_contains(rl, x))) = 0 AS subset FROM l""",
)
def audit_new_labels(t):
    """Labels a row gained, and whether its label set stayed a subset."""
    added = A.new_labels(F.col("raw"), F.col("norm"))
    return audited(t).select(
        "mol_id", F.array_join(F.sort_array(added), ",").alias("added"), (F.size(added) == 0).alias("subset")
    )


@query(
    "first_changed_rows",
    f"WITH {PAIR_SQL} SELECT mol_id, raw, norm FROM pairs WHERE raw IS DISTINCT FROM norm ORDER BY mol_id LIMIT 20",
)
def first_changed_rows(t):
    """First changed rows, for reading."""
    return audited(t).filter("changed").orderBy("mol_id").limit(20).select("mol_id", "raw", "norm")


@query(
    "fallback_outcomes",
    f"""WITH {LABELLED_SQL},
    bad AS (SELECT *, CASE h0 % 20 WHEN 7 THEN replace(norm, '[R]', '[Q]') WHEN 8 THEN norm || 'C' ELSE norm END AS n2 FROM filled),
    toks AS (SELECT *, {D.tokens_sql('renamed')} AS ta, {D.tokens_sql('n2')} AS tb FROM bad),
    act AS (SELECT *, CASE WHEN len(ta) = len(tb) THEN list_transform(list_filter(range(1, len(ta) + 1), lambda i: ta[i] = '*' AND regexp_matches(tb[i], '^\\[.*\\]$')), lambda i: regexp_replace(tb[i], '^\\[|\\]$', '', 'g')) END AS actual FROM toks)
    SELECT CASE WHEN stars = 0 THEN 'no_marker'
      WHEN NOT usable THEN CASE WHEN {STARS.format('n2')} = 0 AND coalesce(len(list_filter(actual, lambda x: x <> 'R')) = 0, false) THEN 'fallback_ok' ELSE 'fallback_broken' END
      WHEN actual IS NULL THEN 'token_mismatch' WHEN actual = labels THEN 'match' WHEN list_sort(actual) = list_sort(labels) THEN 'order_only' ELSE 'mismatch' END AS outcome, count(*) AS n
    FROM act GROUP BY 1""",
)
def fallback_outcomes(t):
    base = labelled(t)
    h = F.col("h0") % 20
    faulty = (
        F.when(h == 7, F.replace(F.col("norm"), F.lit("[R]"), F.lit("[Q]")))
        .when(h == 8, F.concat("norm", F.lit("C")))
        .otherwise(F.col("norm"))
    )
    checked = A.fallback_audit(base.withColumn("norm", faulty), "smiles", "norm", "labels")
    return checked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "formula_parts",
    "SELECT p_partkey, part, coalesce(try_cast(cnt AS INTEGER), 1) AS count FROM (SELECT p_partkey, unnest(regexp_extract_all(f, '(\\([^()]*\\)|Me|Ts|[A-Z][a-z]+|[A-Z])([0-9]*)', 1)) AS part, "
    "unnest(regexp_extract_all(f, '(\\([^()]*\\)|Me|Ts|[A-Z][a-z]+|[A-Z])([0-9]*)', 2)) AS cnt FROM (SELECT p_partkey, 'C' || p_size || 'H' || (2 * p_size) || 'O(MeO2)' || (p_partkey % 9) || 'Ts' || 'Cl3' AS f FROM part))",
)
def formula_parts(t):
    """Formula text to parts with subscripts; a nested group stays one part."""
    text = F.concat(
        F.lit("C"), F.col("p_size"), F.lit("H"), F.col("p_size") * 2, F.lit("O(MeO2)"), F.col("p_partkey") % 9, F.lit("TsCl3")
    )
    return t.part.select("p_partkey", F.inline(S.formula_parts(text)))


@query(
    "readable_structures",
    f"WITH RECURSIVE {D.VALID_SQL} SELECT source, count(*) AS offered, count(valid.mol_id) AS readable, count(*) - count(valid.mol_id) AS failed "
    "FROM structures LEFT JOIN valid USING (mol_id) GROUP BY source",
)
def readable_structures(t):
    """Structures offered, readable and failed, per source."""
    rows = D.structures(t.documents).select("source", S.is_valid_structure(F.col("smiles")).alias("ok"))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("offered"), F.count_if("ok").alias("readable"))
    return counts.select("source", "offered", "readable", (F.col("offered") - F.col("readable")).alias("failed"))
