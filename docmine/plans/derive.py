"""Domain tables derived from the given ones, so that every query grows with its input.

Documents give lines, words, structure strings, annotated strings, molecule blocks and
page layouts; line items give candidate groups. The derivations use md5 values only,
so SQL can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmine.functions import structures as S
from docmine.functions.runs import ROWS, md5_heads, word_places
from docmine.functions.text import hash_int

WORDS_PER_STRUCTURE = 12
#: Runs that an array of words can hold at most: fewer than 2**31 words of twelve each.
RUNS = 1 << 28
# Fragments a word can stand for, and labels for bare stars.
FRAGMENTS = (
    "C", "CC", "N", "O", "c1ccccc1", "C(=O)O", "*", "[2*]", "Cl", "Br", "[NH3+]",
    "C%12CCCCC%12", "F/C=C/F", ".", "S(=O)(=O)C", "[R]", "[Ar]", "[C@@H](C)", "[CH3:1]",
    "C#N", "[X]", "[5*]", "n1cccc1", "C1CC2CCC1C2",
)
STAR_LABELS = ("R", "R1", "X", "Ar", "Q", "r1", "Hal", "R5.")
PAGE_WIDTH = 2550
PAGE_HEIGHT = 3300
LINES_PER_PAGE = 12


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def doc_lines(documents: DataFrame) -> DataFrame:
    """One row per text line: (doc_id, line_id, text, lang, source)."""
    return documents.select(
        "doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_id", "text")
    )


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def structures(documents: DataFrame) -> DataFrame:
    """Every run of twelve words becomes one structure string with its star labels."""
    # Dealt out first: a file of few row groups would keep all that follows in as many tasks.
    dealt = documents.select("doc_id", "source", "text").repartition("doc_id")
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    schema = f"mol_id long, doc_id {kinds['doc_id']}, source {kinds['source']}, smiles string, labels array<string>, h0 long"
    return dealt.mapInArrow(_structure_rows, schema)


#: What a hash modulo 97 stands for, as one run of bytes with the start and size of every part.
_PARTS = [("[", "(")[k] if k < 2 else FRAGMENTS[k % 24] for k in range(97)]
_PART_BYTES = np.frombuffer("".join(_PARTS).encode(), np.uint8)
_PART_SIZES = np.array([len(p) for p in _PARTS])
_PART_STARTS = np.cumsum(_PART_SIZES) - _PART_SIZES
_IS_STAR = np.array([p == "*" for p in _PARTS])


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def _structure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    star_labels = pa.array(STAR_LABELS)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            data, starts, ends, first = word_places(part.column(2).to_pylist())
            h = md5_heads(data, starts, ends)
            counts = np.diff(first)
            each = -(-counts // WORDS_PER_STRUCTURE)
            owner = np.repeat(np.arange(len(counts)), each)
            run = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
            heads = first[:-1][owner] + run * WORDS_PER_STRUCTURE
            kind = h % 97
            size = _PART_SIZES[kind]
            places = _offsets(size)
            spread = np.arange(places[-1]) + np.repeat(_PART_STARTS[kind] - places[:-1], size)
            cuts = np.append(heads, len(h))
            smiles = pa.StringArray.from_buffers(len(heads), pa.py_buffer(places[cuts]), pa.py_buffer(_PART_BYTES[spread]))
            star = _IS_STAR[kind]
            labels = pa.ListArray.from_arrays(pa.array(_offsets(star)[cuts]), star_labels.take(pa.array(h[star] // 97 % 8)))
            # Without the text, which would be written once per run of its own words.
            mine = part.select(["doc_id", "source"]).take(pa.array(owner, pa.int64()))
            mol_id = pc.add(pc.multiply(mine.column(0).cast(pa.int64()), RUNS), pa.array(run, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [mol_id, mine.column(0), mine.column(1), smiles, labels, pa.array(h[heads], pa.int64())],
                names=["mol_id", "doc_id", "source", "smiles", "labels", "h0"],
            )


# SQL twin of the derivation; DuckDB lambda syntax.
STRUCTURES_SQL = f"""
doc_words AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS words
  FROM documents),
runs AS (
  SELECT doc_id, source, words, unnest(range(0, len(words), {WORDS_PER_STRUCTURE})) AS start
  FROM doc_words WHERE len(words) > 0),
hashed AS (
  SELECT doc_id * {RUNS} + start // {WORDS_PER_STRUCTURE} AS mol_id, doc_id, source,
    list_transform(words[start + 1 : start + {WORDS_PER_STRUCTURE}],
      lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT) AS h
  FROM runs),
structures AS (
  SELECT mol_id, doc_id, source, h[1] AS h0,
    array_to_string(list_transform(h, lambda x: CASE WHEN x % 97 = 0 THEN '[' WHEN x % 97 = 1 THEN '('
      ELSE {list(FRAGMENTS)!r}[((x % 97) % 24 + 1)::INT] END), '') AS smiles,
    list_transform(list_filter(h, lambda x: x % 97 > 1 AND (x % 97) % 24 = 6),
      lambda x: {list(STAR_LABELS)!r}[((x // 97) % 8 + 1)::INT]) AS labels
  FROM hashed)"""


def estrings(documents: DataFrame) -> DataFrame:
    """Annotated strings; the tail is chosen by the first word's hash."""
    base = structures(documents)
    kind = F.floor(F.col("h0") / 11) % 8
    tail = (
        F.when(kind == 0, "<sep>")
        .when(kind == 1, "<sep><a>0:R[1]</a>")
        .when(kind == 2, "<sep><a>0:<dum></a><a>3:X'</a>")
        .when(kind == 3, "<sep><a>99:R</a>")
        .when(kind == 4, "<sep><r>0:R</r>")
        .when(kind == 5, "")
        .when(kind == 6, "<sep><a>1:Ar</a><a>2:Q[2]</a>")
        .otherwise("<sep><b>note</b>")
    )
    return base.select("mol_id", "smiles", F.concat("smiles", tail).alias("estring"))


ESTRINGS_SQL = (
    STRUCTURES_SQL
    + """,
estrings AS (
  SELECT mol_id, smiles, smiles || CASE (h0 // 11) % 8
    WHEN 0 THEN '<sep>' WHEN 1 THEN '<sep><a>0:R[1]</a>'
    WHEN 2 THEN '<sep><a>0:<dum></a><a>3:X''</a>' WHEN 3 THEN '<sep><a>99:R</a>'
    WHEN 4 THEN '<sep><r>0:R</r>' WHEN 5 THEN '' WHEN 6 THEN '<sep><a>1:Ar</a><a>2:Q[2]</a>'
    ELSE '<sep><b>note</b>' END AS estring FROM structures)"""
)


def by_molecule(documents: DataFrame) -> DataFrame:
    """(mol_id, smiles) dealt out by molecule: whatever is grouped by molecule later stays where
    it is, so that structures are shuffled and not their atoms and bonds."""
    return structures(documents).select("mol_id", "smiles").repartition("mol_id")


def atoms(documents: DataFrame) -> DataFrame:
    """Atom tokens of each structure with hashed places and charges."""
    base = by_molecule(documents).select("mol_id", F.posexplode(S.atom_tokens(F.col("smiles"))).alias("idx", "token"))
    h = hash_int(F.concat_ws(":", F.col("mol_id"), F.col("idx")))
    staged = base.withColumn("h", h)
    inner = F.regexp_replace("token", r"^\[|\]$", "")
    symbol = F.when(F.col("token").startswith("["), F.regexp_extract(inner, r"([A-Z][a-z]?|\*)", 1)).otherwise(
        F.initcap("token")
    )
    isotope = F.coalesce(F.nullif(F.regexp_extract(inner, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    return staged.select(
        "mol_id",
        "idx",
        symbol.alias("symbol"),
        F.when(F.col("token").startswith("["), isotope).otherwise(0).alias("isotope"),
        F.when(F.col("h") % 13 == 0, 1).when(F.col("h") % 13 == 1, -1).otherwise(0).alias("charge"),
        F.when(F.col("h") % 5 == 0, (F.floor(F.col("h") / 5) % 4).cast("int")).otherwise(0).alias("explicit_h"),
        F.when(F.col("h") % 17 == 0, 1).otherwise(0).alias("map_num"),
        ((F.col("h") % 1000) / 10.0).alias("x"),
        ((F.floor(F.col("h") / 1000) % 1000) / 10.0).alias("y"),
    )


TOKENS_SQL = "regexp_extract_all({}, '{}', 1)"
TOKEN_RE_SQL = S.TOKEN_PATTERN
IS_ATOM_SQL = "regexp_matches({0}, '^(\\p{{L}}+$|\\[|\\*$)')"


def tokens_sql(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN_RE_SQL}', 1)"


def atom_tokens_sql(expr: str) -> str:
    return f"list_filter({tokens_sql(expr)}, lambda t: {IS_ATOM_SQL.format('t')})"


ATOMS_SQL = (
    STRUCTURES_SQL
    + f""",
atom_lists AS (SELECT mol_id, {atom_tokens_sql('smiles')} AS toks FROM structures),
atom_rows AS (SELECT mol_id, toks, unnest(range(0, len(toks))) AS idx FROM atom_lists),
atom_hash AS (
  SELECT mol_id, idx::INTEGER AS idx, toks[idx + 1] AS token,
    ('0x' || substr(md5(mol_id || ':' || idx), 1, 8))::BIGINT AS h FROM atom_rows),
atoms AS (
  SELECT mol_id, idx,
    CASE WHEN starts_with(token, '[') THEN regexp_extract(regexp_replace(token, '^\\[|\\]$', '', 'g'), '([A-Z][a-z]?|\\*)', 1)
      ELSE upper(token[1]) || token[2:] END AS symbol,
    CASE WHEN starts_with(token, '[') THEN coalesce(try_cast(regexp_extract(token, '^\\[(\\d+)', 1) AS INTEGER), 0) ELSE 0 END AS isotope,
    (CASE h % 13 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END)::INTEGER AS charge,
    (CASE WHEN h % 5 = 0 THEN (h // 5) % 4 ELSE 0 END)::INTEGER AS explicit_h,
    (CASE WHEN h % 17 = 0 THEN 1 ELSE 0 END)::INTEGER AS map_num,
    (h % 1000) / 10.0::DOUBLE AS x, ((h // 1000) % 1000) / 10.0::DOUBLE AS y
  FROM atom_hash)"""
)


def bonds(documents: DataFrame) -> DataFrame:
    """Chain bonds between neighbours, a few left out, and some ring bonds five ahead."""
    counted = structures(documents).select("mol_id", S.count_atoms(F.col("smiles")).alias("n"))
    # Like ``by_molecule``, with one byte per atom pair to shuffle instead of the structure.
    dealt = counted.mapInArrow(_bond_slots, "mol_id long, slots array<tinyint>").repartition("mol_id")
    at = dealt.select("mol_id", F.posexplode("slots").alias("u", "slot"))
    both = at.select(
        "mol_id",
        "u",
        F.explode(
            F.array(
                F.when(F.col("slot") % 8 > 0, F.struct((F.col("u") + 1).alias("v"), (F.col("slot") % 8).cast("int").alias("code"))),
                F.when(F.col("slot") >= 8, F.struct((F.col("u") + 5).alias("v"), F.lit(1).alias("code"))),
            )
        ).alias("b"),
    ).filter("b is not null")
    return both.select("mol_id", "u", F.col("b.v").alias("v"), F.col("b.code").alias("code"))


def _bond_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number for every atom but the last: the code of the chain bond that starts there or 0,
    and 8 more where a ring bond starts."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64 * ROWS):
            part = batch.slice(at, 64 * ROWS)
            n = part.column(1).to_numpy().astype(np.int64)
            sizes = np.maximum(n - 1, 0)
            owner, cuts = np.repeat(np.arange(len(n)), sizes), _offsets(sizes)
            u = np.arange(len(owner)) - cuts[:-1][owner]
            mol_id = part.column(0).cast(pa.string()).take(pa.array(owner))
            text = pc.binary_join_element_wise(mol_id, pa.array(u).cast(pa.string()), "-")
            ends = np.frombuffer(text.buffers()[1], np.int32, len(u) + 1)
            h = md5_heads(np.frombuffer(text.buffers()[2] or b"", np.uint8), ends[:-1], ends[1:])
            code = np.where(h % 10 < 6, 1, h % 10 - 4)
            slots = np.where(h % 7 != 0, code, 0) + np.where((h % 11 == 0) & (u + 5 < n[owner]), 8, 0)
            listed = pa.ListArray.from_arrays(pa.array(cuts), pa.array(slots.astype(np.int8)))
            yield pa.RecordBatch.from_arrays([part.column(0), listed], names=["mol_id", "slots"])


BONDS_SQL = (
    ATOMS_SQL
    + """,
bond_slots AS (
  SELECT mol_id, n, u, ('0x' || substr(md5(mol_id || '-' || u), 1, 8))::BIGINT AS h
  FROM (SELECT mol_id, len(toks) AS n, unnest(range(0, len(toks) - 1)) AS u FROM atom_lists)),
bonds AS (
  SELECT mol_id, u::INTEGER AS u, (u + 1)::INTEGER AS v,
    (CASE WHEN h % 10 < 6 THEN 1 ELSE h % 10 - 4 END)::INTEGER AS code FROM bond_slots WHERE h % 7 <> 0
  UNION ALL
  SELECT mol_id, u::INTEGER, (u + 5)::INTEGER, 1 FROM bond_slots WHERE h % 11 = 0 AND u + 5 < n)"""
)


def layout_lines(documents: DataFrame) -> DataFrame:
    """Text lines placed in two columns, twelve lines to a page."""
    lines = doc_lines(documents).withColumn(
        "h", hash_int(F.concat_ws("/", F.col("doc_id"), F.col("line_id")))
    )
    slot = F.col("line_id") % LINES_PER_PAGE
    text = (
        F.when(F.col("h") % 9 == 0, F.concat(F.lit("What is claimed is: "), F.col("text")))
        .when(F.col("h") % 9 == 1, F.concat(F.lit("2. "), F.col("text")))
        .when(F.col("h") % 41 == 2, F.concat(F.col("text"), F.lit(" polypeptide")))
        .otherwise(F.col("text"))
    )
    x0 = F.when(slot < 6, 200).otherwise(1300) + F.col("h") % 60
    y0 = 300 + (slot % 6) * 110 + F.floor(F.col("h") / 60) % 40
    width = F.when(F.col("h") % 6 == 0, 30).otherwise(500 + F.floor(F.col("h") / 7) % 500)
    placed = lines.select(
        "doc_id",
        F.floor(F.col("line_id") / LINES_PER_PAGE).cast("int").alias("page_index"),
        slot.cast("int").alias("line_id"),
        text.alias("text"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        width.alias("w"),
    )
    return placed.select(
        "doc_id", "page_index", "line_id", "text", "x0", "y0",
        (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 30).alias("y1"),
    )


def layout_blocks(documents: DataFrame) -> DataFrame:
    """Image, text and formula blocks hung on some line places."""
    lines = doc_lines(documents).withColumn(
        "h", hash_int(F.concat_ws("#", F.col("doc_id"), F.col("line_id")))
    ).filter(F.col("h") % 3 == 0)
    slot = F.col("line_id") % LINES_PER_PAGE
    k = F.floor(F.col("h") / 3)
    x0 = F.when(slot < 6, 210).otherwise(1310) + k % 50
    y0 = 340 + (slot % 6) * 110 + F.floor(k / 50) % 30
    width = F.when(k % 8 == 0, 1400).otherwise(600 + k % 300)
    placed = lines.select(
        "doc_id",
        F.floor(F.col("line_id") / LINES_PER_PAGE).cast("int").alias("page_index"),
        slot.cast("int").alias("block_id"),
        F.when(k % 5 == 4, "formula").when(k % 5 == 3, "text").otherwise("image").alias("label"),
        F.when(F.floor(k / 5) % 2 == 0, "R1 ring").otherwise("ring").alias("content"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        width.alias("w"),
    )
    return placed.select(
        "doc_id", "page_index", "block_id", "label", "content", "x0", "y0",
        (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + 60).alias("y1"),
    )


LAYOUT_SQL = f"""
doc_lines AS (
  SELECT doc_id, i AS line_id, ls[i + 1] AS text,
    ('0x' || substr(md5(doc_id || '/' || i), 1, 8))::BIGINT AS h,
    ('0x' || substr(md5(doc_id || '#' || i), 1, 8))::BIGINT AS g
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
layout_lines AS (
  SELECT doc_id, (line_id // {LINES_PER_PAGE})::INTEGER AS page_index, (line_id % {LINES_PER_PAGE})::INTEGER AS line_id,
    CASE WHEN h % 9 = 0 THEN 'What is claimed is: ' || text WHEN h % 9 = 1 THEN '2. ' || text
      WHEN h % 41 = 2 THEN text || ' polypeptide' ELSE text END AS text,
    x0, y0, x0 + w AS x1, y0 + 30 AS y1
  FROM (SELECT *, ((CASE WHEN line_id % {LINES_PER_PAGE} < 6 THEN 200 ELSE 1300 END) + h % 60)::DOUBLE AS x0,
    (300 + (line_id % {LINES_PER_PAGE} % 6) * 110 + (h // 60) % 40)::DOUBLE AS y0,
    (CASE WHEN h % 6 = 0 THEN 30 ELSE 500 + (h // 7) % 500 END)::DOUBLE AS w FROM doc_lines)),
layout_blocks AS (
  SELECT doc_id, (line_id // {LINES_PER_PAGE})::INTEGER AS page_index, (line_id % {LINES_PER_PAGE})::INTEGER AS block_id,
    CASE WHEN k % 5 = 4 THEN 'formula' WHEN k % 5 = 3 THEN 'text' ELSE 'image' END AS label,
    CASE WHEN (k // 5) % 2 = 0 THEN 'R1 ring' ELSE 'ring' END AS content,
    x0, y0, x0 + w AS x1, y0 + 60 AS y1
  FROM (SELECT *, ((CASE WHEN line_id % {LINES_PER_PAGE} < 6 THEN 210 ELSE 1310 END) + k % 50)::DOUBLE AS x0,
    (340 + (line_id % {LINES_PER_PAGE} % 6) * 110 + (k // 50) % 30)::DOUBLE AS y0,
    (CASE WHEN k % 8 = 0 THEN 1400 ELSE 600 + k % 300 END)::DOUBLE AS w
    FROM (SELECT *, g // 3 AS k FROM doc_lines WHERE g % 3 = 0)))"""


def candidates(lineitem: DataFrame) -> DataFrame:
    """Line items as sampled candidates of their order."""
    return lineitem.select(
        F.col("l_orderkey").alias("image_id"),
        line_key(lineitem).alias("sample_key"),
        (-F.col("l_quantity")).alias("log_prob"),
        (F.col("l_returnflag") != "R").alias("valid"),
        (F.col("l_discount") * 10).alias("sim"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)).alias("exact"),
    )


def line_key(lineitem: DataFrame) -> Column:
    """Text key of a line item; equal keys are fully interchangeable rows."""
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return F.concat_ws(
        "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"),
        "l_returnflag", "l_linestatus",
    )


LINE_KEY_SQL = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 100)::BIGINT, "
    "round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, "
    "l_returnflag, l_linestatus)"
)
CANDIDATES_SQL = f"""
candidates AS (
  SELECT l_orderkey AS image_id, {LINE_KEY_SQL} AS sample_key, -l_quantity AS log_prob,
    l_returnflag <> 'R' AS valid, l_discount * 10 AS sim, l_linestatus = 'F' AND l_tax = 0 AS exact
  FROM lineitem)"""



# The same reading in SQL, one row per mark: a string each for open branches and open rings.
VALID_SQL = (
    STRUCTURES_SQL
    + f""",
marked AS (SELECT mol_id, smiles, regexp_extract_all(smiles, '{S.MARK_PATTERN}', 1) AS ms FROM structures),
kinds AS (SELECT mol_id, list_transform(ms, lambda m: CASE WHEN m = '(' THEN 'open' WHEN m = ')' THEN 'close' WHEN m = '.' THEN 'dot'
    WHEN m IN ('-', '=', '#', '$', ':', '/', '\\', '~') THEN 'bond' WHEN regexp_matches(m, '^[0-9%]') THEN 'ring' ELSE 'atom' END) AS ks,
  list_transform(ms, lambda m: CASE WHEN regexp_matches(m, '^[0-9%]') THEN ltrim(replace(m, '%', ''), '0') END) AS ns,
  smiles <> '' AND array_to_string(ms, '') = smiles AS whole FROM marked),
reading(mol_id, i, ok, last, atoms, here, branches, rings) AS (
  SELECT mol_id, 0, whole, 'start', 0, 0, []::INT[], ''::VARCHAR FROM kinds
  UNION ALL
  SELECT r.mol_id, i + 1,
    ok AND CASE k WHEN 'atom' THEN true WHEN 'bond' THEN last IN ('atom', 'ring', 'close', 'open')
      WHEN 'ring' THEN (last IN ('atom', 'ring', 'close') OR (last = 'bond' AND here > 0)) AND NOT contains(rings, ';' || n || '@' || here || ';')
      WHEN 'close' THEN last IN ('atom', 'ring', 'close') AND len(branches) > 0 ELSE last IN ('atom', 'ring', 'close') END,
    k, atoms + (k = 'atom')::INT,
    CASE WHEN k = 'atom' THEN atoms + 1 WHEN k = 'close' AND len(branches) > 0 THEN branches[-1] ELSE here END,
    CASE WHEN k = 'open' THEN list_append(branches, here) WHEN k = 'close' AND len(branches) > 0 THEN branches[1 : len(branches) - 1] ELSE branches END,
    CASE WHEN k <> 'ring' THEN rings WHEN contains(rings, ';' || n || '@') THEN regexp_replace(rings, ';' || n || '@[0-9]+;', '') ELSE rings || ';' || n || '@' || here || ';' END
  FROM (SELECT reading.*, ks[i + 1] AS k, ns[i + 1] AS n FROM reading JOIN kinds USING (mol_id) WHERE i < len(ks) AND ok) r),
valid AS (SELECT mol_id FROM reading JOIN kinds USING (mol_id)
  WHERE i = len(ks) AND ok AND last IN ('atom', 'ring', 'close') AND len(branches) = 0 AND rings = '')"""
)
