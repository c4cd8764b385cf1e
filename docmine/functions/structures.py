"""Structure strings: tokens, labels, annotations and checks, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmine.functions.binding import let
from docmine.functions.runs import remembered

# The published atom-wise token pattern, label symbols, element symbols
# and shorthand fragments.
TOKEN_PATTERN = (
    r"(\[[^\]]+\]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9])"
)
# The same tokens with single characters as a class, which is matched in one step; and those
# among them that are atoms: no other token holds a letter, a star or a bracket block.
TOKENS = r"(\[[^\]]+\]|Br?|Cl?|[NOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]|%[0-9]{2})"
_ATOMS = r"(\[[^\]]+\]|Br?|Cl?|[NOSPFIbcnosp*])"
PIECE_PATTERN = r"(\[[^\]]*\]?|[^\[])"
RGROUP_SYMBOLS = (
    "R R1 R2 R3 R4 R5 R6 R7 R8 R9 R10 R11 R12 Ra Rb Rc Rd X Y Z Q A E Ar"
).split()
ORGANIC_SYMBOLS = "C N O S P F Cl Br I *".split()
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn "
    "Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce "
    "Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn "
    "Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl "
    "Mc Lv Ts Og"
).split()
ABBREVIATIONS = {
    "NO2": "[N+](=O)[O-]", "O2N": "[N+](=O)[O-]", "CHO": "[CH1](=O)", "OHC": "[CH1](=O)",
    "CO2Et": "[C](=O)OCC", "COOEt": "[C](=O)OCC", "OAc": "[O]C(=O)C", "NHAc": "[NH]C(=O)C",
    "Ac": "[C](=O)C", "OBz": "[O]C(=O)c1ccccc1", "Bz": "[C](=O)c1ccccc1",
    "OBn": "[O]Cc1ccccc1", "Bn": "[CH2]c1ccccc1", "NHBoc": "[NH1]C(=O)OC(C)(C)C",
    "NBoc": "[NH1]C(=O)OC(C)(C)C", "Boc": "[C](=O)OC(C)(C)C", "Cbm": "[C](=O)N",
    "Cbz": "[C](=O)OCc1ccccc1", "Cy": "[CH1]1CCCCC1",
    "Fmoc": "[C](=O)OCC1c(cccc2)c2c3c1cccc3", "Mes": "[c]1c(C)cc(C)cc(C)1",
    "OMs": "[O]S(=O)(=O)C", "Ms": "[S](=O)(=O)C", "Ph": "[c]1ccccc1",
    "PMB": "[CH2]c1ccc(OC)cc1", "Py": "[c]1ncccc1", "SEM": "[CH2]CSi(C)(C)C",
    "Suc": "[C](=O)CCC(=O)O", "TBS": "[Si](C)(C)C(C)(C)C", "TBZ": "[C](=S)c1ccccc1",
    "OTf": "[O]S(=O)(=O)C(F)(F)F", "Tf": "[S](=O)(=O)C(F)(F)F", "TFA": "[C](=O)C(F)(F)F",
    "TMS": "[Si](C)(C)C", "Ts": "[S](=O)(=O)c1ccc(C)cc1", "OMe": "[O]C", "MeO": "[O]C",
    "SMe": "[S]C", "MeS": "[S]C", "NMe": "[NH]C", "MeN": "[NH]C", "Me": "[CH3]",
    "OEt": "[O]CC", "EtO": "[O]CC", "Et": "[CH2]C", "C2H5": "[CH2]C", "Pr": "[CH2]CC",
    "nPr": "[CH2]CC", "n-Pr": "[CH2]CC", "Bu": "[CH2]CCC", "nBu": "[CH2]CCC",
    "n-Bu": "[CH2]CCC", "iPr": "[CH1](C)C", "i-Pr": "[CH1](C)C", "iBu": "[CH2]C(C)C",
    "i-Bu": "[CH2]C(C)C", "OiBu": "[O]CC(C)C", "OtBu": "[O]C(C)(C)C", "tBu": "[C](C)(C)C",
    "t-Bu": "[C](C)(C)C", "CF3": "[C](F)(F)F", "F3C": "[C](F)(F)F", "NCF3": "[NH]C(F)(F)F",
    "F3CN": "[NH]C(F)(F)F", "OCF3": "[O]C(F)(F)F", "F3CO": "[O]C(F)(F)F",
    "CCl3": "[C](Cl)(Cl)Cl", "CO2H": "[C](=O)O", "HO2C": "[C](=O)O", "COOH": "[C](=O)O",
    "CN": "[C]#N", "NC": "[C]#N", "OCH3": "[O]C", "H3CO": "[O]C", "SO3H": "[S](=O)(=O)O",
}
# A bracket atom an element can fill: isotope, symbol, chirality, hydrogens, charge, map.
BRACKET_ATOM = (
    r"^\[\d*(?:" + "|".join(sorted(ELEMENTS, key=lambda e: (-len(e), e)))
    + r"|se|as|te|b|c|n|o|p|s|\*)@{0,2}(?:H\d*)?(?:\+\d*|-\d*|\++|-+)?(?::\d+)?\]$"
)


_FIND_TOKENS = re.compile(TOKENS, re.ASCII)
_FIND_ATOMS = re.compile(_ATOMS, re.ASCII)
_BRACKET_ATOM = re.compile(BRACKET_ATOM, re.ASCII)
_NUMBERED = re.compile(r"\[R(\d+)\]", re.ASCII)


def tokenise(structure: Column) -> Column:
    return F.regexp_extract_all(structure, F.lit(TOKENS), F.lit(1))


def pieces(structure: Column) -> Column:
    """Bracket blocks and single characters; an unclosed bracket runs to the end."""
    return F.regexp_extract_all(structure, F.lit("(?s)" + PIECE_PATTERN), F.lit(1))


def is_atom(token: Column) -> Column:
    return token.rlike(r"^(\p{L}+$|\[|\*$)")


def atom_tokens(structure: Column) -> Column:
    return F.regexp_extract_all(structure, F.lit(_ATOMS), F.lit(1))


def numbered_labels(structure: Column) -> Column:
    """``[n*]`` becomes ``[Rn]``."""
    return F.regexp_replace(structure, r"\[(\d+)\*\]", r"[R$1]")


def quick_normalise(structure: Column) -> Column:
    """Numbered stars become ``[Rn]``, bare stars ``[R]``; text in brackets stays."""
    first = numbered_labels(structure)
    swapped = F.transform(pieces(first), lambda p: F.when(p == "*", "[R]").otherwise(p))
    return F.when(first.contains("*"), F.array_join(swapped, "")).otherwise(first)


_NUMBERED_STAR = re.compile(r"\[(\d+)\*\]", re.ASCII)
_STAR_OR_BLOCK = re.compile(r"(\[[^\]]*\]?)|\*")


def plain_quick_normalise(text: str) -> str:
    """``quick_normalise`` of one text."""
    first = _NUMBERED_STAR.sub(r"[R\1]", text)
    return _STAR_OR_BLOCK.sub(lambda m: m[1] or "[R]", first) if "*" in first else first


def bare_stars(structure: Column) -> Column:
    """Stars outside closed brackets."""
    outside = F.regexp_replace(structure, r"\[[^\]]*\]", "")
    return (F.length(outside) - F.length(F.replace(outside, F.lit("*"), F.lit("")))).cast("int")


def fill_stars(structure: Column, labels: Column) -> Column:
    """The i-th bare star takes the i-th label, ``R`` when labels run out."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def write(given):
        def step(acc, piece):
            is_star = piece == "*"
            label = F.coalesce(F.get(given, acc["seen"]), F.lit("R"))
            return F.struct(
                F.concat(acc["out"], F.when(is_star, F.concat(F.lit("["), label, F.lit("]"))).otherwise(piece)).alias("out"),
                (acc["seen"] + F.when(is_star, 1).otherwise(0)).alias("seen"),
            )

        return F.aggregate(pieces(structure), start, step, lambda acc: acc["out"])

    return let(labels, write)


def normalise_with_labels(structure: Column, labels: Column) -> Column:
    """Label bare stars in order when the counts agree, else all become ``[R]``."""
    first = numbered_labels(structure)
    count = bare_stars(first)
    usable = labels.isNotNull() & (F.size(labels) == count)
    chosen = F.when(usable, labels).otherwise(F.array().cast("array<string>"))
    return F.when(count == 0, first).otherwise(fill_stars(first, chosen))


def clean_symbol(symbol: Column) -> Column:
    cut = F.regexp_replace(symbol, r"[.,;:!+\-*#]+$", "")
    return F.when(symbol.isin("*", "R#") | (cut == ""), "R").otherwise(cut)


def runs_to_atoms(tokens: Column) -> Column:
    """Text of nothing but tokens, cut behind each atom; what follows the last atom is left out."""
    return F.regexp_extract_all(tokens, F.lit(r"([().=#\-+\\/:~@?>$0-9%]*" + _ATOMS + ")"), F.lit(1))


def strip_map_numbers(structure: Column) -> Column:
    return F.regexp_replace(structure, r":\d+\]", "]")


def strip_cis_trans(structure: Column) -> Column:
    return F.translate(structure, "/\\", "")


def strip_stereo(structure: Column) -> Column:
    return F.translate(structure, "/\\@", "")


def is_bracket_atom(token: Column) -> Column:
    return token.rlike(BRACKET_ATOM)


def wildcard_labels(structure: Column) -> Column:
    """``[Rn]`` becomes ``[n*]``; bracket tokens that are no element atom become ``*``. Tokens
    are judged once per batch, in Arrow batches: most of them come again and again."""
    return _wildcards(structure)


@F.pandas_udf(T.StringType())
def _wildcards(texts: pd.Series) -> pd.Series:
    find, swap = _FIND_TOKENS.findall, remembered(_wildcard)
    return texts.map(lambda text: "".join([swap[t] for t in find(text)]), na_action="ignore")


def _wildcard(token: str) -> str:
    if token[0] != "[":
        return token
    numbered = _NUMBERED.fullmatch(token)
    if numbered:
        return f"[{numbered[1]}*]"
    return token if _BRACKET_ATOM.search(token) else "*"


def text_key(structure: Column) -> Column:
    """Comparison key: no map numbers, no cis/trans marks, wildcards unified.

    A textual stand-in for a canonical form; it makes no claim of chemical identity.
    """
    return wildcard_labels(strip_cis_trans(strip_map_numbers(structure)))


def mask_labels(structure: Column, first_isotope: int = 50) -> Column:
    """Known label symbols become ``[n*]`` or ``*``; other bracket tokens that are
    shorthand or no element atom get a fresh isotope; the map says which.

    Returns ``struct<masked, mapping map<int,string>>``.
    """
    return _masks(structure, F.lit(first_isotope))


_PLAIN_LABELS = re.compile(r"\[(?:" + "|".join(s for s in sorted(RGROUP_SYMBOLS, key=lambda n: -len(n)) if not s[1:].isdigit()) + r")\]")
_NUMBERED_LABELS = re.compile(r"\[R(" + "|".join(s[1:] for s in sorted(RGROUP_SYMBOLS, key=lambda n: -len(n)) if s[1:].isdigit()) + r")\]")
_ISOTOPES = re.compile(r"\[(\d+)\*\]", re.ASCII)
_ENDS_OF_BRACKET = re.compile(r"^\[|\]$")
_ALIASED = re.compile(r"(?s)(\[[^\[\]]+\]|.)")
_MASKED = T.StructType([T.StructField("masked", T.StringType()), T.StructField("mapping", T.MapType(T.IntegerType(), T.StringType()))])


def _write_masks(tokens: list[str], labels: remembered, numbers: list[int], form: str) -> tuple[str, dict[int, str]]:
    """Text with the labelled tokens swapped for numbered placeholders, and number to label."""
    mapping, out, free = {}, [], iter(numbers)
    for token in tokens:
        label = labels[token]
        if label is not None:
            number = next(free)
            mapping[number] = label
            token = form % number
        out.append(token)
    return "".join(out), mapping


def _hidden_label(token: str) -> str | None:
    """The text in the brackets of shorthand and of what is no element atom."""
    if token[0] != "[":
        return None
    inner = _ENDS_OF_BRACKET.sub("", token)
    return inner if inner in ABBREVIATIONS or not _BRACKET_ATOM.search(token) else None


def _alias(token: str) -> str | None:
    if len(token) < 3 or token[0] != "[" or _BRACKET_ATOM.search(token):
        return None
    return token[1:-1].strip(" ")


@F.pandas_udf(_MASKED)
def _masks(texts: pd.Series, firsts: pd.Series) -> pd.DataFrame:
    labels, rows = remembered(_hidden_label), []
    for text, first in zip(texts, firsts, strict=True):
        if text is None:
            rows.append((None, None))
            continue
        base = _PLAIN_LABELS.sub("*", _NUMBERED_LABELS.sub(r"[\1*]", text.replace("<unk>", "C")))
        tokens, taken = _FIND_TOKENS.findall(base), set(_ISOTOPES.findall(base))
        # Enough numbers to skip every isotope already present in the text.
        free = [n for n in range(first, first + len(tokens) + len(taken) + 1) if str(n) not in taken]
        rows.append(_write_masks(tokens, labels, free, "[%d*]"))
    return pd.DataFrame(rows, columns=["masked", "mapping"])


@F.pandas_udf(_MASKED)
def _aliases(texts: pd.Series, firsts: pd.Series) -> pd.DataFrame:
    labels, rows = remembered(_alias), []
    for text, first in zip(texts, firsts, strict=True):
        if text is None:
            rows.append((None, None))
            continue
        tokens = _ALIASED.findall(text)
        rows.append(_write_masks(tokens, labels, range(first, first + len(tokens)), "[*:%d]"))
    return pd.DataFrame(rows, columns=["masked", "mapping"])


def alias_labels(structure: Column, first: int = 1001) -> Column:
    """Bracket tokens that are no element atom become ``[*:n]`` with n from ``first``;
    returns ``struct<masked, mapping map<int,string>>``."""
    return _aliases(structure, F.lit(first))


def expand_abbreviation(label: Column) -> Column:
    """Shorthand to fragment text; ``R<n>`` to ``[n*]``, other label symbols to ``*``."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return (
        F.when(label.isin(list(ABBREVIATIONS)), F.try_element_at(table, label))
        .when(label.rlike(r"^[A-Z]\d+$") & (label.startswith("R") | label.isin(RGROUP_SYMBOLS)),
              F.concat(F.lit("["), F.regexp_replace(label, "^.", ""), F.lit("*]")))
        .when(label.isin(RGROUP_SYMBOLS), "*")
        .otherwise(F.concat(F.lit("["), label, F.lit("]")))
    )


def classify_label(label: Column) -> Column:
    return (
        F.when(label.isin(RGROUP_SYMBOLS), "rgroup")
        .when(label.isin(list(ABBREVIATIONS)), "abbreviation")
        .when(label.isin(ELEMENTS), "element")
        .when(F.concat(F.lit("["), label, F.lit("]")).rlike(BRACKET_ATOM), "element")
        .otherwise("other")
    )


# --- annotated strings: backbone<sep><a>index:label</a>... ---------------------------


def split_estring(text: Column) -> Column:
    """``struct<category, backbone, tags array<struct<idx:int,label:string>>>``."""
    has_sep = text.contains("<sep>")
    backbone = F.regexp_extract(text, r"(?s)^(.*?)<sep>", 1)
    tail = F.trim(F.regexp_extract(text, r"(?s)<sep>(.*)$", 1))
    tag = r"<a>(\d+):(.+?)</a>"
    numbers = F.regexp_extract_all(tail, F.lit(tag), F.lit(1))
    labels = F.regexp_extract_all(tail, F.lit(tag), F.lit(2))
    tags = F.arrays_zip(
        F.transform(numbers, lambda n: n.try_cast("int")).alias("idx"),
        F.transform(labels, tag_label).alias("label"),
    )
    forbidden = tail.rlike(r"</?r>|</?c>|\?")
    category = (
        F.when(~has_sep, "drop_tag")
        .when(tail == "", "pure")
        .when(forbidden, "drop_tag")
        .when(F.size(numbers) == 0, "pure")
        .otherwise("wild")
    )
    return F.struct(category.alias("category"), backbone.alias("backbone"), tags.alias("tags"))


def tag_label(label: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(label, r"\[(\w+)\]", "$1"), "'+$", "")
    return F.when(flat.isin("<dum>", "dum", ""), "R").otherwise(flat)


def apply_tags(backbone: Column, tags: Column) -> Column:
    """Write labels on the stars at the tagged atom positions; null when a position lies
    behind the last atom. Positions holding another atom are left alone; the last tag of
    a position wins."""
    return let(tokenise(backbone), lambda tokens: let(tags, lambda bound: _apply_tags(tokens, bound)))


def _apply_tags(tokens: Column, tags: Column) -> Column:
    atoms = F.size(F.filter(tokens, is_atom))
    out_of_range = F.array_max(F.transform(tags, lambda t: F.coalesce(t["idx"], F.lit(2147483647)))) >= atoms
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def step(acc, token):
        here = F.filter(tags, lambda t: t["idx"] == acc["seen"])
        label = F.try_element_at(here, F.lit(-1))["label"]
        text = F.when(
            (token == "*") & label.isNotNull(), F.concat(F.lit("["), label, F.lit("]"))
        ).otherwise(token)
        return F.struct(
            F.concat(acc["out"], text).alias("out"),
            (acc["seen"] + F.when(is_atom(token), 1).otherwise(0)).alias("seen"),
        )

    written = F.aggregate(tokens, start, step, lambda acc: acc["out"])
    return F.when(~F.coalesce(out_of_range, F.lit(False)), written)


def convert_estring(text: Column) -> Column:
    """``struct<smiles, category>`` of an annotated string."""
    parts = split_estring(text)
    written = F.when(parts["category"] == "pure", parts["backbone"]).when(
        parts["category"] == "wild", apply_tags(parts["backbone"], parts["tags"])
    )
    category = F.when((parts["category"] == "wild") & written.isNull(), "fail").otherwise(
        parts["category"]
    )
    return F.struct(written.alias("smiles"), category.alias("category"))


def inline_labels(text: Column) -> Column:
    """``structure $a;b;...$`` annotation: stars take the non-empty labels in turn; other
    extensions after a blank are dropped. A star without a label makes the row null."""
    structure = F.split_part(text, F.lit(" "), F.lit(1))
    note = F.regexp_extract(text, r"\$(.*)\$", 1)
    labels = F.filter(F.split(note, ";"), lambda t: t != "")
    stars = F.length(structure) - F.length(F.replace(structure, F.lit("*"), F.lit("")))
    parts = F.split(structure, r"\*")
    filled = let(
        labels,
        lambda given: F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when(i == 0, p).otherwise(
                    F.concat(F.lit("["), F.get(given, i - 1), F.lit("]"), p)
                ),
            ),
            "",
        ),
    )
    return F.when(stars == 0, structure).when(F.size(labels) >= stars, filled)


# --- checks ------------------------------------------------------------------------


def brackets_balanced(text: Column) -> Column:
    marks = F.split(F.regexp_replace(text, r"[^\[\]]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    return F.aggregate(marks, start, step, lambda acc: acc["ok"] & (acc["depth"] == 0))


#: Marks of structure text: atoms (brackets, two-letter and one-letter symbols, stars), ring
#: closures, bonds, branches and the dot between parts. Anything else is no structure.
MARK_PATTERN = r"(\[[^\[\]]+\]|Br|Cl|[BCNOPSFIbcnops*]|%\d\d|\d|[-=#$:/\\~]|[().])"
_MARKS = re.compile(MARK_PATTERN, re.ASCII)
_ENDS = ("atom", "ring", "close")
_BONDS = "-=#$:/\\~"


def is_valid_structure(structure: Column) -> Column:
    """Whether a structure string can be read: only known marks, brackets and branches that
    close, ring numbers in pairs and never on one atom, every bond with an atom before it and
    an atom or ring number behind it, no empty branch or part. One pass over the marks with
    the open branches and rings as state, in Arrow batches: a fold of column expressions took
    fifty times as long. Text in brackets may be a label; valence and aromaticity are not
    judged. Null and empty text is not valid."""
    return F.coalesce(_readable(structure), F.lit(False))


@F.pandas_udf(T.BooleanType())
def _readable(texts: pd.Series) -> pd.Series:
    return texts.map(_reads, na_action="ignore").eq(True)


def _reads(text: str) -> bool:
    marks = _MARKS.findall(text)
    if sum(map(len, marks)) != len(text):
        return False
    last, atoms, here, branches, rings = "start", 0, 0, [], {}
    for m in marks:
        first = m[0]
        after_atom = last in _ENDS
        if first == "(":
            if not after_atom:
                return False
            branches.append(here)
            last = "open"
        elif first == ")":
            if not after_atom or not branches:
                return False
            here = branches.pop()
            last = "close"
        elif first == ".":
            if not after_atom:
                return False
            last = "dot"
        elif first in _BONDS:
            if not after_atom and last != "open":
                return False
            last = "bond"
        elif first in "0123456789%":
            if not after_atom and not (last == "bond" and here):
                return False
            number = int(m.lstrip("%"))
            partner = rings.pop(number, None)
            if partner is None:
                rings[number] = here
            elif partner == here:
                return False
            last = "ring"
        else:
            atoms += 1
            here = atoms
            last = "atom"
    return last in _ENDS and not branches and not rings


def dot_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))).cast("int")


def bracket_contents(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def count_atoms(structure: Column) -> Column:
    return F.size(atom_tokens(structure))


def plain_count_atoms(text: str) -> int:
    return len(_FIND_ATOMS.findall(text))


def bracket_labels(structure: Column) -> Column:
    """``array<struct<atom_idx,label>>`` of bracket atoms among the atom tokens."""
    marked = F.transform(
        atom_tokens(structure),
        lambda t, i: F.struct(i.alias("atom_idx"), F.regexp_replace(t, r"^\[|\]$", "").alias("label"), t.startswith("[").alias("b")),
    )
    kept = F.filter(marked, lambda s: s["b"])
    return F.transform(kept, lambda s: F.struct(s["atom_idx"].alias("atom_idx"), s["label"].alias("label")))


def heavy_atoms(structure: Column) -> Column:
    """Atom tokens other than ``[H]`` forms."""
    return F.size(F.filter(atom_tokens(structure), lambda t: ~t.rlike(r"^\[\d*H[+-]?\d*\]$")))


def ring_count(structure: Column) -> Column:
    """Ring closures: two marks close one ring."""
    marks = F.size(F.filter(tokenise(structure), lambda t: t.rlike(r"^(%\d\d|\d)$")))
    return F.floor(marks / 2).cast("int")


def atom_label(symbol: Column, isotope: Column, hydrogens: Column, charge: Column) -> Column:
    """Plain symbol for the organic subset, else ``[isotope symbol Hn charge]``."""
    plain = symbol.isin(ORGANIC_SYMBOLS) & (isotope == 0) & (charge == 0) & (hydrogens <= 0)
    iso = F.when(isotope != 0, isotope.cast("string")).otherwise("")
    h = (
        F.when(hydrogens > 1, F.concat(F.lit("H"), hydrogens.cast("string")))
        .when(hydrogens == 1, "H")
        .otherwise("")
    )
    sign = (
        F.when(charge == 1, "+")
        .when(charge == -1, "-")
        .when(charge > 0, F.concat(F.lit("+"), charge.cast("string")))
        .when(charge < 0, charge.cast("string"))
        .otherwise("")
    )
    return F.when(plain, symbol).otherwise(
        F.concat(F.lit("["), iso, symbol, h, sign, F.lit("]"))
    )


def formula_parts(formula: Column) -> Column:
    """Formula text to ``array<struct<part,count>>``; shorthand, nested group or element,
    each with its subscript; groups keep their text (level one only)."""
    names = "|".join(
        n.replace("-", r"\-") for n in sorted(ABBREVIATIONS, key=lambda s: (-len(s), s))
    )
    item = rf"(\([^()]*\)|{names}|R[0-9]*|[A-Z][a-z]+|[A-Z])([0-9]*)"
    parts = F.regexp_extract_all(formula, F.lit(item), F.lit(1))
    counts = F.regexp_extract_all(formula, F.lit(item), F.lit(2))
    return F.zip_with(
        parts,
        counts,
        lambda p, n: F.struct(p.alias("part"), F.coalesce(n.try_cast("int"), F.lit(1)).alias("count")),
    )
