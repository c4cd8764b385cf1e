"""Text rules as boolean or string columns; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder and definition phrases of variable groups, claim preambles
# (current and older list), claim sentences and excluded topics.
PLACEHOLDERS = (
    r"\bR\d*\b",
    r"\bR-group\b",
    r"\bR group\b",
    r"\bR\(\d+\)\b",
)
DEFINITIONS = (
    r"selected from the group consisting(?: essentially of)?",
    r"selected from the group comprising",
    r"selected from(?: a group)? of",
    r"wherein\s+R\d?",
    r"wherein said substituents\s+are",
    r"\bR\d?\s*to\s*R\d?\b",
    r"each R\d?\s*is\s*(?:a\s*)?[A-Za-z0-9,\- ]+",
    r"group consisting essentially of",
)
CLAIM_PREAMBLES = (
    r"\bwhat\s+(?:(?:is|are)\s+(?:claim(?:ed|s)?\s+is|claim(?:ed)?)|we\s+claim\s+is)\s*:?",
    r"\bthe\s+(?:(?:claimed\s+)?invention\s+(?:claimed\s+is|is\s+claimed\s+as\s+follows|is)"
    r"|claims\s+defining\s+the\s+invention\s+are\s+as\s+follows|following\s+claims?)\s*:?",
    r"\bthat\s+which\s+is\s+claimed(?:\s+is)?\s*:?",
    r"\b(?:i\s+claim(?:ed)?|we\s+claim(?:ed)?|it\s+is\s+claimed|we\s+claim\s+as\s+our\s+invention)\s*:",
)
CLAIM_PREAMBLES_OLD = (
    r"^claims\s*[:\-]?",
    r"\bwhat\s+(?:is|are)\s+claim(?:ed)?\s+is\b",
    r"\bwhat\s+(?:is|are)\s+claims\s+is\b",
    r"\bthe\s+invention\s+claim(?:ed)?\s+is\b",
)
CLAIM_SENTENCES = ("What is claimed is", "The invention claimed is", "I claim", "We claim")
EXCLUDED_TOPICS = ("polypeptide", "amino acid sequence")
WORKED_EXAMPLE = r"example\s+\d+[a-z]?\s*[:.\-\s]\s*(preparation|synthesis)\s+of"
EXAMPLE_NAME = (
    r"^\s*(?:example(?:\s+\d+\s*[a-z]?)?\s*[:\-.\r\n]\s*)?(?:synthesis|preparation)\s+of\s+(.+)$"
)
NUMBERED_ITEM = r"^\d+\.\s"
# The structure alphabet: letters, digits and the listed signs.
STRUCTURE_SIGNS = r"\[\]()=#@+\-/\\.%"


def _any(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def matches_any(text: Column, patterns: Sequence[str], flags: str = "(?i)") -> Column:
    """True when one of the patterns occurs; a null text never matches."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(text.rlike(flags + joined), F.lit(False))


def has_variable_definition(
    text: Column,
    placeholders: Sequence[str] = PLACEHOLDERS,
    definitions: Sequence[str] = DEFINITIONS,
) -> Column:
    """A placeholder and a definition phrase, anywhere in the text."""
    return matches_any(text, placeholders) & matches_any(text, definitions)


def starts_claims(text: Column, patterns: Sequence[str] = CLAIM_PREAMBLES) -> Column:
    return matches_any(F.lower(text), patterns, "(?im)")


def is_worked_example(text: Column, pattern: str = WORKED_EXAMPLE) -> Column:
    return matches_any(text, [pattern])


def example_name(text: Column, pattern: str = EXAMPLE_NAME) -> Column:
    """Name behind 'synthesis of' / 'preparation of' on the first such line, else null."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), "(?im)" + pattern, 1)
    return F.nullif(F.trim(found), F.lit(""))


def contains_word(text: Column, word: str) -> Column:
    return F.coalesce(text.contains(word), F.lit(False))


def contains_ci(text: Column, word: str) -> Column:
    return F.coalesce(F.lower(text).contains(word.lower()), F.lit(False))


def any_phrase(text: Column, phrases: Sequence[str] = CLAIM_SENTENCES) -> Column:
    return _any([contains_word(text, p) for p in phrases])


def excluded_topic(text: Column, topics: Sequence[str] = EXCLUDED_TOPICS) -> Column:
    return _any([contains_word(F.lower(text), t) for t in topics])


def starts_numbered_item(text: Column, pattern: str = NUMBERED_ITEM) -> Column:
    return F.coalesce(strip(text).rlike(pattern), F.lit(False))


def has_marker(first: Column, second: Column, mark: str = "R") -> Column:
    return contains_word(first, mark) | contains_word(second, mark)


def in_alphabet(text: Column, signs: str = STRUCTURE_SIGNS) -> Column:
    """Every character is a letter, digit or one of the listed signs."""
    return ~text.rlike(f"[^A-Za-z0-9{signs}]")


def is_valid_label(label: Column) -> Column:
    """One to six letters or digits, the first an upper-case letter."""
    return label.rlike(r"^\p{Lu}[\p{L}\p{N}]{0,5}$")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def list_items(text: Column) -> Column:
    """Trimmed non-empty lines of a list-like answer."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: strip(line))
    return F.filter(lines, lambda line: line != "")


def file_stem(path: Column) -> Column:
    """Last path part without its extension."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def resolve_path(base: Column | str, path: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path))


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Reproducible random order: the same seed and key give the same text everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(text: Column, start: int = 1, digits: int = 8) -> Column:
    """Non-negative integer from hex digits of an md5 value."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")
