"""Line-first cleaning: rules per line, then a verdict on what is left of the document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docmine.llm import texts

# Marks, boilerplate phrases and limits of the rules.
WORD = r"[^\x20\x09-\x0D]+"
CLOSED_LINE = r"[.!?…:;][\"'”’»)\]]*[\x20\x09-\x0D]*$"
CLOSED_WORD = r"[.!?][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
NAVIGATION_MARK = r"[|<>»›•·#*$%&]"
BOILERPLATE = (
    "accept cookies|cookie policy|all rights reserved|privacy policy|terms of service|terms of use|"
    "enable javascript|lorem ipsum|click here|sign up now|subscribe to our"
)


@dataclass(frozen=True)
class LineRules:
    """``words_per_stop``: an unclosed line needs one closed word in so many words.
    ``marks_percent``: navigation marks a line may hold per 100 words.
    ``boiler_percent``: words of boilerplate phrases a line may hold per 100 words.
    ``lost_percent``: share of word characters a document may lose in failed lines."""

    words_per_stop: int = 25
    marks_percent: int = 30
    boiler_percent: int = 5
    lost_percent: int = 50
    min_words: int = 10
    repeat_percent: int = 20


_WORD, _CLOSED_LINE, _CLOSED_WORD, _MARK, _BOILER = (
    re.compile(WORD), re.compile(CLOSED_LINE), re.compile(CLOSED_WORD), re.compile(NAVIGATION_MARK),
    re.compile(BOILERPLATE, re.ASCII | re.IGNORECASE),
)


def line_failure(line: str, rules: LineRules) -> str | None:
    """The first rule that a line with words breaks: punctuation, navigation or boilerplate."""
    n = len(_WORD.findall(line))
    if not _CLOSED_LINE.search(line) and rules.words_per_stop * len(_CLOSED_WORD.findall(line)) < n:
        return "punctuation"
    if 100 * len(_MARK.findall(line)) > rules.marks_percent * n:
        return "navigation"
    if 100 * sum(len(m.split()) for m in _BOILER.findall(line)) > rules.boiler_percent * n:
        return "boilerplate"
    return None


def clean_lines(text: str, rules: LineRules) -> tuple[str, int, int]:
    """(text without its failed lines, word characters lost, duplicate lines)."""
    kept, lost, copies, seen = [], 0, 0, set()
    for line in text.split("\n"):
        chars = sum(map(len, _WORD.findall(line)))
        if chars:
            copies += line in seen
            seen.add(line)
            if line_failure(line, rules):
                lost += chars
                continue
        kept.append(line)
    return "\n".join(kept), lost, copies


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _repeated_words(words: np.ndarray) -> int:
    """Words inside 5-word windows that occur twice or more."""
    runs = texts.run_hashes(words, 5)
    if not len(runs):
        return 0
    _, place, times = np.unique(runs, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(times[place] > 1)
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + 5, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _measure(batch: pa.RecordBatch, rules: LineRules, column: str) -> pa.RecordBatch:
    data, offsets = texts.utf8(batch.column(column))
    starts, ends, words = texts.word_spans(data, offsets)
    hashes = texts.span_hashes(texts.prefix_hashes(data, texts.EXACT_CODES), starts, ends)
    char = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~texts.GAP[data])])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    n_words = np.diff(words)
    word_chars = char[offsets[1:]] - char[offsets[:-1]]
    repeats = np.array([_repeated_words(hashes[a:b]) for a, b in zip(words[:-1], words[1:], strict=True)], np.int64)
    cleaned = [clean_lines(t or "", rules) for t in batch.column(column).to_pylist()]
    lost = np.array([c[1] for c in cleaned], np.int64)
    failed = (n_words < rules.min_words) | (100 * repeats > rules.repeat_percent * n_words)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbol[offsets[1:]] - symbol[offsets[:-1]],
        "n_dup_lines": np.array([c[2] for c in cleaned], np.int64), "n_repeat_words": repeats, "lost_chars": lost,
        "base_failed": failed, "kept": ~failed & (100 * lost <= rules.lost_percent * word_chars),
        "clean_text": [c[0] for c in cleaned],
    }
    return out


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_chars long, "
    "base_failed boolean, kept boolean"
)


def judge(docs: DataFrame, rules: LineRules | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, measures, verdict, digest of the cleaned text) of every row, nothing shuffled.

    A line with words fails when it is unclosed and nearly without closed words, when
    navigation marks or boilerplate phrases crowd it. A document is kept
    if it passes the base rules and its failed lines hold at most ``lost_percent`` of its
    word characters. A null or empty text has no words and is rejected; a null key is
    passed on; repeated rows are judged alike; other columns are left out.
    """
    rules = rules or LineRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "_text"):
            out = _measure(batch, rules, "_text")
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in out.pop("clean_text")]
            yield pa.RecordBatch.from_pydict({"_key": batch.column("_key"), **out, "clean_sha256": digest})

    rows = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_key {kind}, {MEASURES}, clean_sha256 string")
    return out.withColumnRenamed("_key", key)


def clean(docs: DataFrame, rules: LineRules | None = None, text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are kept, without their failed lines; all columns stay as they are."""
    rules = rules or LineRules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, text):
            out = _measure(batch, rules, text)
            at = batch.schema.get_field_index(text)
            cleaned = pa.array(out["clean_text"], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), cleaned).filter(pc.equal(pa.array(out["kept"]), True))

    return docs.mapInArrow(run, docs.schema)
