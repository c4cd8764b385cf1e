"""Spelling variants: words one edit apart, found through an index of variable-length grams.

A gram dictionary says which grams are so frequent that they are extended. A word is cut
into the grams that stop at the first infrequent length, less those inside an earlier one.
How many of them one edit can affect is bounded per word, so a word needs to enter the lists
of that many of its rarest grams and one more: a word one edit apart is in one of them too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.session import materialise, release

_U = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Shortest gram; no gram is longer than ``LONGEST``, nor than half its word and its marks.
SHORTEST, LONGEST = 2, 12
#: Words on which the gram dictionary is fitted, about.
SAMPLE = 100_000
#: Words that a list of one gram and length should hold at most, by the sample.
OFTEN = 40
#: Words in a list above which its members meet by their one-edit remainders instead.
HOT = 1_000


def words_of(docs: DataFrame, key: str, text: str, least_chars: int, least_times: int, modulus: int) -> DataFrame:
    """(word, n): runs of letters, A-Z folded; where ``modulus`` divides the crc32 h of
    ``id:run``, the run loses its code point h % length. Kept are words with enough code
    points and occurrences."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_doc"), run.alias("run"))
    coded = runs.filter(F.length("run") >= least_chars).select("run", F.crc32(F.concat_ws(":", "_doc", "run")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substr(F.col("run"), place + 2))
    word = F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run"))
    counted = coded.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= least_chars) & (F.col("n") >= least_times))


class Grams:
    """Code points of many words, each between two marks, once per length class.

    Two words one edit apart have the same length or lengths one apart; their class is the
    smaller length. So a word of n code points stands in class n and, as the longer word, in
    class n - 1 (if that is a length of words at all). A class has grams of up to half its
    length and one, so that an edit leaves a gram at the word's one end or the other."""

    def __init__(self, words: list[str], least_chars: int):
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        longer = np.flatnonzero(sizes > least_chars)
        self.word = np.concatenate([np.arange(len(words)), longer])
        self.klass = np.concatenate([sizes, sizes[longer] - 1])
        n = sizes[self.word] + 2
        self.start = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(int(n.sum())) - self.start[self.row]
        self.code = flat[starts[self.word][self.row] + self.at].astype(_U)
        self.end = (self.start + n)[self.row]
        self.most = np.minimum(self.klass // 2 + 1, LONGEST)[self.row]
        self.top = int(self.most.max(initial=SHORTEST))

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per gram length q: places with such a gram, and the hashes at all places."""
        place = np.arange(len(self.code))
        h = texts.mix(self.klass[self.row].astype(_U))
        for q in range(1, self.top + 1):
            fits = (place + q <= self.end) & (q <= self.most)
            step = np.zeros_like(h)
            step[: len(h) - q + 1] = self.code[q - 1 :]
            h = texts.mix(h + step * _U(0x9E3779B1))
            yield q, fits, h


def gram_counts(words: DataFrame, least_chars: int) -> DataFrame:
    """(gram, c): how many words of a class hold a gram, all lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = Grams(batch.column("word").to_pylist(), least_chars)
            for q, fits, h in grams.hashes():
                if q >= SHORTEST:
                    found, count = np.unique(h[fits], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"gram": found.view(np.int64), "c": count.astype(np.int64)})

    return words.select("word").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def frequent_grams(words: DataFrame, total: int, least_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the grams that are extended, sorted by hash: those more frequent in
    a sample of about ``SAMPLE`` words than ``OFTEN``, scaled to the sample. At most as many
    as the sample has places for grams, whatever the table's size."""
    share = min(1.0, SAMPLE / max(total, 1))
    often = max(1, round(OFTEN * share))
    drawn = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)))
    table = gram_counts(drawn, least_chars).filter(F.col("c") > often).toArrow()
    h, c = table.column("gram").to_numpy().view(_U), table.column("c").to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def list_entries(words: list[str], frequent: np.ndarray, counts: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, word number, whether the word has the class's own length): the lists that each
    word enters, per class."""
    g = Grams(words, least_chars)
    total = len(g.code)
    place = np.arange(total)

    def count_of(h):
        i = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        return np.where(frequent[i] == h, counts[i], 0) if len(frequent) else np.zeros(len(h), np.int64)

    # The gram at a place is extended while it is frequent, has room and the word goes on.
    length, gram, often = np.zeros(total, np.int64), np.zeros(total, _U), np.zeros(total, np.int64)
    extended = {q: np.ones(total, bool) for q in range(-1, SHORTEST)}
    alive = np.ones(total, bool)
    for q, fits, h in g.hashes():
        if q < SHORTEST:
            continue
        c = np.zeros(total, np.int64)
        c[fits] = count_of(h[fits])
        alive &= fits
        length[alive], gram[alive], often[alive] = q, h[alive], c[alive]
        extended[q] = c > 0
        alive &= c > 0
    stop = place + length
    # A gram inside an earlier one is left out. No gram passes its word's end, so the furthest
    # stop so far never comes from a word before.
    far = np.maximum.accumulate(np.concatenate([[0], stop[:-1]]))
    kept = np.flatnonzero((length > 0) & (stop > far))
    size, row = length[kept], g.row[kept]
    # An edit before a gram affects it if a new gram could start there and reach over it: its
    # part behind the edit, without the last code point, must be extended.
    left, open_ = kept.copy(), np.ones(len(kept), bool)
    for k in range(1, g.top - SHORTEST + 1):
        head = kept - k + 1
        open_ &= (size + k <= g.most[kept]) & (kept - k >= g.start[row])
        behind = np.zeros(len(kept), bool)
        for q in np.unique(size[open_] + k - 2):
            mine = open_ & (size + k - 2 == q)
            behind[mine] = extended[int(q)][head[mine]]
        open_ &= behind
        left[open_] = kept[open_] - k
    cover = np.zeros(total + 1, np.int64)
    np.add.at(cover, left, 1)
    np.add.at(cover, kept + size, -1)
    cover = np.cumsum(cover)[:-1]
    cover[(g.at == 0) | (place == g.end - 1)] = 0
    affected = np.maximum.reduceat(cover, g.start) if len(g.start) else cover

    # Rarest grams first, by one order for all words; a gram's second occurrence is a gram of
    # its own. affected + 1 of them must hold one that an edit leaves.
    order = np.lexsort((gram[kept], often[kept], row))
    row, kept = row[order], kept[order]
    h = gram[kept]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    held = np.bincount(row, minlength=len(g.start))
    if (held <= affected).any():
        raise AssertionError("a word without a gram that one edit leaves")
    enters = rank <= affected[row]
    token = texts.mix(h + texts.mix((np.arange(len(h)) - run).astype(_U)))
    own = g.klass[row] == np.array([len(w) for w in words], np.int64)[g.word[row]]
    return token[enters].view(np.int64), g.word[row][enters], own[enters]


def gram_lists(words: DataFrame, frequent, least_chars: int) -> DataFrame:
    """(gram, word, n, own) for every list that a word enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = frequent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            token, number, own = list_entries(batch.column("word").to_pylist(), h, c, least_chars)
            number = pa.array(number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), batch.column("word").take(number), batch.column("n").take(number), pa.array(own)], names=["gram", "word", "n", "own"]
            )

    return words.select("word", "n").mapInArrow(run, "gram long, word string, n long, own boolean")


def _pairs(rows: DataFrame, on: str, extra: Column | None = None) -> DataFrame:
    """(a, an, b, bn): pairs of one list that are one edit apart."""
    x = rows.select(on, F.col("word").alias("a"), F.col("n").alias("an"), F.col("own").alias("a_own"))
    y = rows.select(on, F.col("word").alias("b"), F.col("n").alias("bn"), F.col("own").alias("b_own"))
    near = (F.col("a") < F.col("b")) & (F.col("a_own") | F.col("b_own")) & (F.levenshtein("a", "b", 1) == 1)
    return x.join(y, on).filter(near).select("a", "an", "b", "bn")


def near_pairs(words: DataFrame, least_chars: int = 6, hot: int = HOT) -> DataFrame:
    """(a, an, b, bn), a < b: all pairs of words that differ by exactly one inserted, deleted
    or replaced code point, with their numbers. ``words`` is a stored table (word, n).

    Lists of up to ``hot`` words are merged pair by pair and verified. The words of longer
    lists meet by what is left of them without one code point, which two words share with
    few others, so that no list costs its square."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, words.count(), least_chars))
    lists = materialise(gram_lists(words, frequent, least_chars), "gram-lists")
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = materialise(sizes, "gram-sizes")
    short = lists.join(sizes.filter(F.col("size") <= hot).select("gram"), "gram", "left_semi")
    long = lists.join(sizes.filter(F.col("size") > hot).select("gram"), "gram", "left_semi").select("word", "n").distinct()
    w = F.col("word")
    without = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    left = long.select("word", "n", F.explode(F.array_distinct(F.array_append(without, w))).alias("left"), F.lit(True).alias("own"))
    found = _pairs(short, "gram").unionByName(_pairs(left, "left")).distinct()
    stored = materialise(found, "near-words")
    release(lists, sizes)
    return stored


def roots(forms: DataFrame, rounds: int = 6) -> DataFrame:
    """(word, root): where following ``form`` ends, by doubling. A form is at least twice as
    frequent as its word, so 2**rounds steps are more than any chain of 64-bit counts has."""
    reach = materialise(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    for _ in range(rounds):
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(reach.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        release(reach)
        reach = step
        if reach.filter("moved").isEmpty():
            break
    return reach.select("word", "root")


def group_variants(
    docs: DataFrame, least_chars: int = 6, least_times: int = 5, ratio: int = 5, modulus: int = 199, hot: int = HOT,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (see ``words_of``).

    Words are near if they differ by exactly one inserted, deleted or replaced code point. A
    word's form is its near word of largest n (ties: smallest in code-point order) if that is
    at least ``ratio`` (2 or more) times the word's own n, else null; its root is where forms
    lead in the end, or itself.

    Null and empty texts have no words; a null id counts as an empty one; rows that share an
    id are counted like others; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in a circle")
    words = materialise(words_of(docs, key, text, least_chars, least_times, modulus), "words")
    pairs = near_pairs(words, least_chars, hot)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o"), F.col("bn").alias("on")), F.struct(F.col("b").alias("w"), F.col("a").alias("o"), F.col("an").alias("on")))).alias("e"))
    best = both.select("e.*").groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("on")).alias("m"), "o")).alias("best"))
    joined = words.join(best, F.col("word") == F.col("w"), "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    forms = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best.o")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n"),
    )
    forms = materialise(forms, "forms")
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
