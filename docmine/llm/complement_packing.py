"""Best-fit packing by exact complements over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.llm.packing import encoder_of
from docmine.operators.ordering import rank_in_order
from docmine.session import materialise

#: Id that ends every document.
END_ID = 2


class Complements:
    """Sums of one, two and three lengths that are at hand, under their counts.

    ``left[n]`` is how many pieces of length n are left, ``pairs[s]`` how many pairs of
    lengths at hand add up to s. A triple of sum s is a length with a pair of the rest.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.size = len(counts) - 1
        self.pairs = np.zeros(2 * self.size + 1, np.int64)
        have = self.left > 0
        for n in np.flatnonzero(have):
            self.pairs[n : n + n + 1] += have[: n + 1]
        # A length pairs with itself only where two are left.
        self.pairs[2 * np.flatnonzero(self.left == 1)] -= 1

    def spend(self, lengths: tuple[int, ...], times: int) -> None:
        for n, c in Counter(lengths).items():
            before, after = self.left[n], self.left[n] - c * times
            self.left[n] = after
            if before >= 2 > after:
                self.pairs[2 * n] -= 1
            if before >= 1 > after:
                others = self.left > 0
                others[n] = False
                self.pairs[n : n + self.size + 1] -= others

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.left[n]) // c for n, c in Counter(lengths).items())

    def _pair(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs of sum ``total``, the one with the largest piece first."""
        if total < 2 or not self.pairs[total]:
            return
        low = np.arange(1, min(total // 2, self.size) + 1)
        low = low[total - low <= self.size]
        for a in low[(self.left[low] > 0) & (self.left[total - low] > 0)]:
            yield int(total - a), int(a)

    def fill(self, piece: int, most: int = 3) -> tuple[int, ...] | None:
        """One, two or three (at ``most``) lengths that fill what ``piece`` leaves open, and
        are at hand beside it; larger pieces first, since they fit fewer places."""
        gap = self.size - piece
        if self.times((piece, gap)) if gap else True:
            return (gap,) if gap else ()
        for two in self._pair(gap) if most > 1 else ():
            if self.times((piece, *two)):
                return two
        third = np.arange(gap - 2 if most > 2 else 0, 0, -1)
        for c in third[(self.left[third] > 0) & (self.pairs[gap - third] > 0)]:
            for two in self._pair(gap - int(c)):
                if self.times((piece, int(c), *two)):
                    return (int(c), *two)
        return None


def plan_windows(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths, times)]: windows that hold every piece of a histogram ``counts[length]``.

    From the longest length down, exact complements are used up as long as their counts
    last. Lengths without one are then packed by best fit, longest first, all pieces of a
    length and all windows of one filling at a time. Complements of three and of two lengths
    can take small pieces that best fit would use better, so this is done with complements of
    up to three, two and one lengths, and the plan with the fewest windows is returned. The
    work depends on the window size and not on the number of pieces.
    """
    plans = [_plan(counts, most) for most in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(counts: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    at = Complements(counts)
    plan: list[tuple[tuple[int, ...], int]] = []
    for n in range(at.size, 0, -1):
        while at.left[n]:
            rest = at.fill(n, most)
            if rest is None:
                break
            lengths = (n, *rest)
            times = at.times(lengths)
            at.spend(lengths, times)
            plan.append((lengths, times))
    return plan + _best_fit(at.left, at.size)


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing; windows of one filling are one entry."""
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    for n in range(size, 0, -1):
        todo = int(left[n])
        while todo:
            gap = next((g for g in range(n, size) if room[g]), size)
            if gap == size:
                held, windows = (), -(-todo // (size // n))
            else:
                held, windows = room[gap].popitem()
            each = min(gap // n, todo)
            full = min(windows, todo // each)
            grown = (*held, *[n] * each)
            place = room[gap - each * n]
            place[grown] = place.get(grown, 0) + full
            todo -= full * each
            if gap < size and windows > full:
                room[gap][held] = windows - full
    return [(lengths, times) for group in room for lengths, times in group.items()]


def allotments(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, from, to, first sequence, offset): pieces number from..to-1 of a length go to
    consecutive sequences, at one offset."""
    used, first, rows = Counter(), 0, []
    for lengths, times in plan:
        at = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times, first, at))
            used[n] += times
            at += n
        first += times
    return rows


def _pieces(definition, size: int, end_id: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(definition.value), end_id.to_bytes(4, "little")
        for part in texts.slices(batches, "_text"):
            blobs = encoder.encode([t or "" for t in part.column("_text").to_pylist()])
            owner, rows = [], []
            for i, blob in enumerate(blobs):
                blob += end
                total = len(blob) // 4
                # Only the first piece may be shorter.
                cuts = [0, *range((total - 1) % size + 1, total + 1, size)]
                for number, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    owner.append(i)
                    rows.append((number, a, b - a, zlib.crc32(blob[4 * a : 4 * b])))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [part.column("_doc").take(pa.array(owner, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 3], strict=True)]],
                names=names,
            )

    return run


def pack(docs: DataFrame, tokenizer_json: str, size: int = 1024, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in few
    sequences of at most ``size`` tokens.

    A document is its text's ids and a closing ``end_id``. One of more than ``size`` ids is
    cut from its end into pieces of ``size``, so that the first piece may be shorter. The
    plan is made on the number of pieces of each length, at most ``size`` rows whatever the
    table's size (``plan_windows``). Pieces are numbered within their length, over hash
    buckets so that a length of any share is spread, and look up their place in the plan.

    Null and empty texts are one token; null ids and repeated rows are packed like others;
    the id may have any type; an empty table gives no pieces. ``tokenizer_json`` is read on
    the driver, its bytes are shipped to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = materialise(rows.mapInArrow(_pieces(definition, size, end_id), schema), "cut-pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    places = spark.createDataFrame(
        allotments(plan_windows(counts)), "of_length long, from_rank long, to_rank long, first_sequence long, place long"
    )
    spread = pieces.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), "piece", "ids_crc32"))
    order = [F.col("_h"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = rank_in_order(spread, ["length"], {"h": F.pmod(F.col("_h"), F.lit(1024))}, order, "_rank")
    # The plan has as many rows as there are ways to fill a window, whatever the table's size.
    placed = numbered.join(
        F.broadcast(places),
        (F.col("length") == F.col("of_length")) & (F.col("_rank") > F.col("from_rank")) & (F.col("_rank") <= F.col("to_rank")),
    )
    return placed.select(
        F.col("doc_id").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("_rank") - 1 - F.col("from_rank")).alias("sequence_id"), F.col("place").alias("offset"),
    )
