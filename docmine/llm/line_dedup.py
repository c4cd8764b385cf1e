"""Line dedup by probing sharded minimal perfect hash tables.

Every distinct line key becomes a row of a shard: a minimal perfect hash (levels of bit
maps with ranks) places it in compact arrays of fingerprints, document counts and first
holders. Documents send the hashes of their keys to the arrays; line texts are never joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.session import materialise

#: Keys a shard is laid out for, and probes that one task answers at a time.
SHARD_KEYS = 200_000
PROBES = 1_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_SECOND = texts.mix(texts.mix(texts.FOLDED_CODES))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level by level, keys alone in their slot
    settle there and the rest go on; a key's place is the rank of its slot."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flags = np.unpackbits(bits, count=int(self.starts[-1]))
        self.flags = flags.astype(bool)
        self.ranks = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = texts.mix(keys ^ texts.mix(np.array([level + 1], np.uint64)))
        return ((salted >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        sizes, maps, rest = [], [], keys
        while len(rest):
            size = int(gamma * len(rest)) + 1
            slots = cls._slots(rest, len(sizes), size).astype(np.int64)
            alone = np.bincount(slots, minlength=size) == 1
            sizes.append(size)
            maps.append(alone)
            rest = rest[~alone[slots]]
        flags = np.concatenate(maps) if maps else np.zeros(0, bool)
        return cls(np.array(sizes, np.int64), np.packbits(flags))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of every key; -1 for a key that settles nowhere (then it was not built in)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._slots(keys[open_], level, int(size)).astype(np.int64) + self.starts[level]
            settled = self.flags[at]
            out[open_[settled]] = self.ranks[at[settled]]
            open_ = open_[~settled]
        return out


def _line_keys(data: np.ndarray, offsets: np.ndarray):
    """(line starts, line ends, lines before each row, two hashes and code points per key)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    rows = np.arange(len(offsets)) + np.searchsorted(breaks, offsets)
    ink = ~texts.GAP[data]
    at = np.where(ink, np.arange(n), -1)
    last = np.maximum.accumulate(at) if n else at
    at[~ink] = n
    first = np.minimum.accumulate(at[::-1])[::-1] if n else at
    left = np.minimum(first[np.minimum(starts, max(n - 1, 0))], ends) if n else starts
    left = np.where(starts < ends, left, ends)
    right = np.where(left < ends, (last[np.maximum(ends - 1, 0)] + 1) if n else ends, ends)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    one = texts.span_hashes(texts.prefix_hashes(data, texts.FOLDED_CODES), left, right)
    two = texts.span_hashes(texts.prefix_hashes(data, _SECOND), left, right)
    return starts, ends, rows, one, two, points[right] - points[left]


def _distinct_keys(batch: pa.RecordBatch, min_chars: int):
    data, offsets = texts.utf8(batch.column("__dm_text"))
    _, _, rows, one, two, points = _line_keys(data, offsets)
    row = np.repeat(np.arange(len(batch)), np.diff(rows))
    long = points >= min_chars
    row, one, two = row[long], one[long], two[long]
    order = np.lexsort((two, one, row))
    row, one, two = row[order], one[order], two[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return row[new], one[new], two[new]


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc) for each distinct key of each row with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "__dm_text"):
            row, one, two = _distinct_keys(batch, min_chars)
            yield pa.RecordBatch.from_pydict(
                {"h1": _as_long(one), "h2": _as_long(two), "doc": batch.column("__dm_doc").take(pa.array(row))}
            )

    return docs.filter("__dm_doc IS NOT NULL").mapInArrow(run, "h1 long, h2 long, doc long")


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row per shard: the perfect hash and, in its order, fingerprints, counts and owners."""
    counted = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("owner"), F.max("doc").alias("last"))

    def lay_out(table: pa.Table) -> pa.Table:
        h1 = table.column("h1").to_numpy().view(np.uint64)
        h2 = table.column("h2").to_numpy().view(np.uint64)
        # The place comes from h1 and h2 together, so two keys differ there if they differ at all.
        hashed = PerfectHash.build(texts.mix(h1) ^ h2)
        place = hashed.places(texts.mix(h1) ^ h2)
        prints, counts, owners = np.empty(len(h1), np.uint64), np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        prints[place] = h1
        owner = table.column("owner").to_numpy()
        # A key held by one document only, however many rows carry that id, counts once.
        counts[place] = np.where(owner == table.column("last").to_numpy(), 1, np.maximum(table.column("n").to_numpy(), 2))
        owners[place] = owner
        return pa.table(
            {"shard": table.column("shard")[:1], "sizes": [hashed.sizes.tobytes()], "bits": [hashed.bits.tobytes()],
             "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()]}
        )

    return (
        counted.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(lay_out, "shard long, sizes binary, bits binary, prints binary, counts binary, owners binary")
    )


def probe(index: pa.Table, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document count, first holder) of every key; count 0 for a key not in the arrays."""
    row = {c: index.column(c)[0].as_py() for c in ("sizes", "bits", "prints", "counts", "owners")}
    hashed = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["bits"], np.uint8))
    place = hashed.places(texts.mix(h1) ^ h2)
    prints = np.frombuffer(row["prints"], np.uint64)
    found = (place >= 0) & (prints[place] == h1)
    return (
        np.where(found, np.frombuffer(row["counts"], np.int64)[place], 0),
        np.where(found, np.frombuffer(row["owners"], np.int64)[place], -1),
    )


def repeated_keys(keys: DataFrame, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """(doc, drop: its keys that a smaller doc_id holds too, as pairs of hashes).

    Keys are dealt to shards by hash. A shard asked more than ``probes`` times is answered
    by as many tasks, each with a copy of its arrays, so a line that a third of all
    documents hold does not end in one task.
    """
    # A bound on the distinct keys sets the number of shards.
    shards = max(1, -(-keys.count() // shard_keys))
    index = materialise(build_index(keys, shards), "line-index")
    asked = keys.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards)))
    load = materialise(
        asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / probes).cast("long").alias("copies")), "line-load"
    )
    asked = asked.join(load, "shard").withColumn("copy", F.pmod(F.xxhash64("doc"), F.col("copies")))
    again = load.select(F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("c"))
    arrays = index.join(again, F.col("shard") == F.col("s")).drop("s").withColumnsRenamed({"shard": "own_shard", "c": "own_copy"})

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        h1, h2 = (left.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        doc = left.column("doc").to_numpy()
        if not len(doc):
            return pa.table({"doc": doc, "h1": _as_long(h1), "h2": _as_long(h2)})
        count, owner = probe(right, h1, h2)
        drop = (count >= 2) & (owner != doc)
        return pa.table({"doc": doc[drop], "h1": _as_long(h1[drop]), "h2": _as_long(h2[drop])})

    hits = (
        asked.groupBy("shard", "copy").cogroup(arrays.groupBy("own_shard", "own_copy")).applyInArrow(answer, "doc long, h1 long, h2 long")
    )
    return hits.groupBy(F.col("doc").alias("__dm_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("__dm_drop"))


def _rebuilt(batch: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(lines, dropped lines, kept bytes) of every row."""
    data, offsets = texts.utf8(batch.column("__dm_text"))
    starts, ends, rows, one, two, points = _line_keys(data, offsets)
    lines, dropped, kept = np.diff(rows), np.zeros(len(batch), np.int64), []
    drop = batch.column("__dm_drop")
    for i in range(len(batch)):
        a, b = rows[i], rows[i + 1]
        bad = drop[i].values if drop[i].is_valid else None
        if bad is None:
            kept.append(data[offsets[i] : offsets[i + 1]].tobytes())
            continue
        h1, h2 = (bad.field(k).to_numpy().view(np.uint64) for k in (0, 1))
        gone = (points[a:b] >= min_chars) & np.isin(texts.mix(one[a:b]) ^ two[a:b], texts.mix(h1) ^ h2)
        dropped[i] = gone.sum()
        stay = np.flatnonzero(~gone) + a
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        kept.append(b"\n".join(raw[s - offsets[i] : e - offsets[i]] for s, e in zip(starts[stay], ends[stay], strict=True)))
    return lines, dropped, kept


def _marked(docs: DataFrame, key: str, text: str, min_chars: int, shard_keys: int, probes: int) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("__dm_doc"), F.col(text).alias("__dm_text"))
    keys = materialise(line_keys(rows, min_chars), "line-keys")
    return repeated_keys(keys, shard_keys, probes)


def measure(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, shard_keys: int = SHARD_KEYS, probes: int = PROBES
) -> DataFrame:
    """(key, n_lines, n_dropped, kept_sha256) of every row.

    A line's key is the line stripped of white space, A-Z folded. Keys of at least
    ``min_chars`` code points found in two documents or more lose their lines everywhere
    but in the smallest id that holds them. A null or empty text is one empty line. Rows
    without an id are kept whole and count for nothing; rows that share an id are one
    document. An empty table gives no rows. Keys are compared by 128 bits of hash.
    """
    drop = _marked(docs, key, text, min_chars, shard_keys, probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "__dm_text"):
            lines, dropped, kept = _rebuilt(batch, min_chars)
            yield pa.RecordBatch.from_pydict(
                {"__dm_doc": batch.column("__dm_doc"), "n_lines": lines, "n_dropped": dropped,
                 "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
            )

    rows = docs.select(F.col(key).cast("long").alias("__dm_doc"), F.col(text).alias("__dm_text"))
    joined = rows.join(drop, rows["__dm_doc"] == drop["__dm_id"], "left").select("__dm_doc", "__dm_text", "__dm_drop")
    return joined.mapInArrow(run, "__dm_doc long, n_lines long, n_dropped long, kept_sha256 string").withColumnRenamed("__dm_doc", key)


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 10, shard_keys: int = SHARD_KEYS, probes: int = PROBES
) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines taken out of the text (see ``measure``)."""
    drop = _marked(docs, key, text, min_chars, shard_keys, probes)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "__dm_text"):
            _, _, kept = _rebuilt(batch, min_chars)
            own = [batch.column(c) if c != text else pa.array([k.decode() for k in kept], pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(own, names=columns)

    rows = docs.withColumnRenamed(text, "__dm_text").withColumn("__dm_doc", F.col(key).cast("long"))
    joined = rows.join(drop, rows["__dm_doc"] == drop["__dm_id"], "left").drop("__dm_id", "__dm_doc")
    return joined.mapInArrow(run, docs.schema)
