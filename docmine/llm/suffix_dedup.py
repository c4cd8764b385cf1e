"""Exact removal of repeated byte strings by induced suffix sorting.

Every ``length``-byte window of every text is given a place by content: the least hash among
its 32-byte grams picks an anchor, and the bytes around the anchor that the window must hold
give its key. Equal windows have equal keys, so keys split the corpus into independent shards
of pieces (runs of neighbouring windows with one key). Equal pieces are folded by digest;
where different pieces meet under one key, their suffixes are sorted: the order of the
leftmost-S suffixes is refined recursively, and from it all suffixes are induced through
disk-backed queues that carry (position, common prefix with the suffix before). A common
prefix of ``length`` bytes marks both windows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.session import materialise

_U = np.uint64
GRAM = 32
#: Bytes of pieces sorted together; a key with more is sorted in one larger shard.
SHARD_BYTES = 1 << 20
#: Tuples that a queue holds in memory, and tuples scanned at a time.
QUEUE_TUPLES = 1 << 18


class SpillQueue:
    """First-in first-out blocks of (position, common prefix); full ones go to a file that
    ends with the task."""

    def __init__(self, limit: int = QUEUE_TUPLES):
        self.limit, self.held, self.blocks, self.file, self.offsets = limit, 0, [], None, []

    def __bool__(self) -> bool:
        return bool(self.blocks or self.offsets)

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(prefix="induced-")
        self.file.seek(0, 2)
        self.offsets.append(self.file.tell())
        np.save(self.file, np.concatenate([b[0] for b in self.blocks]))
        np.save(self.file, np.concatenate([b[1] for b in self.blocks]))
        self.blocks, self.held = [], 0

    def _stored(self, offset: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(offset)
        return np.load(self.file), np.load(self.file)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All blocks in order; the queue is empty afterwards and may be filled meanwhile."""
        blocks, offsets, file = self.blocks, self.offsets, self.file
        self.blocks, self.offsets, self.file, self.held = [], [], None, 0
        for offset in offsets:
            file.seek(offset)
            yield np.load(file), np.load(file)
        if file:
            file.close()
        if blocks:
            yield np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])

    def reversed(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All blocks, last first, each in its own order; the queue keeps them."""
        yield from reversed(self.blocks)
        for offset in reversed(self.offsets):
            yield self._stored(offset)


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    table = [values]
    while 2 << (len(table) - 1) <= len(values):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _range_min(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a..b], both inclusive."""
    level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
    out = np.empty(len(a), table[0].dtype)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(table[k][a[at]], table[k][b[at] - (1 << int(k)) + 1])
    return out


class _Scan:
    """One inducing pass: items come in suffix order and induce their left neighbours of the
    wanted type into the queue of the neighbour's symbol, with the common prefix that it has
    with the one induced there before: one more than the least on the way between them."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, cap: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queues = [SpillQueue() for _ in range(257)]
        self.least = np.full(257, cap, np.uint16)
        self.seen = np.zeros(257, bool)

    def __call__(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1  # the text begins with a separator, so there is always one
        symbol = self.text[before]
        at = np.flatnonzero(self.wanted[before] & (symbol > 0))
        total = np.minimum(self.least, lcp.min())
        if not len(at):
            self.least = total
            return
        symbol = symbol[at]
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        first = np.ones(len(at), bool)
        first[1:] = symbol[1:] != symbol[:-1]
        start = np.zeros(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[first] = 0
        table = _minima(lcp)
        value = _range_min(table, start, at)
        heads = symbol[first]
        value[first] = np.minimum(value[first], self.least[heads])
        value = np.minimum(value + 1, self.cap).astype(np.uint16)
        value[np.flatnonzero(first)[~self.seen[heads]]] = 0
        edges = np.append(np.flatnonzero(first), len(at))
        last = at[edges[1:] - 1]
        self.least = total
        rest = np.full(len(last), self.cap, np.uint16)
        more = last + 1 < len(lcp)
        rest[more] = _range_min(table, last[more] + 1, np.full(int(more.sum()), len(lcp) - 1))
        self.least[heads] = rest
        self.seen[heads] = True
        found = before[at]
        for c, a, b in zip(heads.tolist(), edges[:-1], edges[1:], strict=True):
            self.queues[c].push(found[a:b], value[a:b])


class InducedSorter:
    """Marks the positions of a text whose next ``length`` bytes occur at another position.

    The text is pieces of bytes (as 1..256), a separator 0 before the first and behind each.
    Separators differ from each other and are ordered by place."""

    def __init__(self, pieces: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] + 1
        self.text = np.zeros(int((sizes + 1).sum()) + 1, np.uint16)
        for at, p in zip(self.starts, pieces, strict=True):
            self.text[at : at + len(p)] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
        step = np.sign(np.diff(self.text.astype(np.int32), append=0))
        step[self.text == 0] = 1  # a separator counts as smaller than all that follows
        told = np.where(step != 0, np.arange(len(step)), len(step))
        told = np.minimum.accumulate(told[::-1])[::-1]
        self.rising = step[np.minimum(told, len(step) - 1)] > 0  # S type
        lms = self.rising.copy()
        lms[1:] &= ~self.rising[:-1]
        lms[0] = False
        self.lms = np.flatnonzero(lms)
        codes = np.concatenate([texts.EXACT_CODES, texts.mix(np.array([1 << 20], _U))])
        up, self.down = texts.POWERS.get(len(self.text))
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(codes[self.text] * up[: len(self.text)], dtype=_U)])
        ends = np.flatnonzero(self.text == 0)
        self.end = ends[np.searchsorted(ends, np.arange(len(self.text)))]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of two suffixes each, up to ``length``."""
        most = np.minimum(np.minimum(self.end[a] - a, self.end[b] - b), self.length)
        out = np.zeros(len(a), np.int64)
        step = 1 << int(self.length).bit_length() - 1
        while step:
            longer = out + step
            fits = np.flatnonzero(longer <= most)
            x, y, n = a[fits], b[fits], longer[fits]
            same = (self.sums[x + n] - self.sums[x]) * self.down[x] == (self.sums[y + n] - self.sums[y]) * self.down[y]
            out[fits[same]] = n[same]
            step >>= 1
        return out.astype(np.uint16)

    @staticmethod
    def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Split groups of equal rank by a key; returns the members of groups still tied."""
        order = np.lexsort((key, rank[active]))
        who, key = active[order], key[order]
        group = rank[who]
        place = np.arange(len(who))
        cut = np.ones(len(who), bool)
        cut[1:] = group[1:] != group[:-1]
        split = cut.copy()
        split[1:] |= key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(cut, place, 0))
        mine = np.maximum.accumulate(np.where(split, place, 0))
        rank[who] = group + mine - begin
        alone = split & np.append(split[1:], True)
        return who[~alone]

    def seeds(self) -> np.ndarray:
        """Leftmost-S positions in suffix order, as far as ``length`` bytes tell them apart.

        The pieces from one such position to the next are named by their symbols and types;
        the string of names is then sorted in the same way, names of twice the reach being
        pairs of names, until all are told apart or reach far enough."""
        pos, n = self.lms, len(self.lms)
        symbols = (self.text.astype(_U) << _U(1)) | self.rising.astype(_U)
        size = np.diff(pos, append=pos[-1]) + 1
        rank, active, depth = np.zeros(n, np.int64), np.arange(n), 0
        separators = self.text[pos] == 0
        while len(active):
            key = np.zeros(len(active), _U)
            for j in range(6):
                inside = depth + j < size[active]
                key = (key << _U(10)) | np.where(inside, symbols[np.minimum(pos[active] + depth + j, len(self.text) - 1)], _U(0))
            if depth == 0:
                key[separators] = np.arange(int(separators.sum()), dtype=_U)  # by place
            active = self._refine(rank, active, key)
            depth += 6
            active = active[depth < size[active]]
        order = np.argsort(rank, kind="stable")
        tied = np.ones(n, bool)
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[order] = np.append(same, False) | np.insert(same, 0, False)
        active, reach = np.flatnonzero(tied), 1
        while len(active):
            active = self._refine(rank, active, rank[np.minimum(active + reach, n - 1)])
            reach *= 2
            ahead = np.minimum(active + reach, n - 1)
            active = active[pos[ahead] - pos[active] < self.length]
        return pos[np.argsort(rank, kind="stable")]

    def repeated(self) -> np.ndarray:
        """Boolean per text position."""
        cap, marked = self.length, np.zeros(len(self.text), bool)
        seeds = self.seeds()
        seed_lcp = np.zeros(len(seeds), np.uint16)
        seed_lcp[1:] = self.common(seeds[:-1], seeds[1:])
        edges = np.searchsorted(self.text[seeds], np.arange(258))
        falling = _Scan(self.text, ~self.rising, cap)
        done = [SpillQueue() for _ in range(257)]
        for c in range(257):
            last = None
            while falling.queues[c]:
                for pos, lcp in falling.queues[c].take():
                    done[c].push(pos, lcp)
                    last = pos[-1:]
                    falling(pos, lcp)
            pos, lcp = seeds[edges[c] : edges[c + 1]], seed_lcp[edges[c] : edges[c + 1]].copy()
            if len(pos):
                lcp[0] = 0 if last is None else self.common(last, pos[:1])[0]
                falling(pos, lcp)
        rising = _Scan(self.text, self.rising, cap)
        for c in range(256, 0, -1):
            last = None
            while rising.queues[c]:
                for pos, lcp in rising.queues[c].take():
                    self._mark(marked, last, pos, lcp)
                    last = pos[-1:]
                    rising(pos, lcp)
            carried = None
            for pos, lcp in done[c].reversed():
                back = np.empty(len(pos), np.uint16)
                back[1:] = lcp[1:][::-1]
                if carried is not None:
                    back[0] = carried
                else:
                    back[0] = 0 if last is None else self.common(last, pos[-1:])[0]
                carried, pos = lcp[0], pos[::-1]
                self._mark(marked, last, pos, back)
                last = pos[-1:]
                rising(pos, back)
        return marked

    def _mark(self, marked: np.ndarray, last: np.ndarray | None, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Both sides of every pair of neighbours that agree far enough."""
        hit = np.flatnonzero(lcp >= self.length)
        marked[pos[hit]] = True
        marked[pos[hit[hit > 0] - 1]] = True
        if last is not None and len(hit) and hit[0] == 0:
            marked[last] = True


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(key, row, first window, last window) of the pieces of all rows of a batch, with the
    prefix hashes; window numbers count from the batch's first byte."""
    n, width = len(data), length - GRAM + 1
    half = (length - GRAM) // 2
    none = np.zeros(0, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - length
    if not (hi >= lo).any():
        return none.astype(_U), none, none, none, np.zeros(1, _U)
    sums = texts.prefix_hashes(data, texts.EXACT_CODES)
    grams = texts.span_hashes(sums, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    # Upper bits of the hash, then the place: the least is the leftmost of the least hashes.
    key = np.full(len(grams) + -len(grams) % width, np.iinfo(np.uint64).max, _U)
    key[: len(grams)] = (grams >> _U(31) << _U(31)) | np.arange(len(grams), dtype=_U)
    rows = key.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & _U((1 << 31) - 1)).astype(np.int64)
    inside = np.zeros(count + 1, np.int64)
    ok = hi >= lo
    np.add.at(inside, lo[ok], 1)
    np.add.at(inside, hi[ok] + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[:count] > 0)
    anchor = anchor[windows]
    # A window holds half of its other bytes left of the anchor, or else right of it.
    right = anchor - windows < half
    place = 2 * anchor + right
    new = np.ones(len(windows), bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = windows[at], windows[np.append(at[1:], len(windows)) - 1]
    a, r = anchor[at], right[at]
    keys = texts.span_hashes(sums, np.where(r, a, a - half), np.where(r, a + GRAM + half, a + GRAM)) ^ r.astype(_U)
    return keys, np.searchsorted(offsets, first, side="right") - 1, first, last, sums


def _pieces(rows: DataFrame, length: int, only_keys: bool) -> DataFrame:
    """(key, and unless ``only_keys`` digest, doc, row, a, b): pieces of every text; windows
    a..b of row ``row`` of document ``doc``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "text", 1 << 20):
            data, offsets = texts.utf8(batch.column("text"))
            keys, row, first, last, sums = _windows(data, offsets, length)
            if not len(keys):
                continue
            out = {"key": keys.view(np.int64)}
            if not only_keys:
                out["digest"] = texts.span_hashes(sums, first, last + length).view(np.int64)
                at = pa.array(row)
                out |= {"doc": batch.column("doc").take(at), "row": batch.column("row").take(at)}
                out |= {"a": first - offsets[row], "b": last - offsets[row]}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, "key long" if only_keys else "key long, digest long, doc long, row long, a long, b long")


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces listed with each text."""
    for batch in texts.slices(batches, "text"):
        data, offsets = texts.utf8(batch.column("text"))
        listed = batch.column("pieces")
        owner = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy())
        flat = listed.flatten()
        a = flat.field("a").to_numpy() + offsets[owner]
        b = flat.field("b").to_numpy() + offsets[owner] + length
        raw = data.tobytes()
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [flat.field("key"), flat.field("n"), batch.column("doc").take(at), batch.column("row").take(at), flat.field("a"),
             pa.array([raw[i:j] for i, j in zip(a, b, strict=True)], pa.binary())],
            names=["key", "n", "doc", "row", "a", "piece"],
        )


def _sort_shards(batches: Iterator[pa.RecordBatch], length: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Spans of single pieces whose windows occur in another piece of the same key. Pieces
    come sorted by key; a shard ends at the first new key beyond ``shard_bytes``."""
    held: list[tuple] = []
    size, key = 0, None

    def spans() -> pa.RecordBatch:
        docs, rows, begins, ends = [], [], [], []
        sorter = InducedSorter([h[4] for h in held], length)
        marked = sorter.repeated()
        for (n, doc, row, a, piece), start in zip(held, sorter.starts, strict=True):
            if n > 1:
                continue  # copies are repeated throughout
            mine = np.concatenate([[0], marked[start : start + len(piece)].view(np.int8), [0]])
            edge = np.flatnonzero(np.diff(mine))
            for i, j in zip(edge[::2], edge[1::2], strict=True):
                docs.append(doc)
                rows.append(row)
                begins.append(a + int(i))
                ends.append(a + int(j) - 1 + length)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, rows, begins, ends)], names=["doc", "row", "a", "b"])

    for batch in batches:
        for k, *item in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "doc", "row", "a", "piece")), strict=True):
            if k != key and size >= shard_bytes:
                yield spans()
                held, size = [], 0
            key = k
            held.append(item)
            size += len(item[4])
    if held:
        yield spans()


def repeated_spans(docs: DataFrame, length: int, key: str, text: str, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows as doc, row, text; spans doc, row, a, b): bytes a..b-1 of a row are covered.

    ``row`` tells rows with one id apart by their text; equal rows have equal spans."""
    rows = docs.select(
        F.col(key).cast("long").alias("doc"), F.xxhash64(key, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    long_enough = rows.filter(F.octet_length("text") >= length)
    # Keys met once are most; only they are shuffled first, and combined before that.
    often = _pieces(long_enough, length, True).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    pieces = materialise(_pieces(long_enough, length, False).join(often, "key"), "pieces")

    folded = pieces.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row", "a", "b")).alias("one"))
    folded = materialise(folded.select("key", "digest", "n", "one.*"), "folded")
    copied = folded.filter("n > 1").select(F.col("key").alias("k"), F.col("digest").alias("d"))
    whole = pieces.join(copied, (pieces["key"] == copied["k"]) & (pieces["digest"] == copied["d"]))
    whole = whole.select("doc", "row", "a", (F.col("b") + length).alias("b"))

    mixed = folded.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("key")
    listed = folded.join(mixed, "key").groupBy("doc", "row").agg(F.collect_list(F.struct("key", "n", "a", "b")).alias("pieces"))
    listed = listed.select(F.col("doc").alias("d"), F.col("row").alias("r"), "pieces")
    # Copied rows bear the same (doc, row): one of them gives the bytes of all.
    texts_of = long_enough.join(listed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r"))).drop("d", "r")
    bodies = texts_of.mapInArrow(lambda it: _cut(it, length), "key long, n long, doc long, row long, a long, piece binary")
    shards = bodies.repartition("key").sortWithinPartitions("key")
    sorted_spans = shards.mapInArrow(lambda it: _sort_shards(it, length, shard_bytes), "doc long, row long, a long, b long")
    return rows, materialise(whole.unionByName(sorted_spans), "spans")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, bytes removed, removed runs, bytes kept) of every row."""
    data, offsets = texts.utf8(batch.column("text"))
    spans = batch.column("spans")
    for i in range(len(batch)):
        own = data[offsets[i] : offsets[i + 1]]
        if not spans[i].is_valid:
            yield len(own), 0, 0, own.tobytes()
            continue
        a, b = (spans[i].values.field(k).to_numpy() for k in (0, 1))
        edge = np.zeros(len(own) + 1, np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
        gone = np.cumsum(edge[:-1]) > 0
        runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        yield len(own), int(gone.sum()), runs, own[~gone].tobytes()


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` are the
    bytes that no string of ``length`` bytes occurring twice or more in the input covers.

    Texts are UTF-8 bytes, null ones empty; matches lie within one row's text, the other
    occurrence in the same or another row. A cut can part a character, so ``kept`` is
    binary. Texts shorter than ``length`` stay whole, also those of rows without an id;
    repeated rows cover each other; an empty table gives no rows. Windows are grouped by
    64-bit hashes of their content and compared under them by suffix order.
    """
    rows, spans = repeated_spans(docs, length, key, text, shard_bytes)
    listed = spans.groupBy("doc", "row").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    listed = listed.select(F.col("doc").alias("d"), F.col("row").alias("r"), "spans")
    joined = rows.join(listed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "text"):
            found = list(_kept(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3)),
                 pa.array([hashlib.sha256(f[3]).hexdigest() for f in found]), pa.array([f[3] for f in found], pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    out = joined.mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("doc", key)
