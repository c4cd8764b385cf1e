"""Exact Jaccard self join of word shingle sets by PartEnum signatures, and its components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.operators.components import connected_components
from docmine.session import drop_finished_shuffles, materialise, release

_U = np.uint64
#: Bits that a signature is sent without. They cannot be compressed and are most of what is
#: shuffled; the 48 left make unlike sets meet once in 2**48 pairs, and all are verified.
SPARED = _U(16)
#: Sets whose signatures a task remembers having sent.
SENT = 200_000
#: Set elements in a block when the documents of a family are compared block against block.
BLOCK = 1 << 18
#: Cuts of the domain that a set with many empty parts goes through.
DRAWS = 6
#: Bits of the map of documents whose texts go to tiles; 1 MB whatever their number.
MAP_BITS, MAP_PAGE = 1 << 23, 1 << 15


@lru_cache
def size_bands(percent: int, top: int) -> tuple[tuple[int, int], ...]:
    """Size bands [low, high] up to ``top``: sets that link lie in one band or in neighbours."""
    bands, low = [], 1
    while low <= top:
        high = low * 100 // percent
        bands.append((low, high))
        low = high + 1
    return tuple(bands)


def band_parameters(high: int, percent: int) -> tuple[int, int]:
    """(differences k that two linked sets of at most ``high`` elements can have, parts).

    Linked sets of sizes a and b differ in at most (100-p)(a+b)/(100+p) elements, so of k + 1
    parts with elements one is the same in both. Some parts to spare make up for parts that
    get no element (see ``signatures``)."""
    k = (100 - percent) * 2 * high // (100 + percent)
    return k, 1 if k == 0 else k + 2 + k // 24 + isqrt(k) // 2


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """PartEnum signatures of one set of 64-bit hashes, for its own size band and the next.

    The domain is cut into parts, and of every subset of all but k parts one could be the
    same; with parts as small as these it is enough to enumerate single ones. An empty part
    says nothing and would meet all sets. It is left out if more than k parts have elements,
    since one of those is then without a difference, and filled in the other set too. Of two
    linked sets that both have fewer filled parts, both go on to the next of ``DRAWS`` cuts;
    only a set with as few under every cut sends its empty parts.
    """
    n = len(elements)
    if not n:
        return np.zeros(0, _U)
    bands = size_bands(percent, n)
    out = []
    weight = texts.mix(elements ^ _U(0x5BF03635))
    for b in (len(bands), len(bands) + 1):
        high = bands[-1][1] if b == len(bands) else (bands[-1][1] + 1) * 100 // percent
        k, parts = band_parameters(high, percent)
        tag = texts.mix(np.array([b], _U))
        if k == 0:
            out.append(texts.mix(weight.sum(dtype=_U, keepdims=True) ^ tag))
            continue
        for draw in range(DRAWS):
            place = elements if draw == 0 else texts.mix(elements + _U(draw))
            part = (((place >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
            order = None if draw == 0 else np.argsort(part, kind="stable")
            run = np.concatenate([np.zeros(1, _U), np.cumsum(weight if order is None else weight[order], dtype=_U)])
            cut = np.searchsorted(part if order is None else part[order], np.arange(parts + 1))
            value, filled = run[cut[1:]] - run[cut[:-1]], np.diff(cut) > 0
            label = texts.mix(np.arange(draw * parts, (draw + 1) * parts, dtype=_U) + tag)
            sig = texts.mix(texts.mix(value + tag) ^ label)
            enough = np.count_nonzero(filled) > k
            out.append(sig if draw == DRAWS - 1 and not enough else sig[filled])
            if enough:
                break
    return np.concatenate(out)


def _digest(elements: np.ndarray) -> tuple[int, int]:
    one = int(texts.mix(elements ^ _U(0x1234567)).sum(dtype=_U)) ^ len(elements)
    two = int(texts.mix(elements ^ _U(0x89ABCDE)).sum(dtype=_U))
    return one, two


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parity_sketch(elements: np.ndarray) -> np.ndarray:
    """A bit for each of about as many buckets as the set has elements: whether the bucket
    holds an odd number of them. Sketches of two sets differ in no more bits than the sets
    in elements. Half of a sketch laid over the other half is the next smaller sketch."""
    buckets = max(64, 1 << (len(elements) - 1).bit_length())
    place = (texts.mix(elements ^ _U(0x2545F491)) & _U(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=buckets) & 1).astype(np.uint8), bitorder="little").view(_U)


def may_link(sketches: list[np.ndarray], sizes: np.ndarray, docs: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of a tile some other document's set in the other block (or, if there is one
    block, in it) may be linked with, as far as sketches can tell. No link is missed."""
    keep = np.zeros(len(docs), bool)
    rows = np.flatnonzero(~second)
    cols = np.flatnonzero(second) if second.any() else rows
    levels = np.array([len(s) for s in sketches], np.int64)

    def folded(some: np.ndarray, level: int) -> np.ndarray:
        drawn = np.stack([sketches[i] for i in some])
        while drawn.shape[1] > level:
            drawn = drawn[:, : drawn.shape[1] // 2] ^ drawn[:, drawn.shape[1] // 2 :]
        return drawn

    for a, b in product(np.unique(levels[rows]), np.unique(levels[cols])):
        left, right = rows[levels[rows] == a], cols[levels[cols] == b]
        right = right[np.argsort(sizes[right], kind="stable")]
        lows = np.searchsorted(sizes[right], -(-percent * sizes[left] // 100))
        highs = np.searchsorted(sizes[right], 100 * sizes[left] // percent, side="right")
        if not (lows < highs).any():
            continue
        x, y = folded(left, min(a, b)), folded(right, min(a, b))
        for i, own, lo, hi in zip(left, x, lows, highs, strict=True):
            near = right[lo:hi]
            differ = np.bitwise_count(y[lo:hi] ^ own).sum(1, dtype=np.int64)
            allowed = (sizes[i] + sizes[near]) * (100 - percent) // (100 + percent)
            near = near[(differ <= allowed) & (docs[near] != docs[i])]
            if len(near):
                keep[i] = True
                keep[near] = True
    return keep


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """(doc, n, d1, d2, sketch): set size, set digest and parity sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.slices(batches, "_text"):
            data, offsets = texts.utf8(batch.column("_text"))
            sets = list(texts.shingle_sets(data, offsets, words))
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {"doc": batch.column("_doc"), "n": np.array([len(s) for s in sets], np.int64),
                 "d1": pa.array([_signed(d[0]) for d in digests], pa.int64()), "d2": pa.array([_signed(d[1]) for d in digests], pa.int64()),
                 "sketch": pa.array([parity_sketch(s).tobytes() for s in sets], pa.binary())}
            )

    return docs.mapInArrow(run, "doc long, n long, d1 long, d2 long, sketch binary")


def signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, doc); a set met before in the same task sends nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in texts.slices(batches, "_text"):
            data, offsets = texts.utf8(batch.column("_text"))
            found, owners = [], []
            for doc, elements in zip(batch.column("_doc").to_pylist(), texts.shingle_sets(data, offsets, words), strict=True):
                digest = _digest(elements)
                if doc is None or not len(elements) or digest in sent:
                    continue
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(digest)
                sigs = signatures(elements, percent)
                found.append(sigs)
                owners.append(np.full(len(sigs), doc, np.int64))
            if found:
                yield pa.RecordBatch.from_pydict(
                    {"sig": (np.concatenate(found) >> SPARED).view(np.int64), "doc": np.concatenate(owners)}
                )

    return docs.mapInArrow(run, "sig long, doc long")


def _tile_links(tile: pa.Table, words: int, percent: int) -> pa.Table:
    """Links between a tile's two blocks (or within one), as many as join its documents. A
    document is not compared with those that earlier links have joined it to."""
    sets = list(texts.shingle_sets(*texts.utf8(tile.column("_text").combine_chunks()), words))
    some = np.array([len(s) > 0 for s in sets])
    docs = tile.column("doc").to_numpy()[some]
    second = tile.column("second").to_numpy(zero_copy_only=False)[some]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets], np.int64)
    _, place = np.unique(np.concatenate([np.zeros(0, _U), *sets]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows, one = np.flatnonzero(~second), not second.any()
    cols = rows if one else np.flatnonzero(second)
    _, joined = np.unique(docs, return_inverse=True)
    held, found = np.zeros(int(place.max(initial=0)) + 1, np.int32), []
    for i in rows:
        open_ = cols[joined[cols] != joined[i]]
        if not len(open_):
            continue
        own = place[starts[i] : starts[i + 1]]
        held[own] = 1
        body = np.concatenate([place[starts[j] : starts[j + 1]] for j in open_])
        common = np.add.reduceat(held[body], np.cumsum(sizes[open_]) - sizes[open_])
        held[own] = 0
        for j in open_[100 * common >= percent * (sizes[i] + sizes[open_] - common)]:
            if joined[j] != joined[i]:
                joined[joined == joined[j]] = joined[i]
                found.append((docs[i], docs[j]))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def _tile_candidates(tile: pa.Table, percent: int) -> pa.Table:
    """The rows of a tile whose sets some other document's set may be linked with."""
    sketches = [np.frombuffer(s, _U) for s in tile.column("sketch").to_pylist()]
    docs, sizes = tile.column("doc").to_numpy(), tile.column("n").to_numpy()
    keep = may_link(sketches, sizes, docs, tile.column("second").to_numpy(zero_copy_only=False), percent)
    return tile.filter(pa.array(keep)).drop_columns(["n", "sketch"])


def rows_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``_doc`` is not among ``ids`` (doc): a map of hashed
    ids, as large for any number of them, goes to where the rows are."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    page = ids.select(place("doc").alias("p")).groupBy(F.floor(F.col("p") / MAP_PAGE).alias("_page"))
    pages = page.agg(F.bitmap_construct_agg(F.col("p") % MAP_PAGE).alias("_bits"))
    placed = rows.withColumn("_p", place("_doc"))
    byte = F.floor(F.col("_p") % MAP_PAGE / 8).cast("int")
    value = F.conv(F.hex(F.substring("_bits", byte + 1, F.lit(1))), 16, 10).cast("int")
    on = F.call_function("shiftright", value, (F.col("_p") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    # At most 256 pages of 4 KB.
    met = placed.join(F.broadcast(pages), F.floor(F.col("_p") / MAP_PAGE) == F.col("_page"))
    return met.filter(on).select(*rows.columns)


def family_links(families: DataFrame, rows: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """Links among the documents of families (hub, doc, n), verified exactly.

    A family is sorted by set size and cut into blocks of about ``BLOCK`` elements; a task
    compares two blocks whose sizes can link, set against set, and gives the links that join
    them. A family of any size is spread over its pairs of blocks, and a pair of documents is
    never a row. Sketches (doc, n, sketch), an eighth of a byte per element, go to the tiles
    first; only documents that they leave a partner have their texts sent."""
    before = Window.partitionBy("hub").orderBy("n", "doc").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK)
    members = materialise(families.select(F.col("hub").alias("family"), "doc", "n", block.alias("block")), "members")

    blocks = members.groupBy("family", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    left = blocks.select("family", F.col("block").alias("x"), F.col("most").alias("x_most"))
    right = blocks.select("family", F.col("block").alias("y"), F.col("least").alias("y_least"))
    tiles = left.join(right, "family").filter((F.col("x") <= F.col("y")) & (100 * F.col("x_most") >= percent * F.col("y_least")))
    sides = tiles.select("family", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    placed = sides.join(members, ["family", "block"]).select("family", "x", "y", "doc", (F.col("block") > F.col("x")).alias("second"))
    small = sketches.select(F.col("doc").alias("d"), "n", "sketch").distinct()
    drawn = placed.hint("merge").join(small, F.col("doc") == F.col("d")).select("family", "x", "y", "doc", "second", "n", "sketch")
    kept = drawn.groupBy("family", "x", "y").applyInArrow(
        lambda t: _tile_candidates(t, percent), "family long, x long, y long, doc long, second boolean"
    )
    candidates = materialise(kept.distinct(), "candidates")
    release(members)

    # Texts travel and sets are made in the tile: a text is smaller than its set. The list of
    # documents has no bound, so it is merged with the texts at every size.
    sent = rows_of(rows, candidates)
    filled = candidates.hint("merge").join(sent, F.col("doc") == F.col("_doc")).select("family", "x", "y", "doc", "second", "_text")
    links = filled.groupBy("family", "x", "y").applyInArrow(lambda t: _tile_links(t, words, percent), "a long, b long")
    stored = materialise(links.distinct(), "links")
    release(candidates)
    return stored


def link_components(
    docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of the links between
    documents whose shingle sets have 100 * intersection >= percent * union.

    Documents that link share a PartEnum signature. Each signature group ties its members to
    its least member, its hub, and through it to the hub's own least hub, around which first
    sketches and then sets are compared exactly, block against block (see ``family_links``),
    so no link is missed. Equal sets are linked by digest, and one of them stands for all that
    a task met.

    Words are runs without ASCII white space, A-Z folded. Null and empty texts have no set
    and link with nothing, nor do rows without an id, whose component is null. Ids are cast
    to long. Rows that share an id are one vertex. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"))
    sized = materialise(set_sizes(rows, words), "set-sizes")
    known = sized.filter("n > 0 AND doc IS NOT NULL")
    least = known.groupBy("d1", "d2").agg(F.min("doc").alias("rep"))
    reps = known.join(least, ["d1", "d2"]).select("doc", "rep").distinct()
    copies = materialise(reps.filter("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")), "copies")

    sent = signature_rows(rows, words, percent)
    group = Window.partitionBy("sig").orderBy("doc")
    # Members come sorted, so the first is the hub; a hub without a next member is alone.
    so_far = group.rowsBetween(Window.unboundedPreceding, 0)
    near = sent.withColumns({"hub": F.first("doc").over(so_far), "more": F.lead("doc").over(group)})
    met = materialise(near.filter("more IS NOT NULL OR hub <> doc").select("hub", "doc").distinct(), "met")
    drop_finished_shuffles(docs.sparkSession)
    sizes = sized.filter("n > 0").select(F.col("doc").alias("d"), "n").distinct()
    # A hub passes its members on to its own least hub: documents that meet still do, and most
    # are in one family then, to which their set is sent once.
    up = met.groupBy(F.col("doc").alias("of")).agg(F.min("hub").alias("root"))
    passed = met.join(up, F.col("hub") == F.col("of")).select(F.col("root").alias("hub"), "doc").distinct()
    families = materialise(passed.join(sizes, F.col("doc") == F.col("d")).select("hub", "doc", "n"), "families")
    release(met)

    links = family_links(families, rows, sized.filter("n > 0 AND doc IS NOT NULL"), words, percent)
    labels = materialise(connected_components(links.unionByName(copies), "a", "b"), "labels")
    release(families, links, copies)
    named = sized.join(labels, sized["doc"] == labels["vertex"], "left")
    return named.select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc")).alias("component_id"),
    )


def keep_one_per_component(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the members of a component other than its smallest id. Rows without
    an id or without words stay."""
    found = link_components(docs, words, percent, key=key, text=text)
    gone = found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__dm_gone")).distinct()
    return docs.join(gone, docs[key] == gone["__dm_gone"], "left_anti")
