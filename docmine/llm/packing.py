"""Packing of tokenised documents into fixed-size windows with bounded open space."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmine.llm import texts
from docmine.session import materialise

#: Unicode white space; a space joins the word behind it, other white space stands alone.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: White space that is not a lone space or line feed between two words.
_ODD = re.compile("[ \n]{2}|^[ \n]|[ \n]\\Z|[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Chunks a worker remembers; when there are more, the older half goes.
CACHE = 900_000
# Fixed value: the pattern by which a byte-level tokenizer splits a text before it merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(definition: str) -> tuple[tiktoken.Encoding, np.ndarray] | None:
    """The same vocabulary for a faster merger, with the bytes of each id, if the tokenizer
    is plain byte-level BPE whose merges come in the order of their ids; else None."""
    spec = json.loads(definition)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not spec["normalizer"] and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    if not plain or cut.get("type") != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or len(merged) + 256 != len({*vocab} - {t["content"] for t in spec["added_tokens"]}):
        return None
    # Printable bytes stand for themselves, the others for letters from 256 up.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranked", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}), sizes


class Encoder:
    """Ids of whole texts, as little-endian 32-bit blobs.

    A byte-level tokenizer splits at white space before it merges, so a text is encoded as
    the concatenation of its chunks, and a chunk seen before comes from memory. A chunk is a
    word with the space or line feed before it; new ones are merged in one go (``ranked``). Texts with other white space are cut by
    pattern; texts that hold an added token's string go through the tokenizer whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.seen: dict[str, bytes] = {}
        self.ranked = ranked(definition)

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _chunks(self, text: str) -> list[str] | None:
        """Chunks named by themselves, but for those behind a space, which go without it."""
        if self.special and self.special.search(text):
            return None
        if not text or _ODD.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in " \n" else f"\0{c}" for c in _CHUNK.findall(text)]
        chunks = text.replace("\n", " \n").split(" ")
        chunks[0] = f"\0{chunks[0]}"
        return chunks

    def _learn(self, chunks: list[str]) -> None:
        """Encode many chunks as one text; each begins with white space, so none affects another."""
        for i in range(0, len(chunks), 4000):
            part = chunks[i : i + 4000]
            spelled = [c if c[0] == "\n" else f" {c}" for c in part]
            if self.ranked:
                merger, sizes = self.ranked
                found = np.array(merger.encode_ordinary("".join(spelled)), "<u4")
                ends = np.cumsum([len(c.encode()) for c in spelled])
                cut = np.searchsorted(np.cumsum(sizes[found]), ends) + 1
            else:
                encoded = self.tokenizer.encode("".join(spelled), add_special_tokens=False)
                found = np.array(encoded.ids, "<u4")
                ends = np.cumsum([len(c) for c in spelled])
                cut = np.searchsorted(np.array([a for a, _ in encoded.offsets]), ends)
            ids, cut = found.tobytes(), (4 * cut).tolist()
            self.seen.update(zip(part, (ids[a:b] for a, b in zip([0, *cut], cut, strict=False)), strict=True))

    def encode(self, batch: list[str]) -> list[bytes]:
        chunks = [None if "\0" in t else self._chunks(t) for t in batch]
        if len(self.seen) > CACHE:
            for old in list(islice(self.seen, len(self.seen) // 2)):
                del self.seen[old]
        parts = [None if c is None else list(map(self.seen.get, c)) for c in chunks]
        holes = [None if p is None else [i for i, x in enumerate(p) if x is None] for p in parts]
        new = {c[i] for c, hole in zip(chunks, holes, strict=True) if hole for i in hole}
        alone = [c for c in new if c[0] == "\0"]
        self.seen.update(zip(alone, self._ids([c[1:] for c in alone]), strict=True))
        self._learn([c for c in new if c[0] != "\0"])
        for c, p, hole in zip(chunks, parts, holes, strict=True):
            for i in hole or ():
                p[i] = self.seen[c[i]]
        return [self._ids([t])[0] if p is None else b"".join(p) for t, p in zip(batch, parts, strict=True)]


@lru_cache(maxsize=1)
def encoder_of(definition: str) -> Encoder:
    """One encoder per worker, which keeps its memory from task to task."""
    return Encoder(definition)


class OpenWindows:
    """A fixed number of open windows. An item goes into the window that it fills best; when
    none has room and all places are taken, the fullest window is emitted."""

    def __init__(self, size: int, places: int):
        self.size, self.places, self.number = size, places, 0
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.items: dict[int, list] = {}

    def put(self, length: int, item) -> list | None:
        """Place an item; returns a window's items when one had to be emitted."""
        at, out = bisect_left(self.room, (length, -1)), None
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.places:
                out = self.items.pop(self.room.pop(0)[1])
            room, window = self.size, self.number
            self.number += 1
            self.items[window] = []
        self.items[window].append((item, self.size - room))
        if room > length:
            insort(self.room, (room - length, window))
            return out
        full = self.items.pop(window)
        return full if out is None else out + [None] + full

    def rest(self) -> Iterator[list]:
        yield from self.items.values()


def _windows(emitted: list | None) -> Iterator[list]:
    """The windows in what ``put`` returned."""
    while emitted:
        if None in emitted:
            cut = emitted.index(None)
            yield emitted[:cut]
            emitted = emitted[cut + 1 :]
        else:
            yield emitted
            return


PIECE = "doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


def _pack_partition(definition, size: int, places: int, key_type: pa.DataType):
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = encoder_of(definition.value), OpenWindows(size, places)
        base, count = TaskContext.get().partitionId() << 32, 0

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
            kinds = [key_type] + [pa.int64()] * 6 + [pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=columns)

        for part in texts.slices(batches, "_text"):
            rows = []
            blobs = encoder.encode([t or "" for t in part.column("_text").to_pylist()])
            for doc, blob in zip(part.column("_doc").to_pylist(), blobs, strict=True):
                blob += bytes(4)
                total = len(blob) // 4
                for start in range(0, total, size):
                    length = min(size, total - start)
                    piece = (doc, start, length, zlib.crc32(blob[4 * start : 4 * (start + length)]), total)
                    for done in _windows(windows.put(length, piece)):
                        rows += [(*p, base + count, at, False) for p, at in done]
                        count += 1
            yield batch(rows)
        rows = []
        for left in windows.rest():
            rows += [(*p, base + count, at, True) for p, at in left]
            count += 1
        yield batch(rows)

    return run


def _merge_partition(size: int, places: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = OpenWindows(size, places)
        base, count = (level << 56) + (TaskContext.get().partitionId() << 32), 0

        def batch(rows):
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["old", "new", "at", "fill", "left"]
            )

        for part in batches:
            rows = []
            for old, fill in sorted(zip(*(part.column(c).to_pylist() for c in ("cur", "fill")), strict=True), key=lambda x: -x[1]):
                for done in _windows(windows.put(fill, (old, fill))):
                    rows += [(w, base + count, at, at + n, False) for (w, n), at in done]
                    count += 1
            yield batch(rows)
        rows = []
        for left in windows.rest():
            rows += [(w, base + count, at, at + n, True) for (w, n), at in left]
            count += 1
        yield batch(rows)

    return run


def pack(
    docs: DataFrame, tokenizer_json: str, size: int = 1024, places: int = 128, fan_in: int = 16, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A document is its text's ids and a closing id 0, cut at every ``size`` ids. Each
    partition packs its pieces online: at most ``places`` windows are open, a piece goes
    where it leaves the least room, the fullest window is emitted when none has room. The
    windows left open are themselves packed in the same way, ``fan_in`` partitions into one
    at a time, until one partition's worth is left, so memory is bounded throughout.

    Null and empty texts are one token; null ids and repeated rows are packed like others;
    an empty table gives no pieces. ``tokenizer_json`` is read on the driver, its bytes are
    shipped to the tasks.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    kind = rows.schema["_doc"].dataType.simpleString()
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    pieces = materialise(
        rows.mapInArrow(_pack_partition(definition, size, places, key_type), PIECE.format(key=kind)), "pieces"
    )
    left = pieces.filter("open").groupBy("window").agg(F.sum("length").alias("fill"))
    state = materialise(
        left.select(F.col("window").alias("first"), F.col("window").alias("cur"), F.lit(0).cast("long").alias("base"), "fill", F.lit(True).alias("left")),
        "open-windows",
    )
    tasks, level = pieces.filter("open").select(F.col("window").bitwiseAND(-1 << 32)).distinct().count(), 1
    while True:
        tasks = max(1, -(-tasks // fan_in))
        # Windows that were merged count once, by the window they are in now.
        open_now = state.filter("left").groupBy("cur").agg(F.max("fill").alias("fill"))
        merged = open_now.repartition(tasks, "cur").mapInArrow(
            _merge_partition(size, places, level), "old long, new long, at long, fill long, left boolean"
        )
        merged = materialise(merged, "merged")
        total = merged.groupBy("new").agg(F.max("fill").alias("fill"))
        merged = merged.drop("fill").join(total, "new")
        moved = state.filter("left").drop("fill", "left").join(merged, F.col("cur") == F.col("old"))
        moved = moved.select("first", F.col("new").alias("cur"), (F.col("base") + F.col("at")).alias("base"), "fill", "left")
        state = materialise(state.filter("NOT left").unionByName(moved), "open-windows")
        if tasks == 1:
            break
        level += 1
    place = state.select("first", "cur", "base")
    return pieces.join(place, F.col("window") == F.col("first"), "left").select(
        F.col("doc_id").alias(key), "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("cur", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )
