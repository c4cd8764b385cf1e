"""Token id sequences: vocabulary, encoding, decoding and checks.

Sequences are written, read and checked in Arrow batches: a lambda of column expressions takes
longer for an id than a batch takes for all ids of a row."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmine.functions import structures as S
from docmine.functions.binding import let
from docmine.functions.runs import remembered

# Special tokens and the signs that follow letters and digits.
SPECIAL = ("<PAD>", "<SOS>", "<EOS>", "<UNK>")
SIGNS = ("[", "]", "(", ")", "=", "#", "@", "+", "-", "/", "\\", ".", "%")
CHARACTERS = (*string.ascii_uppercase, *string.ascii_lowercase, *string.digits, *SIGNS)
PAD, SOS, EOS, UNK = range(4)
FIRST_CHAR = len(SPECIAL)
FIRST_X = FIRST_CHAR + len(CHARACTERS)
DEFAULT_BINS = 64


def first_y(n_bins: int = DEFAULT_BINS) -> int:
    return FIRST_X + n_bins


def vocabulary(spark, n_bins: int = DEFAULT_BINS):
    """(token_id, token, kind) rows; their number is fixed by the bin count."""
    names = [(t, "special") for t in SPECIAL] + [(c, "character") for c in CHARACTERS]
    names += [(f"<{axis}_BIN_{i}>", axis.lower()) for axis in "XY" for i in range(n_bins)]
    rows = [(i, token, kind) for i, (token, kind) in enumerate(names)]
    return spark.createDataFrame(rows, "token_id int, token string, kind string")


def _alphabet() -> Column:
    return F.lit("".join(CHARACTERS))


def char_id(c: Column) -> Column:
    """Place in the alphabet behind the specials; a place of 0, a sign that is not in it, gives
    the unknown mark, which is the special before the first character."""
    return F.instr(_alphabet(), c) + F.lit(UNK)


def char_ids(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char_id)


def is_x(t: Column, n_bins: int = DEFAULT_BINS) -> Column:
    return (t >= FIRST_X) & (t < FIRST_X + n_bins)


def is_y(t: Column, n_bins: int = DEFAULT_BINS) -> Column:
    return (t >= first_y(n_bins)) & (t < first_y(n_bins) + n_bins)


def token_kind(t: Column, n_bins: int = DEFAULT_BINS) -> Column:
    return (
        F.when(is_x(t, n_bins), "x")
        .when(is_y(t, n_bins), "y")
        .when((t >= FIRST_CHAR) & (t < FIRST_X), "character")
        .otherwise("special")
    )


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def flat_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(entries of all lists, offsets); a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), offsets(sizes)


def _list_of(cuts: np.ndarray, values: pa.Array, like: pa.Array | None = None) -> pa.Array:
    """Lists of values, null where ``like`` is."""
    made = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
    return made if like is None or not like.null_count else pc.if_else(like.is_valid(), made, pa.scalar(None, made.type))


#: Stand for the x and the y bin of an atom until the bins are filled in.
_X, _Y = -1, -2
_IDS = {c: i + FIRST_CHAR for i, c in enumerate(CHARACTERS)}


def _token_ids(token: str) -> bytes:
    ids = [_IDS.get(c, UNK) for c in token]
    return np.array(ids + [_X, _Y] if token[0] in "[*" or token[0].isalpha() else ids, np.int32).tobytes()


def write_ids(texts: list[str | None], x: np.ndarray, y: np.ndarray, cuts: np.ndarray, n_bins: int = DEFAULT_BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, offsets, atoms per text). ``x`` and ``y`` are bins in atom order, cut
    per text at ``cuts``; atoms beyond them take bin 0."""
    find, ids_of = S._FIND_TOKENS.findall, remembered(_token_ids)
    start, end = (np.array([t], np.int32).tobytes() for t in (SOS, EOS))
    rows = [b"" if t is None else b"".join([start, *[ids_of[k] for k in find(t)], end]) for t in texts]
    ends = offsets(np.array([len(r) // 4 for r in rows], np.int64))
    ids = np.frombuffer(bytearray(b"".join(rows)), np.int32)
    at = np.flatnonzero(ids == _X)
    first = np.searchsorted(at, ends)
    atoms = np.diff(first)
    owner = np.repeat(np.arange(len(rows)), atoms)
    place = np.arange(len(at)) - first[:-1][owner]
    given = place < np.diff(cuts)[owner]
    source = (cuts[:-1][owner] + place)[given]
    for values, base, lag in ((x, FIRST_X, 0), (y, first_y(n_bins), 1)):
        bins = np.zeros(len(at), np.int64)
        bins[given] = np.clip(values[source], 0, n_bins - 1)
        ids[at + lag] = bins + base
    return ids, ends, atoms


def encode(structure: Column, bins: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """Ids: start, characters of each token, its x and y bin after an atom, end. ``bins`` is
    ``array<struct<x,y>>`` in atom order; atoms beyond it take bin 0."""

    @F.arrow_udf("array<int>")
    def written(texts: pa.Array, places: pa.Array) -> pa.Array:
        flat, cuts = flat_lists(places)
        x, y = (pc.fill_null(pc.struct_field(flat, [axis]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for axis in "xy")
        ids, ends, _ = write_ids(texts.to_pylist(), x, y, cuts, n_bins)
        return _list_of(ends, pa.array(ids), texts)

    return written(structure, F.coalesce(bins, F.array().cast("array<struct<x:int,y:int>>")))


def decode_text(ids: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """Ids up to the end mark as text: characters as themselves, an x bin as ``{n,`` and a y
    bin as ``n}``; specials vanish."""
    stop = F.filter(F.transform(ids, lambda t, i: F.when(t.isin(EOS, PAD), i)), lambda i: i.isNotNull())
    kept = F.slice(ids, F.lit(1), F.coalesce(F.try_element_at(stop, F.lit(1)), F.size(ids)))
    shown = F.transform(
        kept,
        lambda t: F.when(is_x(t, n_bins), F.concat(F.lit("{"), (t - FIRST_X).cast("string"), F.lit(",")))
        .when(is_y(t, n_bins), F.concat((t - first_y(n_bins)).cast("string"), F.lit("}")))
        .when((t >= FIRST_CHAR) & (t < FIRST_X), F.substring(_alphabet(), t - FIRST_CHAR + 1, F.lit(1)))
        .otherwise(""),
    )
    return F.array_join(shown, "")


ATOM_WITH_PLACE = r"(\[[^\]{}]*\]?|Cl|Br|se|te|[A-Za-z])\{(\d+),(\d+)\}"
_PLACED = re.compile(ATOM_WITH_PLACE, re.ASCII)
_PAIRED = re.compile(ATOM_WITH_PLACE.replace(r"(\d+),(\d+)", ""), re.ASCII)
_PLACES = re.compile(r"\{\d+,|\d+\}", re.ASCII)


def _texts(ids: np.ndarray, ends: np.ndarray, n_bins: int) -> tuple[list[str], np.ndarray]:
    """Text of every row with an x bin as ``{`` and a y bin as ``}``; and which rows have each y
    bin directly behind an x bin and each x bin before one."""
    signs = np.zeros(first_y(n_bins) + n_bins + 1, np.uint8)
    signs[FIRST_CHAR:FIRST_X] = np.frombuffer("".join(CHARACTERS).encode(), np.uint8)
    signs[FIRST_X : first_y(n_bins)], signs[first_y(n_bins) : -1] = ord("{"), ord("}")
    known = (ids >= 0) & (ids < len(signs))
    drawn = signs[np.where(known, ids, 0)]
    x, y = drawn == ord("{"), drawn == ord("}")
    after, head = np.append(y[1:], False), np.append(False, x[:-1])
    head[ends[:-1][ends[:-1] < len(ids)]] = False
    after[ends[1:][ends[1:] > 0] - 1] = False
    odd = offsets((x & ~after) | (y & ~head))
    some = drawn > 0
    cuts = offsets(some)[ends]
    text = drawn[some].tobytes().decode()
    return [text[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], odd[ends[1:]] == odd[ends[:-1]]


def decode(ids: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """``struct<smiles, atoms array<struct<symbol,x,y>>, success>``: ids up to the end mark, a
    character that is followed by its bins is an atom (see ``decode_text``)."""

    @F.arrow_udf("struct<smiles:string,atoms:array<struct<symbol:string,x:int,y:int>>,success:boolean>")
    def read(lists: pa.Array) -> pa.Array:
        flat, ends = flat_lists(lists)
        values = pc.fill_null(flat, UNK).to_numpy().astype(np.int64)
        stops = np.flatnonzero((values == EOS) | (values == PAD))
        stop = np.minimum(np.append(stops, len(values))[np.searchsorted(stops, ends[:-1])], ends[1:])
        kept = np.arange(len(values)) < np.repeat(stop, np.diff(ends))
        cuts, values = offsets(kept)[ends], values[kept]
        drawn, paired = _texts(values, cuts, n_bins)
        place = np.flatnonzero((values >= FIRST_X) & (values < first_y(n_bins)))
        first = np.searchsorted(place, cuts).tolist()
        # Of the last row's last bin nothing follows.
        x, y = (np.append(values, 0)[place + lag] - base for lag, base in ((0, FIRST_X), (1, first_y(n_bins))))
        smiles, symbols, xs, ys, counts = [], [], [], [], []
        for i, text in enumerate(drawn):
            found = _PAIRED.findall(text) if paired[i] else ()
            a, b = first[i], first[i + 1]
            if paired[i] and len(found) == b - a:
                smiles.append(text.replace("{}", ""))
                symbols += found
                xs.append(x[a:b])
                ys.append(y[a:b])
                counts.append(b - a)
                continue
            whole = _spelled(values[cuts[i] : cuts[i + 1]], n_bins)
            atoms = _PLACED.findall(whole)
            smiles.append(_PLACES.sub("", whole))
            symbols += [t for t, _, _ in atoms]
            xs.append(np.array([int(v) for _, v, _ in atoms], np.int64))
            ys.append(np.array([int(v) for _, _, v in atoms], np.int64))
            counts.append(len(atoms))
        none = np.zeros(0, np.int64)
        axes = [pa.array(np.concatenate([none, *v]).astype(np.int32)) for v in (xs, ys)]
        atoms = pa.StructArray.from_arrays([pa.array(symbols, pa.string()), *axes], ["symbol", "x", "y"])
        counts = np.array(counts, np.int64)
        parts = [pa.array(smiles, pa.string()), _list_of(offsets(counts), atoms), pa.array(counts > 0)]
        mask = pc.is_null(lists) if lists.null_count else None
        return pa.StructArray.from_arrays(parts, ["smiles", "atoms", "success"], mask=mask)

    return read(ids)


def _spelled(ids: np.ndarray, n_bins: int) -> str:
    """The text of ``decode_text`` for ids before the end mark."""
    y = first_y(n_bins)
    shown = {**{i + FIRST_CHAR: c for i, c in enumerate(CHARACTERS)}, **{FIRST_X + i: f"{{{i}," for i in range(n_bins)}, **{y + i: f"{i}}}" for i in range(n_bins)}}
    return "".join([shown.get(i, "") for i in ids.tolist()])


def atom_positions(ids: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """0-based positions of y-bin ids."""

    @F.arrow_udf("array<int>")
    def found(lists: pa.Array) -> pa.Array:
        flat, ends = flat_lists(lists)
        values = pc.fill_null(flat, PAD).to_numpy()
        at = np.flatnonzero((values >= first_y(n_bins)) & (values < first_y(n_bins) + n_bins))
        cuts = np.searchsorted(at, ends)
        starts = np.repeat(ends[:-1], np.diff(cuts))
        return _list_of(cuts, pa.array((at - starts).astype(np.int32)), lists)

    return found(ids)


def grammar_violations(ids: Column, n_bins: int = DEFAULT_BINS) -> Column:
    """Pairs of neighbours that break the order: x without y after it, a coordinate after y,
    y without x before it, anything but a character after the start mark, and padding, a
    start mark or an unknown mark behind any token (padding may follow the end and itself)."""

    @F.arrow_udf("int")
    def counted(lists: pa.Array) -> pa.Array:
        flat, ends = flat_lists(lists)
        values = pc.fill_null(flat, -1).to_numpy()
        a, b = values[:-1], values[1:]
        x, y = ((values >= low) & (values < low + n_bins) for low in (FIRST_X, first_y(n_bins)))
        ax, bx, ay, by = x[:-1], x[1:], y[:-1], y[1:]
        character = (b >= FIRST_CHAR) & (b < FIRST_X)
        stray = (b == SOS) | (b == UNK) | ((b == PAD) & (a != EOS) & (a != PAD))
        bad = (ax & ~by) | (ay & (bx | by)) | (~ax & ~ay & by) | ((a == SOS) & ~character & ~by) | stray
        # Beside a null nothing is wrong but what is wrong beside any token.
        bad = np.where((a >= 0) & (b >= 0), bad, (b == SOS) | (b == UNK))
        upto = offsets(bad)
        last = np.maximum(ends[1:] - 1, ends[:-1])
        clip = len(upto) - 1
        counts = upto[np.minimum(last, clip)] - upto[np.minimum(ends[:-1], clip)]
        return pc.if_else(lists.is_valid(), pa.array(counts.astype(np.int32)), pa.scalar(None, pa.int32()))

    return counted(ids)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _trimmed(lists: pa.Array) -> pa.Array:
    flat, ends = flat_lists(lists)
    values = pc.fill_null(flat, PAD).to_numpy()
    marks, ink = np.flatnonzero(values == EOS), np.flatnonzero(values != PAD)
    stop = np.minimum(np.append(marks + 1, len(values) + 1)[np.searchsorted(marks, ends[:-1])], ends[1:])
    last = np.append(ink, -1)[np.searchsorted(ink, stop) - 1] + 1
    sizes = np.maximum(last - ends[:-1], 0)
    cuts = offsets(sizes)
    places = np.arange(cuts[-1]) + np.repeat(ends[:-1] - cuts[:-1], sizes)
    return _list_of(cuts, flat.take(pa.array(places)), lists)


def trim(ids: Column) -> Column:
    """Cut behind the first end mark, then drop padding at the tail."""
    return _trimmed(ids)


def truncate(ids: Column, positions: Column, limit: int) -> Column:
    """``struct<ids, positions>`` of at most ``limit`` ids; positions at or behind the last
    kept id are dropped."""
    kept = F.slice(ids, F.lit(1), F.lit(limit))
    last = F.least(F.size(ids), F.lit(limit)) - 1
    return F.struct(kept.alias("ids"), F.filter(positions, lambda p: p < last).alias("positions"))


def parse_coords(text: Column) -> Column:
    """``[[x,y],...]`` text to ``array<array<double>>``; null unless every entry is a pair and
    there is at least one."""

    def checked(value):
        ok = value.isNotNull() & (F.size(value) > 0) & F.forall(
            value, lambda p: p.isNotNull() & (F.size(p) == 2) & F.forall(p, lambda v: v.isNotNull())
        )
        return F.when(ok, value)

    return let(F.from_json(text, "array<array<double>>"), checked)


def parse_edges(text: Column) -> Column:
    """``[[u,v,code],...]`` text to ``array<array<int>>``; malformed text gives no edges."""
    value = F.from_json(text, "array<array<int>>")
    ok = value.isNotNull() & F.forall(value, lambda p: p.isNotNull() & (F.size(p) == 3))
    return F.when(ok, value).otherwise(F.array().cast("array<array<int>>"))
