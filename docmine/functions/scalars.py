"""Numeric helpers: bins, distances, rewards, bit sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmine.functions.binding import let

MINHASH_PRIME = 4294967291


def digitise(value: Column, edges: Sequence[float]) -> Column:
    """Index of the half-open bin a value falls in, -1 below the first edge."""
    passed = [F.when(value >= F.lit(float(e)), 1).otherwise(0) for e in edges if not math.isinf(e)]
    total = passed[0]
    for step in passed[1:]:
        total = total + step
    return (total - 1).cast("int")


def quantise(value: Column, extent: Column | float, n_bins: int) -> Column:
    extent = F.lit(float(extent)) if not isinstance(extent, Column) else extent
    inside = F.least(F.greatest(value, F.lit(0.0)), extent - 1)
    index = F.floor(inside / extent * n_bins)
    return F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), index)).cast("int")


def ramp(epoch: Column, low: float, high: float, length: int) -> Column:
    return low + (high - low) * F.least(epoch.cast("double"), F.lit(float(length))) / length


def ramp_length(num_epochs: int, curriculum: int | None = None) -> int:
    planned = curriculum if curriculum is not None else max(1, num_epochs // 2)
    return max(1, planned - 1)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 1.0)
        .when((F.length(a) == 0) | (F.length(b) == 0), 0.0)
        .otherwise(1.0 - F.levenshtein(a, b) / longest)
    )


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all bits; null or two empty sets give 0."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - common
    return F.when(
        a.isNotNull() & b.isNotNull() & (total > 0), common / total.cast("double")
    ).otherwise(F.lit(0.0))


def bit_count(bits: Column) -> Column:
    return F.size(bits)


def common_bits(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def on_bits(flags: Column) -> Column:
    """Positions of the ones in a 0/1 vector."""
    return F.filter(
        F.transform(flags, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull()
    )


def sign_bits(vector: Column) -> Column:
    """Positions of the positive components."""
    return on_bits(vector)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    def term(x, y):
        d = x.cast("double") - y.cast("double") + F.lit(eps)
        return d * d

    return F.sqrt(_sum(F.zip_with(a, b, term)))


def cosine_clamped(a: Column, b: Column, valid: Column | None = None) -> Column:
    """Cosine in [0, 1]; 0 where a side is missing, zero or flagged invalid."""
    size = norm(a) * norm(b)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot(a, b), size)))
    ok = a.isNotNull() & b.isNotNull() & (size > 0)
    if valid is not None:
        ok = ok & valid
    return F.when(ok, value).otherwise(F.lit(0.0))


def l2_normalise(v: Column) -> Column:
    size = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / size)


def composite_reward(
    valid: Column, similarity: Column, exact: Column, weights=(0.1, 0.5, 0.4)
) -> Column:
    return (
        valid.cast("double") * weights[0] + similarity * weights[1] + exact.cast("double") * weights[2]
    )


def shingle_bits(tokens: Column, n: int = 3, n_bits: int = 2048) -> Column:
    """Sorted distinct slots of hashed token n-grams.

    Text stand-in for a circular fingerprint; every consumer takes any ``array<int>``.
    A list shorter than ``n`` is one gram.
    """
    return let(tokens, lambda bound: _shingle_bits(bound, n, n_bits))


def _shingle_bits(tokens: Column, n: int, n_bits: int) -> Column:
    last = F.greatest(F.size(tokens) - F.lit(n), F.lit(0))
    grams = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_join(F.slice(tokens, i + F.lit(1), F.lit(n)), " "),
    )
    slots = F.transform(
        grams,
        lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("bigint"), F.lit(n_bits)).cast("int"),
    )
    return F.when(F.size(tokens) > 0, F.sort_array(F.array_distinct(slots))).otherwise(
        F.array().cast("array<int>")
    )


def hash_pairs(n: int) -> list[tuple[int, int]]:
    """Multipliers and offsets of the hash family, derived from md5 of the index."""

    def value(tag: str, i: int) -> int:
        return int(hashlib.md5(f"{tag}{i}".encode()).hexdigest()[:8], 16) % 2147483647

    return [(1 + value("a", i), value("b", i)) for i in range(n)]


def band_shape(threshold: float, n: int = 128) -> tuple[int, int]:
    """Bands and rows that weigh missed and false candidates equally at a threshold."""

    def integral(f, lo, hi, steps=1000):
        width = (hi - lo) / steps
        return sum(f(lo + (k + 0.5) * width) for k in range(steps)) * width

    best, shape = None, (n, 1)
    for rows in range(1, n + 1):
        for bands in range(1, n // rows + 1):
            false_hit = integral(lambda s: 1 - (1 - s**rows) ** bands, 0.0, threshold, 100)
            missed = integral(lambda s: (1 - s**rows) ** bands, threshold, 1.0, 100)
            error = 0.5 * false_hit + 0.5 * missed
            if best is None or error < best:
                best, shape = error, (bands, rows)
    return shape
