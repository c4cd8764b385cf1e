"""PartEnum signatures of bit sets: two sets of a Jaccard similarity share at least one."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, floor

import numpy as np

_U = np.uint64
#: Elements that make a part full, by cut of the domain: a set with too few full parts goes on
#: to the next cut, and in the last one even empty parts count.
FULL = (2, 2, 2, 2, 1, 1, 0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble of every element."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache
def size_bands(least: float, top: int) -> tuple[tuple[int, int], ...]:
    """Size bands [low, high] up to ``top``: sets as similar as ``least`` lie in one band or in
    neighbours."""
    bands, low = [], 1
    while low <= top:
        high = max(low, floor(low / least + 1e-9))
        bands.append((low, high))
        low = high + 1
    return tuple(bands)


def differences(a: int, b: int, least: float) -> int:
    """Elements that only one of two similar sets of these sizes can hold."""
    return floor((a + b) * (1 - least) / (1 + least) + 1e-9)


def signatures(bits: np.ndarray, least: float) -> np.ndarray:
    """Signatures of one set, for its own size band and the next.

    The domain is cut into parts; the signature of a part is a hash of the set's elements in
    it. A set that differs from its similar sets in at most k elements and has more than k
    full parts shares one of them with each, which sends it too; thinner parts, which would
    meet many sets, are left out. If neither of two sets has enough, both go on to the next cut.
    """
    n = len(bits)
    if not n:
        return np.zeros(0, np.int64)
    bands = size_bands(least, n)
    own = bands[-1][1]
    following = max(own + 1, floor((own + 1) / least + 1e-9))
    elements = mix(bits.astype(_U))
    weight, out = mix(elements), []
    with np.errstate(over="ignore"):
        for band, high in ((len(bands), own), (len(bands) + 1, following)):
            tag = mix(np.array([band], _U))
            if differences(high, high, least) == 0:
                out.append(mix(weight.sum(dtype=_U, keepdims=True) ^ tag))
                continue
            k = differences(n, min(high, floor(n / least + 1e-9)), least)
            # A third more parts than differences, or as many full ones would be rare.
            parts = 2 + ceil(1.35 * differences(high, high, least))
            for draw, least_full in enumerate(FULL):
                part = ((mix(elements + _U(draw)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                run = np.concatenate([np.zeros(1, _U), np.cumsum(weight[order], dtype=_U)])
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                label = mix(np.arange(draw * parts, (draw + 1) * parts, dtype=_U) + tag)
                full = np.diff(cut) >= least_full
                out.append(mix(mix(run[cut[1:]] - run[cut[:-1]] + tag) ^ label)[full])
                if np.count_nonzero(full) > k:
                    break
    return np.concatenate(out).view(np.int64)


def shared_counts(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """Elements in both sets of every pair; the sets of either side lie one after the other."""
    rows = np.arange(len(a_sizes))
    keys = np.concatenate([np.repeat(rows, a_sizes) << 32 | a, np.repeat(rows, b_sizes) << 32 | b])
    keys.sort(kind="stable")
    return np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 32, minlength=len(rows))
