"""Hashes of words and word shingles of many texts at once, in numpy.

The texts of a batch lie in one byte array.  A span's hash is a polynomial in
table values of its bytes, from prefix sums modulo 2**64, and is then mixed
with its length.  Unequal spans share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

from .workers import per_stage

_U = np.uint64
_rng = np.random.default_rng(20240501)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least; a worker keeps the
    longest of a stage."""
    found = per_stage("powers", list)
    if not found or len(found[0]) < n + 1:
        size, found[:] = 1 << (n + 1).bit_length(), []
        for b in (_BASE, _INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            found.append(np.multiply.accumulate(x))
    return found[0], found[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def join_texts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a line feed after each, and where each begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.concatenate([[0], ends]).astype(np.int64)


class Spans:
    """Prefix sums over ``data`` for hashes of spans of it."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _power_tables(len(data))
        table = _TABLE[_LOWER] if lower else _TABLE
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _MIX[0])


class HashSpans(Spans):
    """The same over hashes of words, for spans of words."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = _power_tables(len(hashes))
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that aren't white space."""
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts in a row, and where each text's begin
    (one more at the end)."""
    data, begins = join_texts(texts)
    start, end = word_spans(data)
    return Spans(data, lower).hash(start, end), np.searchsorted(start, begins)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * _MIX[j + 1]
    return mix(out)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``k``-word shingles; a text of
    fewer words has one of all its words, one without words none."""
    h, at = words(texts)
    out = []
    for i, j in zip(at[:-1], at[1:], strict=True):
        own = h[i:j]
        out.append(np.unique(shingles(own, k)) if j - i >= k else shingles(own, j - i) if j > i else own)
    return out
