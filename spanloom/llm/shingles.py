"""Word and shingle hashes of whole texts, computed by numpy straight from Arrow's byte buffers.

Words are the runs of bytes other than the six ASCII white-space characters, after lower-casing A-Z only, so a word hash
depends on its bytes alone and is the same in every task.  A word's hash is a polynomial over randomised byte values,
taken as a difference of prefix sums modulo 2**64, with its length mixed in.  Working memory is some tens of bytes for
each byte of the slice in hand; callers take ``slices`` of about 1 MiB, so only one very long text can ask for more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
# The SplitMix64 constants, and an odd base with its inverse modulo 2**64.
_M1, _M2, _GOLD = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
SPACES = b"\t\n\x0b\x0c\r "
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element-wise on a uint64 array."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def stream(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random uint64 values; other salts give other values."""
    return mix((np.arange(1, n + 1, dtype=U) + (np.array([salt], dtype=U) << U(32))) * _GOLD)


_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
_IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACES, dtype=np.uint8))
_BYTE = stream(256, 1)[_LOWER]
_BYTE_CASED = stream(256, 1)
_COEFF = stream(64, 2) | U(1)
_powers = {"up": np.ones(1, dtype=U), "down": np.ones(1, dtype=U)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse; kept up to the slice size."""
    have = _powers[kind]
    if len(have) < n:
        have = np.full(max(n, SLICE_BYTES if n <= SLICE_BYTES else n), U(_BASE if kind == "up" else _INVERSE))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    kind = np.int64 if large else np.int32
    if offs is None or len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes, or of one row where that is longer."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


class Words:
    """The words of consecutive texts: ``start`` and ``end`` byte of each, the ``row`` it is in, its ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cased: bool = False):
        self.data, self.offsets, self.n_rows = data, offsets, len(offsets) - 1
        n = len(data)
        if n == 0:
            self.start = self.end = self.row = np.empty(0, dtype=np.int64)
            self.hash = np.empty(0, dtype=U)
            return
        space = _IS_SPACE[data]
        first, last = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        first[0] = last[-1] = True
        first[1:], last[:-1] = space[:-1], space[1:]
        opens = offsets[:-1]
        first[opens[opens < n]] = True
        closes = offsets[1:] - 1
        last[closes[closes >= 0]] = True
        self.start = np.flatnonzero(first & ~space)
        self.end = np.flatnonzero(last & ~space) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self._sums = (_BYTE_CASED if cased else _BYTE)[data]
        self._sums *= _power("up", n)
        np.cumsum(self._sums, out=self._sums)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, end) of each pair, all non-empty."""
        before = np.where(start > 0, self._sums[start - 1], U(0))
        h = (self._sums[end - 1] - before) * _power("down", len(self.data))[start]
        return mix(h + (end - start).astype(U) * _GOLD)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows)


def shingles(ids: np.ndarray, row: np.ndarray, counts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every ``width``-word shingle of each row, repeats included, in row order.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none."""
    n = len(ids)
    full = np.flatnonzero(row[: max(0, n - width + 1)] == row[width - 1 :]) if n >= width else np.empty(0, dtype=np.int64)
    h = np.full(len(full), U(width))
    for j in range(width):
        h += ids[full + j] * _COEFF[j]
    owner = row[full] if len(full) else np.empty(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        firsts = np.concatenate(([0], np.cumsum(counts)))[short]
        extra = counts[short].astype(U)
        for j in range(width - 1):
            has = counts[short] > j
            extra[has] += ids[firsts[has] + j] * _COEFF[j]
        h, owner = np.concatenate((h, extra)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    return mix(h), owner


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    data, offs = buffers(column)
    for a, b in slices(offs):
        words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        h, owner = shingles(words.hash, words.row, words.counts(), width)
        cut = np.searchsorted(owner, np.arange(b - a + 1))
        for i in range(b - a):
            yield np.unique(h[cut[i] : cut[i + 1]])
