"""SuperMinHash signatures (Ertl 2017), evaluated level by level over a batch of sets.

Each element draws, for level j = 0, 1, ..., a uniform value r_j and one step of a Fisher-Yates shuffle that tells which
signature position p_j the value j + r_j goes to.  A position keeps its minimum.  Values of level j lie in [j, j + 1), so
a position filled on a lower level never changes again: once every position of a set is filled, the remaining levels of
all its elements can be skipped (the early stop).  Working a level at a time over all elements gives the same
signatures as the element-at-a-time form and lets numpy do the work: large sets end after one level.
"""

from __future__ import annotations

import numpy as np

from spanloom.llm.shingles import U, mix, stream

EMPTY = U(0xFFFFFFFFFFFFFFFF)


def signatures(hashes: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) uint64 signatures; ``owner[i]`` is the set that element ``hashes[i]`` is in.

    The top byte of a value is its level and the other 56 bits are r.  Rows of empty sets hold EMPTY throughout."""
    if not 1 <= m <= 128:
        raise ValueError("m must be in 1..128")
    sig, steps = np.full(n_sets * m, EMPTY), stream(2 * m, 3)
    h, o = hashes, owner.astype(np.int64)
    perm: np.ndarray | None = None
    for level in range(m):
        if not len(h):
            break
        x = mix(h + steps[2 * level])
        k = (mix(h + steps[2 * level + 1]) % U(m - level)).astype(np.int64) + level
        if perm is None:
            p = k
        else:
            row = np.arange(len(h))
            p = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, level]
            perm[:, level] = p
        at = o * m + p
        value = (U(level) << U(56)) | (x >> U(8))
        np.minimum.at(sig, at, value)
        open_sets = (sig.reshape(n_sets, m) == EMPTY).any(axis=1)
        keep = open_sets[o]
        if not keep.any():
            break
        if perm is None:
            h, o, k = h[keep], o[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), k] = perm[:, 0]
            perm[:, 0] = k
        elif not keep.all():
            h, o, perm = h[keep], o[keep], perm[keep]
    return sig.reshape(n_sets, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_sets, bands) 64-bit keys: band b mixes positions b*rows .. b*rows+rows-1 with its own number."""
    if bands * rows > sig.shape[1]:
        raise ValueError("bands * rows exceeds the signature")
    out, salts = np.empty((len(sig), bands), dtype=U), stream(bands, 4)
    for b in range(bands):
        key = np.full(len(sig), salts[b])
        for r in range(rows):
            key = mix(key ^ sig[:, b * rows + r])
        out[:, b] = key
    return out
