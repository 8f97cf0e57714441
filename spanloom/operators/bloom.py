"""A Bloom filter of 64-bit hashes that goes to all tasks: 1 to 64 MB by the number of hashes, two bits for each."""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BITS_EACH = 1 << 23, 1 << 29, 16


def words(hashes: DataFrame, column: str) -> Broadcast:
    """The filter of a column of longs.  Beyond some 30 million hashes it lets more pass, and the join after it decides."""
    bits, n = LEAST_BITS, hashes.count()
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    h, mask = F.col(column), F.lit(bits - 1)
    at = hashes.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("at"))
    found = at.selectExpr("cast(at div 64 as int) i", "shiftleft(1L, cast(at % 64 as int)) w").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    table = np.zeros(bits // 64, dtype=np.int64)
    table[found["i"].to_numpy()] = found["w"].to_numpy()
    return hashes.sparkSession.sparkContext.broadcast(table)


def hits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) the filter lets pass."""
    mask = np.int64(64 * len(table) - 1)
    out = np.ones(len(hashes), dtype=bool)
    for at in (hashes & mask, (hashes.view(np.uint64) >> np.uint64(32)).view(np.int64) & mask):
        out &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return out
