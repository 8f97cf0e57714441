"""Maximal periodic runs of words, by the branching tandem repeats of each document's suffix tree (Stoye and Gusfield).

1. Names of blocks of 1, 2, 4, ... words sort the suffixes of a document; the same names answer how far two places agree, to
   the right or to the left, in a logarithm of steps.  Sorted suffixes and their common prefixes are the suffix tree: a
   node is a maximal interval of suffixes with a common prefix of ``depth`` words, its children begin where neighbours
   share ``depth`` words and no more.
2. Smaller-half leaf lists: at each node the leaves of every child but the largest are taken, n log n in all, and each leaf i
   is tried with i + depth and i - depth.  If both are leaves of the node, the words from the first on are twice the
   node's prefix, a tandem repeat; it is a branching one if the word after it breaks the repeat.
3. Each branching repeat is rotated to the left as long as the words ``depth`` apart agree.  Repeats that reach over the
   same words are one run, whose period is their smallest.

A document is one row, so its tree is built where the row is, with numpy, for many documents in one array at a time: names
tell the document too, so no node has leaves of two.  A run of 12 words or more repeats some six words in a row, so only
documents that hold six words twice need a tree; that test is exact.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shingles import Words, buffers, shingles, slices
from spanloom.llm.tables import map_arrow, text_or_empty

MIN_LENGTH = 12
WITNESS = 6  # words that a run of MIN_LENGTH holds twice: a period of q <= 6 matches 12 - q in a row, a longer one q

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Names:
    """``level[k][i]``: the rank of the 2**k words from i on among all such blocks; blocks are cut at their document's end,
    so no two of different documents are equal."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        n = len(words)
        self.n, self.row = n, row
        order = np.lexsort((words, row))
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (np.diff(row[order]) != 0) | (words[order][1:] != words[order][:-1])
        now = np.empty(n, dtype=np.int64)
        now[order] = np.cumsum(fresh)
        self.level = [now.astype(np.int32)]
        width = 1
        while now.max(initial=0) < n:
            later = np.zeros(n, dtype=np.int64)
            later[: n - width] = np.where(row[width:] == row[: n - width], now[width:], 0)
            _, now = np.unique(now * (n + 1) + later, return_inverse=True)
            now += 1
            self.level.append(now.astype(np.int32))
            width *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[now - 1] = np.arange(n)
        self.rank = now - 1

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on agree."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            ok = (i < self.n) & (j < self.n)
            ok[ok] = self.level[k][i[ok]] == self.level[k][j[ok]]
            for x in (i, j, total):
                x[ok] += 1 << k
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i and j, these not included, agree."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.level) - 1, -1, -1):
            ok = np.minimum(i, j) >= 1 << k
            ok[ok] = self.level[k][i[ok] - (1 << k)] == self.level[k][j[ok] - (1 << k)]
            for x, step in ((i, -1), (j, -1), (total, 1)):
                x[ok] += step << k
        return total


def _intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place m the interval [lo, hi) of sorted suffixes around it that share common[m] words; common[0] is 0."""
    n = len(common)
    least = [common]  # least[k][m]: the minimum of the 2**k values from m on
    while 2 << (len(least) - 1) <= n:
        last, half = least[-1], 1 << (len(least) - 1)
        least.append(np.minimum(last[:-half], last[half:]))
    lo, hi = np.arange(n), np.arange(1, n + 1)
    for k in range(len(least) - 1, -1, -1):
        ok = hi + (1 << k) <= n
        ok[ok] = least[k][hi[ok]] >= common[ok]
        hi[ok] += 1 << k
        ok = lo >= 1 << k
        ok[ok] = least[k][lo[ok] - (1 << k)] >= common[ok]
        lo[ok] -= 1 << k
    return lo - 1, hi


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) for every value of every range [first, last)."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[owner]


def branching_repeats(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every tandem repeat that the word after it breaks; some may be told twice."""
    order, rank, n = names.order, names.rank, names.n
    common = np.zeros(n, dtype=np.int64)
    common[1:] = names.forward(order[:-1], order[1:])
    lo, hi = _intervals(common)
    cut = np.flatnonzero(common)
    lo, hi, depth = lo[cut], hi[cut], common[cut]
    by_node = np.lexsort((cut, depth, lo))  # the cuts of a node in a row: a node is its left end and its depth
    cut, lo, hi, depth = cut[by_node], lo[by_node], hi[by_node], depth[by_node]
    opens = np.ones(len(cut), dtype=bool)
    opens[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    closes = np.append(opens[1:], True) if len(cut) else opens
    # a child from each cut to the next, and one from the node's left end to its first cut
    first = np.concatenate((cut, lo[opens]))
    last = np.concatenate((np.where(closes, hi, np.append(cut[1:], 0)) if len(cut) else cut, cut[opens]))
    node = np.concatenate((np.cumsum(opens) - 1, np.arange(opens.sum())))
    size = last - first
    by_size = np.lexsort((size, node))
    largest = np.append(node[by_size][1:] != node[by_size][:-1], True) if len(node) else np.empty(0, dtype=bool)
    small = by_size[~largest]
    left, right, deep = lo[opens], hi[opens], depth[opens]
    child, at = _ranges(first[small], last[small])
    of, i = node[small][child], order[at]
    q = deep[of]

    def inside(place: np.ndarray) -> np.ndarray:
        r = rank[np.clip(place, 0, n - 1)]
        return (place >= 0) & (place < n) & (left[of] <= r) & (r < right[of])

    after, before = inside(i + q), inside(i - q)
    start, period = np.concatenate((i[after], i[before] - q[before])), np.concatenate((q[after], q[before]))
    beyond, half = start + 2 * period, start + period
    broken = beyond >= n
    inner = ~broken
    broken[inner] = names.level[0][half[inner]] != names.level[0][beyond[inner]]
    return start[broken], period[broken]


def runs_of(words: np.ndarray, row: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, period) of every maximal run of at least two periods and ``min_length`` words, by start and period.

    ``words`` are those of several documents in a row, ``row`` tells the document of each."""
    if not len(words):
        return np.empty((0, 3), dtype=np.int64)
    names = Names(words, row)
    place, period = branching_repeats(names)
    start, end = place - names.backward(place, place + period), place + 2 * period
    found = np.unique(np.stack((start, end, period), axis=1)[end - start >= min_length], axis=0)
    once = np.ones(len(found), dtype=bool)
    once[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[once]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word numbers that the contract's periodic rewriting of a document reads, None if it leaves the document alone."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _repeating(words: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Whether each document holds some WITNESS words in a row twice, and so may have a run."""
    counts = np.bincount(row, minlength=n_rows)
    h, owner = shingles(words, row, counts, WITNESS)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    out = np.zeros(n_rows, dtype=bool)
    out[owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]] = True
    return out & (counts >= MIN_LENGTH)


def _results(ids: list, raw: list[bytes], words: Words, rewrite: Callable) -> Iterator[tuple]:
    """A row of the result for each document of a slice."""
    opens = np.concatenate(([0], np.cumsum(words.counts())))
    read, orders = np.arange(len(words.hash)), {}
    for k, doc_id in enumerate(ids):
        order = rewrite(doc_id, int(opens[k + 1] - opens[k]))
        if order is not None:
            orders[k] = order
            read[opens[k] : opens[k + 1]] = opens[k] + order
    sequence = words.hash[read]
    may = _repeating(sequence, words.row, len(ids))
    places = np.flatnonzero(may[words.row])
    runs = runs_of(sequence[places], words.row[places])
    runs[:, :2] = np.stack((places[runs[:, 0]], places[runs[:, 1] - 1] + 1), axis=1) if len(runs) else runs[:, :2]
    dropped = np.zeros(len(read) + 1, dtype=np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    cut = np.searchsorted(runs[:, 0], opens)
    for k, doc_id in enumerate(ids):
        mine = runs[cut[k] : cut[k + 1]] - np.array([opens[k], opens[k], 0])
        text = raw[k].split()
        if k in orders or len(mine):
            order = orders.get(k, np.arange(len(text)))[kept[opens[k] : opens[k + 1]]]
            text = [text[i] for i in order.tolist()]
        best = min(((-int(e - s), int(s), int(p)) for s, e, p in mine), default=None)
        told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in mine.tolist())
        yield (doc_id, len(mine), *told, sha256(lines.encode()).hexdigest(), sha256(b" ".join(text)).hexdigest(), b" ".join(text))


def _run_batches(rewrite: Callable, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    if texts:
        schema = schema.append(pa.field("collapsed", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in slices(offs):
                part = data[offs[a] : offs[b]]
                at = offs[a : b + 1] - offs[a]
                raw = [part[at[k] : at[k + 1]].tobytes() for k in range(b - a)]
                rows = list(_results(ids[a:b], raw, Words(part, at, cased=True), rewrite))
                columns = [pa.array([r[c] if c < 8 else r[c].decode() for r in rows], f.type) for c, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _untouched(doc_id: int | None, n: int) -> None:
    return None


def periodic_runs(docs: DataFrame, rewrite: Callable = _untouched, texts: bool = False) -> DataFrame:
    """A row for each row of ``docs`` (needs doc_id and text): its number of runs, the longest one, and digests of all runs and of
    the text that is left when every run keeps its first period.

    A run is a stretch of words with smallest period q, of at least 12 words and two periods, that no neighbour extends.  Of
    equally long runs the first is told, then the one of smaller period; without a run start, length, period and
    exponent_milli are null.  ``texts``: the collapsed text as a column too.  ``rewrite(doc_id, n)`` may give another order of the n words
    to read.  Null and empty texts have no words; a null doc_id is never rewritten; repeated rows give equal rows; very long texts
    are searched whole, in memory in proportion to their words; an empty table gives an empty table; other columns, whatever their names, are not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(rows, _run_batches(rewrite, texts), SCHEMA + (", collapsed string" if texts else ""))


#: Equal stretches of six words at i and i + q, joined to islands of neighbouring i: no tree, no tandem repeats.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: xor((crc >> 8), list_reduce(list_prepend(xor(crc, c) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor((t >> 1), (t & 1) * 3988292384)))), 4294967295) AS h FROM documents),
a AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
b AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM a),
s AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE ws END AS ws FROM b),
six AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 6], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(n - 5)) AS i FROM s WHERE n >= 12)),
pair AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.w = y.w AND x.i < y.i),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
long AS (SELECT doc_id, q, min(i) AS start, max(i) + 6 + q AS stop FROM isle GROUP BY doc_id, q, k HAVING max(i) + 6 + q - min(i) >= greatest(12, 2 * q)),
run AS (SELECT doc_id, start, stop, min(q) AS q FROM long GROUP BY ALL),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || (stop - start) || ',' || q || chr(10), '' ORDER BY start, q) AS runs, first({'s': start, 'l': stop - start, 'q': q} ORDER BY stop - start DESC, start, q) AS best FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, stop)) AS i FROM run),
left_ AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM s) w ANTI JOIN gone USING (doc_id, i) GROUP BY w.doc_id)
SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM s LEFT JOIN told USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
