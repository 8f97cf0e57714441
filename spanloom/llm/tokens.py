"""Token counts without token ids.

A text's count is the sum, over its distinct pre-tokens, of how often it has the pre-token times the pieces of that
pre-token.

1. Each task folds its texts into distinct pre-tokens with their frequencies; these meet by key, and the pieces of each
   distinct pre-token of the corpus are counted once, with the library's own encoder.
2. The counts are joined to the frequencies of each document: the COMMON most frequent pre-tokens by a broadcast table of
   that size, so most occurrences are summed where their text is read; the others are written as (row, key, frequency),
   joined by key and summed by row.  None of those keys is frequent, so that join has no hot key.

The pre-token used is the blank-delimited chunk.  The model drops white space and never joins pieces across it, and its
special strings contain none, so a text's count is the sum over its chunks.  Only ASCII white space cuts; other white
space stays inside a chunk, where the library treats it as it would in the text.  Chunks are told apart by 64-bit hashes:
among n distinct ones two agree with probability n * n / 2**65 (5e-7 for four million), and then one of them is counted as
the other.  A chunk of more than LONG_CHUNK bytes is counted by the task that reads its text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shingles import U, Words, buffers, slices
from spanloom.llm.tables import keep, map_arrow, text_or_empty

LIMIT = 2048
COMMON = 1_000_000
LONG_CHUNK = 256
FOLD = 1_000_000


def _open(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pieces(tokenizer, texts: list[str], group: int = 10_000) -> np.ndarray:
    out = [len(e) for k in range(0, len(texts), group) for e in tokenizer.encode_batch_fast(texts[k : k + group], add_special_tokens=False)]
    return np.array(out, dtype=np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Slices of a text column: first row, end row, their chunks, and which of these are short."""
    data, offs = buffers(column)
    for a, b in slices(offs):
        words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], cased=True)
        yield a, b, words, words.end - words.start <= LONG_CHUNK


class Folded:
    """Distinct (key, chunk) with frequencies, folded again whenever FOLD entries have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.n = 0

    def add(self, words: Words, short: np.ndarray) -> None:
        start, end, key = words.start[short], words.end[short], words.hash[short]
        key, first, n = np.unique(key, return_index=True, return_counts=True)
        size = end[first] - start[first]
        ends = np.cumsum(size)
        at = np.repeat(start[first] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(key), pa.py_buffer(offsets), pa.py_buffer(words.data[at] if len(at) else np.empty(0, dtype=np.uint8)))
        self.parts.append((key, n, text))
        self.n += len(key)

    def fold(self) -> None:
        if len(self.parts) < 2:
            return
        key, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        text = pa.chunked_array([p[2] for p in self.parts]).combine_chunks()
        own, first, back = np.unique(key, return_index=True, return_inverse=True)
        self.parts = [(own, np.bincount(back, weights=n).astype(np.int64), text.take(pa.array(first)))]
        self.n = len(own)

    def take(self) -> pa.RecordBatch:
        self.fold()
        key, n, text = self.parts[0] if self.parts else (np.empty(0, dtype=U), np.empty(0, dtype=np.int64), pa.array([], pa.large_string()))
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), text.cast(pa.string()), pa.array(n, pa.int64())], ["key", "chunk", "n"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folded = Folded()
    for batch in batches:
        for _, _, words, short in _chunks(batch.column(0)):
            folded.add(words, short)
            if folded.n >= FOLD:
                folded.fold()
                if folded.n >= FOLD // 2:
                    yield folded.take()
    yield folded.take()


def _count_distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _open(path)
        for batch in batches:
            pieces = pa.array(_pieces(tokenizer, batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pieces, batch.column(2)], ["key", "pieces", "n"])

    return run


def piece_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """key, pieces, n: for each distinct pre-token of ``texts`` (text) its hash, its pieces and its frequency."""
    folded = map_arrow(texts, _distinct, "key long, chunk string, n long")
    distinct = folded.repartition("key").groupBy("key").agg(F.min("chunk").alias("chunk"), F.sum("n").alias("n"))
    return map_arrow(distinct, _count_distinct(tokenizer_path), "key long, pieces long, n long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and pieces of a batch as two strings of bytes."""
    for b in batches:
        both = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), b.column(1).to_numpy(zero_copy_only=False).astype(np.int32).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in both], ["key", "pieces"])


def common_pieces(table: DataFrame, common: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted keys, at most ``common`` and twelve bytes each, with their pieces, and whether these are all keys.

    Frequencies are counted in steps of an eighth of a doubling, a few hundred rows; all keys above some step are taken."""
    step = F.floor(F.log2(F.col("n")) * 8).cast("int")
    sizes = sorted(((r.step, r.keys) for r in table.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if total + n > common:
            break
        total, least = total + n, s
    if least is None:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int32), not sizes
    rows = map_arrow(table.filter(step >= least).select("key", "pieces"), _packed, "key binary, pieces binary").collect()
    keys = np.frombuffer(b"".join(r.key for r in rows), dtype=np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(r.pieces for r in rows), dtype=np.int32)[order], least == sizes[-1][0]


def _sums(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces = shared.value
        tokenizer = None
        for batch in batches:
            text, known, rare_n, rare_keys, rare_counts = batch.column(1), [], [], [], []
            for a, b, words, short in _chunks(text):
                at = np.minimum(np.searchsorted(keys, words.hash), max(len(keys) - 1, 0))
                hit = short & (keys[at] == words.hash) if len(keys) else np.zeros(len(short), dtype=bool)
                value = np.where(hit, pieces[at], 0) if len(keys) else np.zeros(len(short), dtype=np.int64)
                alone = np.flatnonzero(~short)
                if len(alone):
                    tokenizer = tokenizer or _open(path)
                    value[alone] = _pieces(tokenizer, [words.data[words.start[i] : words.end[i]].tobytes().decode() for i in alone])
                known.append(np.bincount(words.row, weights=value, minlength=b - a).astype(np.int64))
                rest = np.flatnonzero(short & ~hit)
                order = np.lexsort((words.hash[rest], words.row[rest]))
                row, key = words.row[rest][order], words.hash[rest][order]
                new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else np.empty(0, dtype=np.int64)
                rare_keys.append(key[new].view(np.int64))
                rare_counts.append(np.diff(np.append(new, len(row))).astype(np.int64))
                rare_n.append(np.bincount(row[new], minlength=b - a) if len(new) else np.zeros(b - a, dtype=np.int64))
            ends = np.concatenate([[0], *[x.astype(np.int64) for x in rare_n]]).cumsum()
            none = np.empty(0, dtype=np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([none, *rare_keys])), pa.array(np.concatenate([none, *rare_counts]))], ["key", "n"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate([none, *known])), rare], ["doc_id", "n_bytes", "known", "rare"])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, common: int = COMMON) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs``.

    ``tokenizer_path`` is read on the executors.  Null and empty texts have no tokens; repeated rows give equal rows; very
    long texts are cut like others and never shuffled; pre-tokens of equal frequency are broadcast or joined, with the
    same result; a null doc_id is passed on; an empty table gives an empty table; other columns, clashing ones too, are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    table = keep(piece_counts(rows.select("text"), tokenizer_path))
    keys, pieces, every = common_pieces(table, common)
    shared = spark.sparkContext.broadcast((keys, pieces))
    schema = "doc_id long, n_bytes long, known long, rare array<struct<key:long,n:long>>"
    summed = map_arrow(rows, _sums(tokenizer_path, shared), schema)
    if every:
        out = summed.select("doc_id", "n_bytes", F.col("known").alias("n_tokens"))
    else:
        summed = keep(summed.withColumn("row", F.monotonically_increasing_id()))
        rare = summed.select("row", F.explode("rare").alias("r")).select("row", "r.key", "r.n").join(table.select("key", "pieces"), "key")
        more = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
        out = summed.drop("rare").join(more, "row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
