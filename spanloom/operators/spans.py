"""Interval operators on spans (doc_id, start, end), half-open.

All of them are keyed by doc_id first, so a plan that is partitioned by doc_id shuffles no more.  Overlap tests are
windows over sorted starts and ends where a flag is enough, and bucketed equi-joins where pairs are needed; neither
compares all spans of a document with each other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def overlap_flag(left: DataFrame, right: DataFrame, name: str = "overlaps", same_type: bool = False) -> DataFrame:
    """``left`` with a boolean: does any span of ``right`` (with the same type, if asked) overlap it?

    The largest end among right spans that start before a left span's end exceeds the left span's start exactly where
    one overlaps: a running maximum over both sides, sorted by where they take effect."""
    by = ["doc_id", "type"] if same_type else ["doc_id"]
    cols = left.columns
    row = F.struct(*[F.col(f"`{c}`") for c in cols])
    a = left.select(*by, F.col("end").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("int").alias("_end"), row.alias("_row"))
    b = right.select(*by, F.col("start").alias("_at"), F.lit(1).alias("_side"), F.col("end").cast("int").alias("_end"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    run = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("_max", F.max("_end").over(run)).filter("_side = 0").select("_row.*", F.coalesce(F.col("_max") > F.col("_row.start"), F.lit(False)).alias(name))


def anti_overlap(left: DataFrame, right: DataFrame, same_type: bool = False) -> DataFrame:
    return overlap_flag(left, right, "_hit", same_type).filter("not _hit").drop("_hit")


def overlap_join(left: DataFrame, right: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs of overlapping spans.  Columns of ``right`` other than doc_id must not clash: rename them, with its bounds
    as r_start and r_end.  A pair meets in every bucket that both touch and is kept in the first of them."""
    def buckets(s: Column, e: Column) -> Column:
        return F.explode(F.sequence(F.floor(s / bucket), F.floor((e - 1) / bucket)))

    a = left.withColumn("_b", buckets(F.col("start"), F.col("end")))
    b = right.withColumn("_b", buckets(F.col("r_start"), F.col("r_end")))
    first = F.greatest(F.floor(F.col("start") / bucket), F.floor(F.col("r_start") / bucket))
    return a.join(b, ["doc_id", "_b"]).filter((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")) & (F.col("_b") == first)).drop("_b")


def islands(spans: DataFrame, by: list[str]) -> DataFrame:
    """``spans`` with island: the number of its cluster of transitively overlapping spans within ``by``.

    A span opens a cluster where it starts at or after every end before it; this equals union-find on overlaps."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("start") < before, 0).otherwise(1))
    return opened.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, island, start, end, ...) come by island and priority; those that find their place free pass.

    The spans kept of the island in hand are disjoint, so a place is free where its two neighbours leave it so: n log n for an
    island of any length, one batch and one island's bounds in memory."""
    island, starts, ends = None, [], []
    for batch in batches:
        free = []
        for d, i, s, e in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if (d, i) != island:
                island, starts, ends = (d, i), [], []
            at = bisect_right(starts, s)
            free.append((at == 0 or ends[at - 1] <= s) and (at == len(starts) or starts[at] >= e))
            if free[-1]:
                starts.insert(at, s)
                ends.insert(at, e)
        yield batch.filter(pa.array(free, pa.bool_())).select([0, *range(2, batch.num_columns)])


def greedy(spans: DataFrame, priority: list[Column], payload: list[str]) -> DataFrame:
    """Keep spans (not empty) in order of ``priority``, each unless it overlaps one kept before; ties by start, end and ``payload``.

    Spans of different islands cannot touch, so each island is one sequence, sorted by Spark and streamed: no island is
    gathered into a row.  Rounds of local winners would need as many rounds as a chain of spans, each beating the next, has
    links; equal votes and lengths make such chains common."""
    names = [c for c in payload if c not in ("start", "end")]
    keys = [f"_p{i}" for i in range(len(priority))]
    rows = islands(spans.select("doc_id", "start", "end", *names, *[p.alias(k) for k, p in zip(keys, priority, strict=True)]), ["doc_id"])
    ordered = rows.sortWithinPartitions("doc_id", "island", *keys, "start", "end", *names).select("doc_id", "island", "start", "end", *names)
    return ordered.mapInArrow(_claims, ordered.drop("island").schema)


def greedy_by_document(spans: DataFrame, priority: list[Column], payload: list[str]) -> DataFrame:
    """As ``greedy``, for ``spans`` of which each document's rows follow one another within a partition, as they do where
    documents were cut: nothing is shuffled, and a task holds one batch and one document's rows."""
    names = [c for c in payload if c not in ("start", "end")]
    keys = [f"_p{i}" for i in range(len(priority))]
    rows = spans.select("doc_id", "start", "end", *names, *[p.alias(k) for k, p in zip(keys, priority, strict=True)])
    order = [(c, "ascending") for c in ["doc_id", *keys, "start", "end", *names]]

    def claimed(whole: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = whole.take(pc.sort_indices(whole, sort_keys=order))
        doc, starts, ends, free = None, [], [], []
        for d, s, e in zip(*(whole.column(c).to_pylist() for c in range(3)), strict=True):
            if d != doc:
                doc, starts, ends = d, [], []
            at = bisect_right(starts, s)
            free.append((at == 0 or ends[at - 1] <= s) and (at == len(starts) or starts[at] >= e))
            if free[-1]:
                starts.insert(at, s)
                ends.insert(at, e)
        yield from whole.filter(pa.array(free, pa.bool_())).select(range(3 + len(names))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            if rest and rest[-1].column(0)[-1].as_py() != ids[0]:
                yield from claimed(pa.Table.from_batches(rest))
                rest = []
            before = np.flatnonzero(ids != ids[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield from claimed(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield from claimed(pa.Table.from_batches(rest))

    return rows.mapInArrow(run, rows.drop(*keys).schema)


def best_overlap(left: DataFrame, right: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """``left`` joined to its right span with the largest overlap; ties by ``order`` (columns of right).  Left rows
    without one are left out."""
    size = F.least("end", "r_end") - F.greatest("start", "r_start")
    pick = Window.partitionBy("doc_id", id_col).orderBy(F.desc("_size"), *order)
    return overlap_join(left, right).withColumn("_size", size).withColumn("_rank", F.row_number().over(pick)).filter("_rank = 1").drop("_size", "_rank")


def adjacent_overlaps(spans: DataFrame) -> DataFrame:
    """doc_id, n: neighbours in (start, end, type) order of which the second starts before the first ends."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "type")
    return spans.withColumn("_hit", (F.col("start") < F.lag("end").over(w)).cast("int")).groupBy("doc_id").agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("n"))
