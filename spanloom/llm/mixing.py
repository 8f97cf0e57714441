"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document falls, by a hash of its id, into one of BLOCKS blocks of its source.  Words of each block are summed
   (map-side combined); that table has sources x BLOCKS rows whatever the corpus, and the driver may hold it.
2. Each source's target gives whole epochs plus a rest; blocks are permuted for each epoch, and the rest is filled with
   permuted blocks that still fit, which leaves an error below one small block.
3. The exact block quotas of all sources are split over the output shards by a binary tree: each node deals its quota
   vector to its two halves by a multivariate hypergeometric draw, as if the shuffled deck of all draws were cut there.
4. A shard takes the next run of each source's permuted draws: runs are disjoint, so a block of an epoch goes to one
   shard.  Rows are ordered within a shard by a hash.
Documents meet their draws through a broadcast of the block table, so texts are never shuffled to choose them.

Up to MAX_SOURCES sources the driver plans, with at most MAX_SOURCES * BLOCKS rows in hand.  Above that sources are dealt
into bundles: targets come from repeated sums over the table of sources, each bundle's task plans its own sources, the
tree deals bundles to shards and each bundle's quotas are dealt to its sources in turn, which is the same distribution;
the block table is then a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.tables import keep

BLOCKS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
MAX_SOURCES = 1_000
BUNDLE_ROWS = 200_000
SEED = 7
PARTS = 64  # pieces of an output shard, each sorted by itself


def word_count(text: Column) -> Column:
    """Number of maximal runs of anything but the six ASCII white-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("long")


def block_targets(sizes: list[int], weights: list[float], total: float, cap: float = MAX_EPOCHS) -> list[float]:
    """Shares of ``total`` by weight, none above cap * size: the excess is shared again by weight among the others."""
    target = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if weights[i] > 0], float(total)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * scale > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * scale
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(full)]
    return target


def split_quotas(quota: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """(n_shards, sources): the leaves of the splitting tree.  Row sums differ by at most one, columns sum to quota."""
    out = np.zeros((n_shards, len(quota)), dtype=np.int64)
    stack = [(0, n_shards, quota.astype(np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid, total, n = (lo + hi) // 2, int(q.sum()), int(quota.sum())
        # shard s holds draws floor(s*n/shards) .. floor((s+1)*n/shards)
        left = mid * n // n_shards - lo * n // n_shards
        rng = np.random.default_rng([seed, lo, hi])
        draw = rng.multivariate_hypergeometric(q, left, method="marginals") if total else q
        stack += [(lo, mid, draw), (mid, hi, q - draw)]
    return out


@dataclass(frozen=True)
class Plan:
    """targets by source position, and draws (source position, block, epoch, shard)."""

    targets: list[float]
    draws: list[tuple[int, int, int, int]]


def build_deck(w: np.ndarray, target: float, seed: list[int]) -> list[tuple[int, int]]:
    """(block, epoch) in order for one source: whole epochs, then permuted blocks that still fit, and one more where it
    brings the words nearer to the target.  ``w``: words by block, -1 where it has no documents."""
    size, rest = int(w[w >= 0].sum()), target
    rng = np.random.default_rng(seed)
    deck: list[tuple[int, int]] = []
    used = np.flatnonzero(w >= 0)
    whole = int(rest // size) if size else 0
    for epoch in range(whole):
        deck += [(int(b), epoch) for b in rng.permutation(used)]
    rest -= whole * size
    small = None
    for b in rng.permutation(used[w[used] > 0]) if size else []:
        if w[b] <= rest:
            deck.append((int(b), whole))
            rest -= int(w[b])
        elif small is None or w[b] < w[small]:
            small = int(b)
    if small is not None and abs(rest - int(w[small])) < rest:
        deck.append((small, whole))
    return deck


def plan_draws(words: list[np.ndarray], targets: list[float], n_shards: int, seed: int) -> Plan:
    """Which blocks each epoch takes and which shard gets them; ``words[s][b]`` are the words of
    block b of source s, -1 where it has no documents."""
    decks = [build_deck(w, targets[s], [seed, s]) for s, w in enumerate(words)]
    leaves = split_quotas(np.array([len(d) for d in decks], dtype=np.int64), n_shards, seed)
    ends = np.cumsum(leaves, axis=0)
    draws = []
    for s, deck in enumerate(decks):
        shard = np.searchsorted(ends[:, s], np.arange(len(deck)), side="right")
        draws += [(s, b, epoch, int(k)) for (b, epoch), k in zip(deck, shard, strict=True)]
    return Plan(targets, draws)


def drawn(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, n_shards: int = 16, blocks: int = BLOCKS, seed: int = SEED, share: float = 1.0) -> DataFrame:
    """row (all columns of ``docs`` as a struct), size, source_size, target (its source's) and draws, an array of
    (epoch, shard): the document's copies in the mix.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all words.  A document is in a
    source's epoch at most once, so its copies are at most 3.  Documents without words have size 0 and may be drawn in
    whole epochs.  Null ids hash like a value of their own; rows that repeat an id are drawn together; a very long document
    weighs its block, and a source's taken words miss its target by at most half of its smallest block left; sources of
    equal names are one; an empty table gives an empty table."""
    spark = docs.sparkSession
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(blocks)).cast("int")
    blocked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), block.alias("block"))
    per_source = keep(blocked.groupBy("source", "block").agg(F.sum("size").alias("words")))
    names = sorted((r.source for r in per_source.select("source").distinct().limit(MAX_SOURCES + 1).collect()), key=lambda x: (x is None, x or ""))
    if len(names) > MAX_SOURCES:
        draws = bundled_draws(per_source, weights, n_shards, seed, share)
    else:
        place = {x: i for i, x in enumerate(names)}
        words = [np.full(blocks, -1, dtype=np.int64) for _ in names]
        for r in per_source.collect():
            words[place[r.source]][r.block] = r.words
        sizes = [int(w[w >= 0].sum()) for w in words]
        targets = block_targets(sizes, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(sizes))
        by_block: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for s, b, epoch, k in plan_draws(words, targets, n_shards, seed).draws:
            by_block.setdefault((s, b), []).append((epoch, k))
        table = [(names[s], int(b), sizes[s], float(targets[s]), by_block.get((s, int(b)), [])) for s in range(len(names)) for b in np.flatnonzero(words[s] >= 0)]
        draws = F.broadcast(spark.createDataFrame(table, DRAWS))
    joined = blocked.join(draws, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select("row", "size", "source_size", "target", "draws")


DRAWS = "s string, b int, source_size long, target double, draws array<struct<epoch:int,shard:int>>"


def source_targets(per_source: DataFrame, weights: tuple[float, ...], share: float, cap: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target: as ``block_targets``, for a table of sources of any number.

    Places in code-point order come from the sizes of sorted ranges; a round of the sharing is one sum over the table."""
    totals = keep(per_source.groupBy("source").agg(F.sum("words").alias("source_size")).repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    parts = totals.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", before.alias("before"))
    # UTF-8 order is code-point order
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = totals.withColumn("place", place).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("place"))
    ranked = keep(ranked.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int")).alias("weight")))
    full, limit = F.lit(0.0), cap * F.col("source_size")
    total = float((ranked.agg(F.sum("source_size")).first()[0] or 0) * share)
    scale = 0.0
    while True:
        is_full = (F.col("weight") * scale > limit) if scale else F.lit(False)
        open_ = ~is_full & (F.col("weight") > 0)
        w, taken = ranked.agg(F.sum(F.when(open_, F.col("weight"))), F.coalesce(F.sum(F.when(is_full, limit)), full)).first()
        new = (total - taken) / w if w else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return ranked.select("source", "source_size", F.least(F.col("weight") * scale, limit).cast("double").alias("target"))


def bundled_draws(per_source: DataFrame, weights: tuple[float, ...], n_shards: int, seed: int, share: float) -> DataFrame:
    """The table of draws where sources are too many for the driver; a task holds one bundle of sources."""
    bundles = max(1, -(-per_source.count() // BUNDLE_ROWS))
    bundle = F.pmod(F.xxhash64(F.lit(seed + 1), "source"), F.lit(bundles)).cast("int")
    placed = per_source.join(source_targets(per_source, weights, share).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("bundle", bundle)

    def decks(rows: pd.DataFrame) -> dict:
        out = {}
        for name, own in rows.sort_values(["s", "block"], na_position="last").groupby("s", dropna=False, sort=True):
            w = np.full(int(own["block"].max()) + 1, -1, dtype=np.int64)
            w[own["block"].to_numpy()] = own["words"].to_numpy()
            text = None if pd.isna(name) else str(name)
            out[text] = own, build_deck(w, float(own["target"].iloc[0]), [seed, zlib.crc32((text or "").encode()), text is None])
        return out

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bundle": [rows["bundle"].iloc[0]], "n": [sum(len(d) for _, d in decks(rows).values())]})

    sizes = np.zeros(bundles, dtype=np.int64)
    for r in placed.groupBy("bundle").applyInPandas(count, "bundle int, n long").collect():
        sizes[r.bundle] = r.n
    leaves = split_quotas(sizes, n_shards, seed)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["bundle"].iloc[0])
        planned = decks(rows)
        left = np.array([len(d) for _, d in planned.values()], dtype=np.int64)
        rng = np.random.default_rng([seed, number, n_shards])
        quota = np.zeros((n_shards, len(left)), dtype=np.int64)
        for k in range(n_shards):
            quota[k] = rng.multivariate_hypergeometric(left, int(leaves[k, number]), method="marginals") if left.sum() else 0
            left = left - quota[k]
        out = []
        for i, (name, (own, deck)) in enumerate(planned.items()):
            shard = np.searchsorted(np.cumsum(quota[:, i]), np.arange(len(deck)), side="right")
            drawn: dict[int, list] = {}
            for (b, epoch), k in zip(deck, shard.tolist(), strict=True):
                drawn.setdefault(b, []).append({"epoch": epoch, "shard": k})
            out += [(name, int(b), int(own["source_size"].iloc[0]), float(own["target"].iloc[0]), drawn.get(int(b), [])) for b in own["block"]]
        return pd.DataFrame(out, columns=["s", "b", "source_size", "target", "draws"])

    return placed.groupBy("bundle").applyInPandas(deal, DRAWS)


def _beside(df: DataFrame, new: list[Column], names: list[str]) -> DataFrame:
    """The fields of ``row`` and the new columns; a field that a new column is named after gives way."""
    own = [f for f in df.schema["row"].dataType.names if f.lower() not in names]
    return df.select(*[F.col("row")[f].alias(f) for f in own], *new)


def with_draws(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with size, source_size, target and draws."""
    names = ["size", "source_size", "target", "draws"]
    return _beside(drawn(docs, **options), [F.col(n) for n in names], names)


def _order_key(options: dict) -> Column:
    """Place of a draw in its shard's local shuffle."""
    return F.xxhash64(F.lit(options.get("seed", SEED)), F.col("d.shard"), F.col("d.epoch"), F.col("row.doc_id"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row for each copy, with epoch, out_shard and order_key (the local shuffle of its shard)."""
    each = drawn(docs, **options).select("row", F.explode("draws").alias("d"))
    return _beside(each, [F.col("d.epoch").alias("epoch"), F.col("d.shard").alias("out_shard"), _order_key(options).alias("order_key")], ["epoch", "out_shard", "order_key"])


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mix with just the columns of ``docs``, in the order of the mix: partitions hold parts of one output shard,
    shuffled.  Edges as in ``drawn``; clashing columns keep their places."""
    each = drawn(docs, **options).select("row", F.explode("draws").alias("d"))
    placed = each.select("row", F.col("d.shard").alias("shard"), _order_key(options).alias("key"))
    return placed.repartition("shard", F.pmod("key", F.lit(PARTS))).sortWithinPartitions("shard", "key").select("row.*")


def write_mix(mix: DataFrame, path: str) -> None:
    """Shuffle each output shard locally and write it to its folder, in PARTS files."""
    mix.repartition("out_shard", F.pmod("order_key", F.lit(PARTS))).sortWithinPartitions("out_shard", "order_key").write.partitionBy("out_shard").parquet(path)
