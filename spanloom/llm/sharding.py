"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is a hash of its doc_id and text into SLOTS slots and never changes.  What changes is the map from slots to
shards: it is built from the bytes of each slot, stored as a version in the shared folder, and from then on loaded and
edited when bytes or the number of shards ask for it, so that only whole slots move.  The map has SLOTS rows whatever
the corpus, which is why the driver may hold and broadcast it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.tables import exists, keep, shared_folder

SLOTS = 8192
OVERHEAD = 16
SLACK = 0.005  # a stored map is edited where a shard is this much above the mean
SALTS = 16


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot]; every edit makes the next version and notes the slots it moved."""

    shard_of: tuple[int, ...]
    n_shards: int
    version: int = 1
    moved: tuple[int, ...] = field(default=())

    @staticmethod
    def build(slot_bytes: np.ndarray, n_shards: int) -> SlotMap:
        """Largest slot first onto the lightest shard; ties by slot and shard number."""
        if n_shards < 1:
            raise ValueError("n_shards must be positive")
        loads = [(0, s) for s in range(n_shards)]
        shard_of = np.zeros(len(slot_bytes), dtype=np.int64)
        for slot in np.lexsort((np.arange(len(slot_bytes)), -slot_bytes)):
            load, shard = heapq.heappop(loads)
            shard_of[slot] = shard
            heapq.heappush(loads, (load + int(slot_bytes[slot]), shard))
        return SlotMap(tuple(map(int, shard_of)), n_shards)

    def rebalance(self, slot_bytes: np.ndarray, n_shards: int | None = None, slack: float = SLACK) -> SlotMap:
        """The next version: moves slots from the heaviest to the lightest shard until no shard is more than ``slack``
        above the mean or no move helps.  ``n_shards`` may grow; new shards start empty."""
        n = self.n_shards if n_shards is None else n_shards
        if n < self.n_shards:
            raise ValueError("shards can only be added")
        shard_of = np.array(self.shard_of, dtype=np.int64)
        loads = np.bincount(shard_of, weights=slot_bytes, minlength=n)
        limit = (1 + slack) * loads.sum() / n
        while True:
            heavy, light = int(loads.argmax()), int(loads.argmin())
            gap = loads[heavy] - loads[light]
            own = np.flatnonzero((shard_of == heavy) & (slot_bytes > 0) & (slot_bytes < gap))
            if loads[heavy] <= limit or not len(own):
                break
            slot = own[np.abs(slot_bytes[own] - min(gap / 2, loads[heavy] - loads.sum() / n)).argmin()]
            shard_of[slot] = light
            loads[heavy] -= slot_bytes[slot]
            loads[light] += slot_bytes[slot]
        moved = np.flatnonzero(shard_of != np.array(self.shard_of))
        return SlotMap(tuple(map(int, shard_of)), n, self.version + 1, tuple(map(int, moved)))

    def save(self, spark: SparkSession, folder: str) -> str:
        """Write this version as its own JSON-lines file set; versions never overwrite each other."""
        path = f"{folder.rstrip('/')}/version={self.version:06d}"
        line = json.dumps({"version": self.version, "n_shards": self.n_shards, "shard_of": self.shard_of, "moved": self.moved})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """The given version, or the latest; versions whose writing did not end do not count."""
        done = [x.rsplit("/", 1)[0] for x in exists(spark, f"{folder.rstrip('/')}/version=*/_SUCCESS")]
        path = done[-1] if version is None else next(x for x in done if x.endswith(f"version={version:06d}"))
        x = json.loads(spark.read.text(path).first().value)
        return SlotMap(tuple(x["shard_of"]), x["n_shards"], x["version"], tuple(x["moved"]))

    @staticmethod
    def current(spark: SparkSession, folder: str, slot_bytes: np.ndarray, n_shards: int, slack: float = SLACK) -> SlotMap:
        """The stored map, edited and stored as its next version where it does not fit the bytes or shards any more; the
        first version where there is none yet.  A map for more shards or other slots is built anew."""
        if not exists(spark, f"{folder.rstrip('/')}/version=*/_SUCCESS"):
            new = SlotMap.build(slot_bytes, n_shards)
        else:
            old = SlotMap.load(spark, folder)
            if len(old.shard_of) != len(slot_bytes) or old.n_shards > n_shards:
                new = replace(SlotMap.build(slot_bytes, n_shards), version=old.version + 1)
            else:
                new = old.rebalance(slot_bytes, n_shards, slack)
                if not new.moved and new.n_shards == old.n_shards:
                    return old
        new.save(spark, folder)
        return new

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s) for i, s in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "virtual_slot int, shard int")


def text_crc32() -> Column:
    return F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def map_folder(spark: SparkSession, name: str) -> str:
    """Where the versions of the map of the table ``name`` (any text, such as its path) are kept."""
    return f"{shared_folder(spark)}/slot-map-{hashlib.sha256(name.encode()).hexdigest()}"


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` with virtual_slot (from doc_id and text, so rows without an id, or with one in common, are spread as well)
    and size (UTF-8 bytes of text, none for null, plus 16)."""
    return docs.withColumn("virtual_slot", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text_crc32()), F.lit(slots)).cast("int")).withColumn(
        "size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    )


def slot_bytes(slotted: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes of each slot: a map-side combined sum, at most ``slots`` rows to the driver."""
    out = np.zeros(slots, dtype=np.int64)
    for r in slotted.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect():
        out[r.virtual_slot] = r.bytes
    return out


def shard(docs: DataFrame, n_shards: int, slots: int = SLOTS, slot_map: SlotMap | None = None, folder: str | None = None) -> tuple[DataFrame, SlotMap]:
    """``docs`` with virtual_slot, size and shard, and the map used: the given one, else that of ``folder``, edited if need
    be, else a new one.  Nothing is shuffled but slot totals.

    Columns of those names are replaced, others keep their names and types.  A null doc_id hashes like a value of its own,
    a null or empty text has no bytes, equal rows share a slot, a very long text is one row's bytes (no shard can be smaller),
    slots of equal bytes are dealt by number, and an empty table gives an empty table."""
    slotted = with_slots(docs, slots)
    if slot_map is None:
        total = slot_bytes(slotted, slots)
        slot_map = SlotMap.current(docs.sparkSession, folder, total, n_shards) if folder else SlotMap.build(total, n_shards)
    return slotted.drop("shard").join(F.broadcast(slot_map.table(docs.sparkSession)), "virtual_slot"), slot_map


def positions(sharded: DataFrame, order: list[str]) -> DataFrame:
    """``sharded``, which has a salt below SALTS, with slot: each row's gapless place, from 0, in its shard.

    A shard's rows are never gathered: rows are numbered within their virtual slot and salt, and each of these starts where
    those before it in the same shard end (SLOTS * SALTS totals in all)."""
    counts = sharded.groupBy("shard", "virtual_slot", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("virtual_slot", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "salt").orderBy(*order))
    placed = sharded.withColumn("rank", rank).join(F.broadcast(starts), ["virtual_slot", "salt"])
    return placed.withColumn("slot", (F.col("first") + F.col("rank") - 1).cast("long")).drop("first", "rank", "salt")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows of a shard in virtual-slot order in files of bounded size."""
    sharded.repartition("shard", "virtual_slot").sortWithinPartitions("shard", "virtual_slot").write.partitionBy("shard").parquet(path)


def shard_rows(docs: DataFrame, n_shards: int = 40, folder: str | None = None) -> DataFrame:
    """The digest that the query returns: law ``bytes``.  Edges as in ``shard``; every row has a place of its own, repeated
    rows too."""
    thin = with_slots(docs).select("doc_id", "virtual_slot", "size", text_crc32().alias("text_crc32"))
    thin = keep(thin.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    total = slot_bytes(thin)
    slot_map = SlotMap.current(docs.sparkSession, folder, total, n_shards) if folder else SlotMap.build(total, n_shards)
    placed = thin.join(F.broadcast(slot_map.table(docs.sparkSession)), "virtual_slot")
    return positions(placed, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
