"""Merging the spans of several voters.

A voter is a bit (voter_ord), so distinct voters are ``bit_count(bit_or(...))``: one pass with map-side combining, no
expansion for DISTINCT.  Ties go to the first vote by (voter_ord, item_ord).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import surface
from spanloom.operators.spans import greedy, islands

KEY = ["doc_id", "start", "end", "type"]


def voter_bit() -> Column:
    return F.expr("shiftleft(1L, voter_ord)")


def mode_per_key(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys, value: the most frequent value of each key; ties go to the value seen first by ``order``."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    least = F.struct((-F.col("_n")).alias("n"), F.col("_first"))
    return counted.groupBy(*keys).agg(F.min_by(value, least).alias(value))


def votes_per_key(votes: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """keys, text, n_votes, assertions: distinct voters of each key and the majority label set."""
    by_label = votes.groupBy(*keys, "assertions").agg(F.count("*").alias("n"), F.min(F.struct("voter_ord", "item_ord")).alias("first"), F.bit_or(voter_bit()).alias("bits"), F.min("text").alias("text"))
    least = F.struct((-F.col("n")).alias("n"), F.col("first"))
    return by_label.groupBy(*keys).agg(F.min("text").alias("text"), F.bit_count(F.bit_or("bits")).cast("int").alias("n_votes"), F.min_by("assertions", least).alias("assertions"))


def consensus(votes: DataFrame, k: int) -> DataFrame:
    return votes_per_key(votes).filter(F.col("n_votes") >= k)


def type_order() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in vocab.TYPES]), F.col("type"))


def resolve_overlaps(spans: DataFrame) -> DataFrame:
    """More votes first, then shorter, then earlier, then by type: drop what overlaps a span kept before."""
    return greedy(spans, [-F.col("n_votes"), F.col("end") - F.col("start"), F.col("start"), type_order()], ["type", "text", "n_votes", "assertions"])


def document_order(spans: DataFrame) -> DataFrame:
    """First span wins in (start, end, type) order."""
    return greedy(spans, [F.col("start"), F.col("end"), type_order()], ["type", "text", "assertions"])


def cluster_consensus(votes: DataFrame, k: int, trusted: str | None = None) -> DataFrame:
    """Clusters of overlapping spans of one type, kept with k voters or the trusted one: doc_id, type, start, end,
    support, assertion.  Bounds and label are the cluster's modes, of the trusted voter's votes where it has any."""
    spans = islands(votes, ["doc_id", "type"])
    t = F.col("voter") == trusted if trusted else F.lit(False)
    keys = ["doc_id", "type", "island"]
    each = spans.select(*keys, "voter_ord", F.struct("voter_ord", "item_ord").alias("at"), F.struct("start", "end").alias("bounds"), "assertions", t.alias("t"))
    # a vote counts once for its bounds and once for its labels: both modes in one pass over the exchange of the islands
    sides = F.array(F.struct(F.col("bounds").alias("b"), F.lit(None).cast("array<string>").alias("a")), F.struct(F.lit(None).cast(each.schema["bounds"].dataType).alias("b"), F.col("assertions").alias("a")))
    seen = each.withColumn("v", F.explode(sides)).groupBy(*keys, "v").agg(
        F.count_if("t").alias("nt"), F.count("*").alias("n"), F.min(F.when(F.col("t"), F.col("at"))).alias("ft"), F.min("at").alias("f"), F.bit_or(voter_bit()).alias("bits"), F.bool_or("t").alias("has")
    )
    # a trusted vote outranks any number of others
    least = F.struct((-F.col("nt")).alias("t"), F.when(F.col("nt") > 0, F.col("ft")).alias("ft"), (-F.when(F.col("nt") > 0, 0).otherwise(F.col("n"))).alias("n"), F.col("f"))
    is_bounds = F.col("v.b").isNotNull()
    best = seen.groupBy(*keys).agg(
        F.min_by("v.b", F.when(is_bounds, least)).alias("b"), F.min_by("v.a", F.when(~is_bounds, least)).alias("assertions"), F.bit_count(F.bit_or("bits")).cast("int").alias("support"), F.bool_or("has").alias("has")
    )
    return best.filter((F.col("support") >= k) | F.col("has")).select("doc_id", "type", "b.start", "b.end", "support", "assertions")


def covered_docs(votes: DataFrame) -> DataFrame:
    """Documents in which every voter has a row.  The number of voters is one value of the whole table."""
    total = votes.agg(F.bit_or(voter_bit()).alias("all_bits"))
    return votes.groupBy("doc_id").agg(F.bit_or(voter_bit()).alias("bits")).join(F.broadcast(total), F.col("bits") == F.col("all_bits")).select("doc_id")


def surface_support(votes: DataFrame) -> DataFrame:
    """surface, type, n_voters over all documents."""
    return votes.groupBy(surface(F.col("text")).alias("surface"), "type").agg(F.bit_count(F.bit_or(voter_bit())).cast("int").alias("n_voters"))


def code_map(coded: DataFrame) -> DataFrame:
    """surface, type, codes: the most frequent code list of each surface; first seen (doc_id, start) on ties."""
    return mode_per_key(coded.withColumn("surface", surface(F.col("text"))), ["surface", "type"], "codes", ["doc_id", "start"])


def assign_codes(spans: DataFrame, codes: DataFrame) -> DataFrame:
    """``spans`` with codes: from the map for coded types, else empty.  The map may be large, so Spark picks the join."""
    keyed = spans.drop("codes").withColumn("surface", F.when(F.col("type").isin(*vocab.CODED_TYPES), surface(F.col("text"))))
    none = F.array().cast("array<string>")
    return keyed.join(codes.select("surface", "type", "codes"), ["surface", "type"], "left").withColumn("codes", F.coalesce("codes", none)).drop("surface")
