"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

This is union-find for edges that do not fit one machine: each step points every node to the smallest node among its
neighbours, which halves path lengths, and the forest that is left when nothing changes is a star around each
component's smallest node.  Edges never reach the driver; each step is two aggregations and a join, both sides of which
Spark may split when a node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import drop, kept_at


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """Edges (u, v) with u > v; large: link larger neighbours to the minimum, small: the node and its smaller ones.

    The minima are a table of their own, so that both sides of the join come from plain exchanges, which Spark splits
    where one node has very many neighbours.  Also gives that table's path, to be dropped once the result is written."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least, path = kept_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct(), path


def _summary(edges: DataFrame) -> tuple:
    """Count and order-free checksum: equal ones mean that a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges may repeat and be in either direction; self-loops and edges with a null end are left out."""
    spark = edges.sparkSession
    start = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = kept_at(start)
    seen = _summary(now)
    while seen[0]:
        before, used = seen, [path]
        for large in (True, False):
            step, minima = _star(now, large)
            now, path = kept_at(step)
            used += [minima, path]
        for old in used[:-1]:
            drop(spark, old)
        seen = _summary(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
