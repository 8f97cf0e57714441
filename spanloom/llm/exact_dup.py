"""Exact deduplication by skew-safe combining.

Three stages, each comparing whole contents, because the content is part of every grouping key:
1. local: Spark's map-side combine merges equal texts within a task before anything is shuffled;
2. salted: (digest, content, salt) groups, so a text that a third of all rows share is merged in many tasks;
3. global: the salt winners of a digest meet (at most SALTS rows for each text) and the largest doc_id wins.
Winners go back to the salted groups, and rows find theirs by (digest, salt), so the way back is split as well.  The
way back needs the content only where one digest holds several contents; that is looked up, not assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tables import keep, text_or_empty

SALTS = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (needs doc_id and text).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are equal.  The largest
    doc_id of a group stays; null ids lose against any, and a group of null ids has a null keep_id and keeps its rows.
    Repeated rows that share the winning doc_id are all kept.  ``digest`` only speeds up grouping: two contents with one
    digest stay apart."""
    rows = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("content")).select(
        "doc_id", "content", F.unhex(digest(F.col("content"))).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")
    )
    salted = rows.groupBy("digest", "content", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = (
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("used"))
        .groupBy("digest")
        .agg(F.collect_list(F.struct("keep_id", "group_size", "used", "content")).alias("texts"))
        .select("digest", F.size("texts").alias("contents"), F.explode("texts").alias("t"))
        .select("digest", "contents", "t.keep_id", "t.group_size", "t.used", F.when(F.col("contents") > 1, F.col("t.content")).alias("content"))
    )
    winners = keep(whole).select("digest", "contents", "keep_id", "group_size", "content", F.explode("used").alias("salt"))
    hashed = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("content", 256)
    thin = rows.select("doc_id", "digest", "salt", hashed.alias("text_sha256"))
    out = thin.join(winners.filter("contents = 1").drop("contents", "content"), ["digest", "salt"])
    clashes = winners.filter("contents > 1")
    if not clashes.isEmpty():
        full = rows.join(clashes.select("digest", "salt", "content", "keep_id", "group_size"), ["digest", "salt", "content"])
        out = out.unionByName(full.select("digest", "salt", "doc_id", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size"))
    return out.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS content FROM documents),
g AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM n JOIN g USING (content)
"""
