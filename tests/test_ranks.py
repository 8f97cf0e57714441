"""Ranks over ranges whose borders are drawn from a sample: numbered and counted over the same ranges."""

from pyspark.sql import functions as F

from spanloom.operators import builds as B
from spanloom.operators import records as R


def _rows(spark, n):
    return spark.range(n, numPartitions=4).select("id", (F.pmod(F.col("id") * 7919, F.lit(n))).alias("size"), F.concat(*[F.sha2(F.concat("id", F.lit(i)).cast("string"), 512) for i in range(3)]).alias("text"))


def test_ranks_over_sampled_ranges(spark):
    """Small ranges are joined, and those of narrow rows are joined further than those of wide ones."""
    n, small = 10_000, {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        ranked = B.with_rank(_rows(spark, n), ["size"], "n").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == F.col("size") + 1).alias("right")).first()
        assert (ranked.rows, ranked.right) == (n, n)
        got = sorted(r.size for r in R.systematic_sample(_rows(spark, n), "size", "id", 30).collect())
        assert got == [k * n // 30 for k in range(30)]
    finally:
        for k in small:
            spark.conf.unset(k)
