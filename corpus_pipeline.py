"""A training-data pipeline over ``documents``: five stages, each on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontaminate, mixing, near_dup, sharding, toxicity
from spanloom.llm.tables import keep

N_SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects at their language's threshold (0.5 without a lang column).

    Null and empty texts stay; very long ones are scored whole; repeated rows share their fate; extra columns stay; without
    documents or labels nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.fit(docs, labels))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8, the one of the smallest doc_id.

    Rows without words or without a doc_id stay; of rows that repeat a doc_id and text one does; extra columns stay."""
    return near_dup.representatives(docs, per_cent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, as it is or with other numbers, names or units.

    Null and empty texts stay; very long ones are searched whole; repeated rows share their fate; extra columns stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that the targets of the sources ask for, in the order of its shards and their shuffle.

    A null source is one of its own; rows without words may be drawn with their block; extra columns stay."""
    return mixing.copies(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With size, virtual_slot and shard, by the map that is stored for this pipeline's output, edited if need be.

    Columns of these names are replaced; null texts have no bytes; equal rows share a shard."""
    return sharding.shard(docs, N_SHARDS, folder=sharding.map_folder(spark, f"pipeline {sf_dir}"))[0]


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", keep_representatives),
    ("decontaminate", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Training, signatures and random draws have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
