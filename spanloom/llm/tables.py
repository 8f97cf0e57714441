"""Intermediate tables in the folder that all executors share, and small helpers that several operators need."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.shared import shared_folder


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs a
    re-read and not a re-run, and the next plan sees real sizes.  Schema is passed on, so empty tables work."""
    return kept_at(df)[0]


def kept_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As ``keep``, with the path, for tables that a loop supersedes and drops."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def exists(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match ``pattern``, in any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(str(x.getPath()) for x in found or [])


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


BATCH_BYTES = 4 << 20


def giving_back(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` with what Arrow has freed given back to the system after each batch: workers outlive their tasks, and their
    pools would keep the room of the largest batches that they ever had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for out in function(batches):
            yield out
            del out
            pool.release_unused()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_BYTES and one row, unless the session asks for smaller ones: texts of
    any length then cost a task, on both sides, memory for one batch or one text.  Spark reads that setting when the plan
    runs, so the session keeps it."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").strip().lower()
    size = int(re.sub(r"[^0-9-]", "", now)) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(re.sub(r"[0-9b-]", "", now)[:1], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(giving_back(function), schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
