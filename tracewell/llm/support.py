"""What several training-data operators share on the Spark side."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c):
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only without a cluster, as in tests, a new temporary folder stands in."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tracewell-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run within it are removed as each one ends, since their rows are read from what they wrote."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared folder: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # planned anew, under that setting


def kept_table(df: DataFrame) -> DataFrame:
    """Like `cut`, as a Parquet table in the shared folder: smaller than a checkpoint where columns repeat values."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shards_for(df: DataFrame, text: str, bytes_each: int) -> int:
    """Number of shards for work on all of `df`: the shuffle partitions, or more if they would exceed `bytes_each` of text."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(shards(df.sparkSession), int(size) // bytes_each)
