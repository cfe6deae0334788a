"""Tables in the folder that all executors share, for what several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in `spark.checkpoint.dir`.

    Only without a cluster, as in tests, a temporary folder stands in where that is unset.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracewell-"))
    return f"{sc.getCheckpointDir().rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read again from the shared folder, so that a lost executor loses none of them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
