"""Site calls from a stream of alignment rows: running posterior sums, and the same per window of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def site_sums(stream: DataFrame, alphabet: str, key: tuple[str, ...] = ("ref_pos", "strand")) -> DataFrame:
    """Per key the number of rows and each base's summed posterior so far; sums add up, so shares are taken on reading.

    Works alike on a stream (output mode update or complete) and on a table. The state is one row per key.
    """
    each = [F.sum(F.when(F.col("base") == b, F.col("posterior")).otherwise(0.0)).alias(f"s{b}") for b in alphabet]
    return stream.groupBy(*key).agg(F.count("*").alias("depth"), *each)


def windowed_depth(stream: DataFrame, time: str, late: str, width: str, slide: str | None = None, key: tuple[str, ...] = ("base",)) -> DataFrame:
    """Rows per key and window of event time; rows later than `late` behind the newest are dropped, and windows before that end."""
    at = F.window(time, width, slide) if slide else F.window(time, width)
    counts = stream.withWatermark(time, late).groupBy(at.alias("w"), *key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *key, "n")


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs a stream over what is there now into Parquet files; a later call with the same checkpoint goes on from there."""
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
