"""The engine's entities as a deterministic projection of the provided tables, in Spark and as SQL text.

A read is a user's events in order of time; an event's type is its base, its value its level, `props.k` its reference
position. Strand and direction come from the parity of ids, a posterior from the value's share of its position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import table

K = 3
ROWS = 50_000  #: events of a partition, above which a table has more partitions than the session's shuffles
BASES = {"click": "A", "error": "C", "purchase": "E", "signup": "G", "view": "T"}


def by_read(spark: SparkSession, ev: DataFrame) -> DataFrame:
    """Events by read, in as many partitions as keep each near ROWS; few events are left to the session's own number."""
    parts = ev.count() // ROWS  # counted from the files' footers
    return ev.repartition(parts, "user_id") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else ev


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of all reads. The sum behind a posterior is taken in the read's order, so that it is the same however rows are dealt."""
    ev = by_read(spark, table(spark, sf_dir, "events"))
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = F.coalesce(*[F.when(F.col("event_type") == t, b) for t, b in BASES.items()])
    rows = ev.select(
        "user_id", "event_id", "ts", base.alias("base"), F.col("value").alias("mean"), (1 + (F.col("event_id") % 7) / 10).alias("stdv"), us.alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("ref_pos"),
        F.when(F.col("event_id") % 2 == 0, "t").otherwise("c").alias("strand"), (F.col("user_id") % 2 == 0).alias("forward"),
    )
    at = rows.select(
        F.col("user_id").alias("read_id"), "event_id", (F.row_number().over(own) - 1).cast("long").alias("event_index"), "base", "mean", "stdv", "ref_pos", "strand", "forward",
        ((F.col("us") - F.first("us").over(whole)) / 1e6).alias("start"),
        (F.coalesce(F.lead("us").over(own) - F.col("us"), F.lit(0)) / 1e6).alias("duration"),
        F.concat("base", *[F.lead("base", i).over(own) for i in range(1, K)]).alias("kmer"),
    )
    per = Window.partitionBy("read_id", "ref_pos").orderBy("event_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return at.withColumn("posterior", F.col("mean") / F.nullif(F.sum("mean").over(per), F.lit(0.0)))


SERIES = """
e0 AS (
  SELECT user_id AS read_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS event_index,
    CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'C' WHEN 'purchase' THEN 'E' WHEN 'signup' THEN 'G' WHEN 'view' THEN 'T' END AS base,
    value AS mean, 1 + (event_id % 7) / 10.0::DOUBLE AS stdv, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ref_pos,
    CASE WHEN event_id % 2 = 0 THEN 't' ELSE 'c' END AS strand, user_id % 2 = 0 AS forward
  FROM events),
series AS (
  SELECT *, (us - first_value(us) OVER w) / 1e6 AS start, coalesce(lead(us) OVER w - us, 0) / 1e6 AS duration,
    CASE WHEN lead(base, 2) OVER w IS NOT NULL THEN base || lead(base, 1) OVER w || lead(base, 2) OVER w END AS kmer,
    mean / nullif(sum(mean) OVER (PARTITION BY read_id, ref_pos), 0) AS posterior
  FROM e0 WINDOW w AS (PARTITION BY read_id ORDER BY event_index))"""


def kmer_model(s: DataFrame) -> DataFrame:
    """Level and noise parameters of every k-mer seen twice or more."""
    by = s.where("kmer is not null").groupBy("kmer").agg(F.avg("mean").alias("level_mean"), F.stddev_pop("mean").alias("level_sd"), F.avg("stdv").alias("noise_mean"), F.stddev_pop("stdv").alias("noise_sd"), F.count("*").alias("n"))
    return by.where("n > 1 and level_sd > 0 and noise_sd > 0").withColumn("noise_lambda", F.pow("noise_mean", F.lit(3.0)) / (F.col("noise_sd") * F.col("noise_sd")))


MODEL = """
model AS (
  SELECT *, pow(noise_mean, 3) / (noise_sd * noise_sd) AS noise_lambda FROM (
    SELECT kmer, avg(mean) AS level_mean, stddev_pop(mean) AS level_sd, avg(stdv) AS noise_mean, stddev_pop(stdv) AS noise_sd, count(*) AS n
    FROM series WHERE kmer IS NOT NULL GROUP BY kmer) WHERE n > 1 AND level_sd > 0 AND noise_sd > 0)"""


def sequences(s: DataFrame) -> DataFrame:
    """read_id, sequence: the bases of each read in order."""
    items = F.array_sort(F.collect_list(F.struct("event_index", "base")))
    return s.groupBy("read_id").agg(F.array_join(F.transform(items, lambda x: x["base"]), "").alias("sequence"))


SEQUENCES = "seqs AS (SELECT read_id, string_agg(base, '' ORDER BY event_index) AS sequence FROM series GROUP BY read_id)"


def anchors(s: DataFrame) -> DataFrame:
    """Candidate pairs (x on the reference, y in the read) of each read."""
    return s.select("read_id", F.col("ref_pos").alias("x"), F.col("event_index").alias("y"))


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"
