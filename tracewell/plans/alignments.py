"""Registered queries that put alignments, model and scaling together, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import emissions as em
from ..functions import sequences as sq
from ..operators import scaling, windows
from .projection import MODEL, SERIES, K, kmer_model, series, with_sql
from .registry import query

S, SM = with_sql(SERIES), with_sql(SERIES, MODEL)
LETTERS = "ACEGOT"


def r(c, digits: int = 6):
    """Rounded as the SQL's engine does it, the scaled double half away from zero; Spark's own rounds the shortest decimal."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 10.0**digits) / 10.0**digits


@query("full_rows", SM + """SELECT event_id, CASE WHEN (strand = 't') = forward THEN ref_pos + 7 ELSE 97 - (ref_pos + 93) END AS ref_pos,
  CASE WHEN (strand = 't') = forward THEN kmer ELSE reverse(translate(kmer, 'ACGTE', 'TGCAG')) END AS ref_kmer, CAST(read_id AS VARCHAR) AS read, strand, event_index AS event_ix,
  round(mean, 6) AS event_mean, round(stdv, 6) AS event_noise, round(duration, 6) AS event_duration, kmer AS path_kmer, round(level_mean * 1.1 + 2.5, 9) AS scaled_mean,
  round(noise_mean, 9) AS model_noise, round(posterior, 6) AS posterior, round((mean + 0.9 * level_mean - 1.1 * level_mean - 2.5) / 0.9, 9) AS descaled_mean, round(level_mean, 9) AS level_mean
FROM series JOIN model USING (kmer) WHERE posterior >= 0.01""")
def full_rows(spark, sf_dir):
    """Pairs over the threshold as rows of the full table: place on the reference, event, model level scaled, event descaled."""
    s = series(spark, sf_dir)
    st, fw, level = F.col("strand"), F.col("forward"), F.col("level_mean")
    scale, shift, var = F.lit(1.1), F.lit(2.5), F.lit(0.9)
    return s.where("posterior >= 0.01D").join(kmer_model(s), "kmer").select(
        "event_id", sq.reference_position(F.col("ref_pos"), F.lit(7), F.lit(100), K, st, fw).cast("long").alias("ref_pos"), sq.strand_kmer(F.col("kmer"), st, fw).alias("ref_kmer"),
        F.col("read_id").cast("string").alias("read"), "strand", F.col("event_index").alias("event_ix"), r("mean").alias("event_mean"), r("stdv").alias("event_noise"), r("duration").alias("event_duration"),
        F.col("kmer").alias("path_kmer"), r(level * scale + shift, 9).alias("scaled_mean"), r("noise_mean", 9).alias("model_noise"), r("posterior").alias("posterior"),
        r(em.descale(F.col("mean"), level, scale, shift, var), 9).alias("descaled_mean"), r(level, 9).alias("level_mean"),
    )


@query("ordered_pairs", S + "SELECT read_id, ref_pos AS x, event_index AS y, row_number() OVER (PARTITION BY read_id ORDER BY ref_pos + event_index, ref_pos) AS at FROM series")
def ordered_pairs(spark, sf_dir):
    """Each read's pairs in order of x + y; ties by x."""
    by = Window.partitionBy("read_id").orderBy(F.col("ref_pos") + F.col("event_index"), "ref_pos")
    return series(spark, sf_dir).select("read_id", F.col("ref_pos").alias("x"), F.col("event_index").alias("y"), F.row_number().over(by).cast("long").alias("at"))


@query("column_weights", S + "SELECT ref_pos AS col, count(*) AS n, round(sum(posterior), 5) AS weight FROM series WHERE posterior IS NOT NULL GROUP BY ref_pos")
def column_weights(spark, sf_dir):
    """Members and total weight of every alignment column."""
    rows = series(spark, sf_dir).where("posterior is not null")
    return rows.groupBy(F.col("ref_pos").alias("col")).agg(F.count("*").alias("n"), r(F.sum("posterior"), 5).alias("weight"))


@query("column_adjacency", S + ", a AS (SELECT ref_pos AS col, lead(ref_pos) OVER (PARTITION BY read_id ORDER BY event_index) AS next_col FROM series) SELECT col, next_col, count(*) AS n FROM a WHERE next_col <> col GROUP BY ALL")
def column_adjacency(spark, sf_dir):
    """How many times a read goes straight from one column to another."""
    by = Window.partitionBy("read_id").orderBy("event_index")
    steps = series(spark, sf_dir).select(F.col("ref_pos").alias("col"), F.lead("ref_pos").over(by).alias("next_col"))
    return steps.where("next_col <> col").groupBy("col", "next_col").agg(F.count("*").alias("n"))


@query("anchor_kmers", S + ", k AS (SELECT read_id, ref_pos, max(event_index) AS event_index FROM series GROUP BY ALL), c AS (SELECT ref_pos, min(kmer) AS ref_kmer FROM series WHERE kmer IS NOT NULL GROUP BY ref_pos) SELECT read_id, ref_pos, event_index, event_id, ref_kmer, kmer = ref_kmer AS agrees FROM k JOIN series USING (read_id, ref_pos, event_index) JOIN c USING (ref_pos)")
def anchor_kmers(spark, sf_dir):
    """Each read's last event at a reference position, beside that position's k-mer: two joins on equal keys."""
    s = series(spark, sf_dir)
    last = s.groupBy("read_id", "ref_pos").agg(F.max("event_index").alias("event_index"))
    reference = s.where("kmer is not null").groupBy("ref_pos").agg(F.min("kmer").alias("ref_kmer"))
    both = last.join(s, ["read_id", "ref_pos", "event_index"]).join(reference, "ref_pos")
    return both.select("read_id", "ref_pos", "event_index", "event_id", "ref_kmer", (F.col("kmer") == F.col("ref_kmer")).alias("agrees"))


@query("factor_stats", S + "SELECT substr(kmer, 2, 2) AS parent, kmer, count(*) AS n, round(sum(mean), 4) AS total, round(sum(mean * mean) - sum(mean) * sum(mean) / count(*), 2) AS ssd FROM series WHERE kmer IS NOT NULL AND mean IS NOT NULL GROUP BY ROLLUP (substr(kmer, 2, 2), kmer)")
def factor_stats(spark, sf_dir):
    """Count, sum and squared deviations of the levels at and below every node of the k-mer tree; null is the level above."""
    rows = series(spark, sf_dir).where("kmer is not null and mean is not null").select(sq.at(F.col("kmer"), 1, 2).alias("parent"), "kmer", "mean")
    n, total, x = F.count("*"), F.sum("mean"), F.col("mean")
    return rows.rollup("parent", "kmer").agg(n.alias("n"), r(total, 4).alias("total"), r(F.sum(x * x) - total * total / n, 2).alias("ssd"))


@query("label_union", S + """, c AS (SELECT kmer, strand, mean, event_id FROM series WHERE kmer IS NOT NULL AND posterior >= 0.1)
SELECT 'C' AS label, event_id, strand, kmer, round(mean, 6) AS level FROM c WHERE event_id % 3 = 0
UNION ALL SELECT 'E', event_id, strand, translate(kmer, 'C', 'E'), round(mean, 6) FROM c WHERE event_id % 3 = 1 AND contains(kmer, 'C')
UNION ALL SELECT 'O', event_id, strand, translate(kmer, 'C', 'O'), round(mean, 6) FROM c WHERE event_id % 3 = 2 AND contains(kmer, 'C')""")
def label_union(spark, sf_dir):
    """Assignments of an unlabelled and two labelled groups, in one table."""
    c = series(spark, sf_dir).where("kmer is not null and posterior >= 0.1D").select("event_id", "strand", "kmer", r("mean").alias("level"))
    one = lambda k, to: c.where((F.col("event_id") % 3 == k) & F.contains("kmer", F.lit("C"))).withColumn("kmer", F.translate("kmer", "C", to)).withColumn("label", F.lit(to))
    plain = c.where("event_id % 3 = 0").withColumn("label", F.lit("C"))
    return plain.unionByName(one(1, "E")).unionByName(one(2, "O")).select("label", "event_id", "strand", "kmer", "level")


@query("legacy_rank", S + ", k AS (SELECT DISTINCT translate(kmer, 'G', 'N') AS kmer FROM series WHERE event_id % 2 = 0 AND kmer IS NOT NULL UNION SELECT DISTINCT kmer FROM series WHERE kmer IS NOT NULL), p AS (SELECT kmer, strpos('ACEGOT', kmer[1]) AS a, strpos('ACEGOT', kmer[2]) AS b, strpos('ACEGOT', kmer[3]) AS c FROM k) SELECT kmer, CAST(CASE WHEN least(a, b, c) = 0 THEN 216 ELSE (a - 1) * 36 + (b - 1) * 6 + c - 1 END AS BIGINT) AS rank FROM p")
def legacy_rank(spark, sf_dir):
    """Ranks over six letters; a k-mer with any other letter has the first rank beyond all others."""
    s = series(spark, sf_dir).where("kmer is not null")
    kmers = s.where("event_id % 2 = 0").select(F.translate("kmer", "G", "N").alias("kmer")).union(s.select("kmer")).distinct()
    known = F.translate("kmer", LETTERS, "") == ""
    return kmers.select("kmer", F.when(known, sq.kmer_rank(F.col("kmer"), LETTERS, K)).otherwise(len(LETTERS) ** K).cast("long").alias("rank"))


@query("confident_events", S + "SELECT event_id, read_id, row_number() OVER (PARTITION BY read_id ORDER BY event_index) - 1 AS event_index, round(mean, 6) AS mean FROM series WHERE posterior >= 0.5")
def confident_events(spark, sf_dir):
    """Events whose probability reaches the threshold, counted anew from 0."""
    by = Window.partitionBy("read_id").orderBy("event_index")
    return series(spark, sf_dir).where("posterior >= 0.5D").select("event_id", "read_id", (F.row_number().over(by) - 1).cast("long").alias("event_index"), r("mean").alias("mean"))


@query("calibrated_reads", SM + """, q AS (SELECT *, mean - 0.01 * start AS x, 1 / (level_sd * level_sd) AS v FROM series JOIN model USING (kmer)),
w AS (SELECT read_id, count(*) AS n, sum(v) AS a, sum(v * level_mean) AS b, sum(v * level_mean * level_mean) AS c, sum(v * x) AS d, sum(v * level_mean * x) AS e FROM q GROUP BY read_id),
f AS (SELECT read_id, (d * c - b * e) / (a * c - b * b) AS shift, (a * e - b * d) / (a * c - b * b) AS scale FROM w WHERE a * c - b * b > 1e-9)
SELECT read_id, count(*) AS n, round(sum(v * x) / sum(v), 3) AS mean, round(sum(v * (shift + scale * level_mean)) / sum(v), 3) AS fitted FROM q JOIN f USING (read_id) GROUP BY read_id""")
def calibrated_reads(spark, sf_dir):
    """Drift taken out, shift and scale estimated and applied: weighted means of events and of their fitted levels agree."""
    s = series(spark, sf_dir)
    rows = s.withColumn("mean", windows.remove_drift(F.col("mean"), F.col("start"), F.lit(0.01))).join(kmer_model(s), "kmer")
    fit = scaling.scale_shift(rows).where("shift is not null").select("read_id", "shift", "scale")
    v = 1 / (F.col("level_sd") * F.col("level_sd"))
    fitted = F.col("shift") + F.col("scale") * F.col("level_mean")
    of = lambda c: r(F.sum(v * c) / F.sum(v), 3)
    return rows.join(fit, "read_id").groupBy("read_id").agg(F.count("*").alias("n"), of(F.col("mean")).alias("mean"), of(fitted).alias("fitted"))
