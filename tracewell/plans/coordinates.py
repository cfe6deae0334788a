"""Registered queries on coordinates, selections and model tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import emissions as em
from ..functions import sequences as sq
from ..operators import calls, windows
from ..sources import formats
from .projection import MODEL, SEQUENCES, SERIES, K, kmer_model, sequences, series, with_sql
from .registry import query

S, SM, SQ = with_sql(SERIES), with_sql(SERIES, MODEL), with_sql(SERIES, SEQUENCES)
ALONG = "(strand = 't') = forward"


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query("variant_rows", S + f""", f AS (SELECT *, CASE WHEN {ALONG} THEN translate(kmer, 'C', 'X') ELSE reverse(translate(translate(kmer, 'C', 'X'), 'ACGTE', 'TGCAG')) END AS ref_kmer FROM series WHERE kmer IS NOT NULL)
SELECT event_index AS event_ix, ref_pos + i AS ref_pos, substr(kmer, CAST(CASE WHEN {ALONG} THEN i ELSE 2 - i END AS BIGINT) + 1, 1) AS base, round(posterior, 6) AS posterior, strand, CASE WHEN forward THEN 'forward' ELSE 'backward' END AS direction, CAST(read_id AS VARCHAR) AS read
FROM (SELECT *, unnest(range(3)) AS i FROM f) WHERE substr(ref_kmer, CAST(i AS BIGINT) + 1, 1) = 'X'""")  # fmt: skip
def variant_rows(spark, sf_dir):
    """The bases that reads put at the ambiguous places of their strand's reference k-mers."""
    s = series(spark, sf_dir).where("kmer is not null").withColumn("target_kmer", F.translate("kmer", "C", "X"))
    full = s.select(F.col("event_index").alias("event_ix"), "ref_pos", "target_kmer", sq.strand_kmer(F.col("target_kmer"), F.col("strand"), F.col("forward")).alias("ref_kmer"), F.col("kmer").alias("path_kmer"), r("posterior").alias("posterior"), "strand", "forward", F.col("read_id").cast("string").alias("read"))
    return formats.variant_rows(full)


@query("site_hits", S + ", sites AS (SELECT DISTINCT ref_pos AS site FROM series WHERE base = 'C' AND ref_pos % 9 = 0) SELECT site, event_id, site - ref_pos AS at FROM series JOIN (SELECT site, CAST(unnest(range(site - 2, site + 1)) AS BIGINT) AS ref_pos FROM sites) USING (ref_pos)")
def site_hits(spark, sf_dir):
    """Events whose k-mer lies over a site: the k positions up to it, by an equal join on the exploded range."""
    s = series(spark, sf_dir)
    sites = s.where("base = 'C' and ref_pos % 9 = 0").select(F.col("ref_pos").alias("site")).distinct()
    return sites.withColumn("ref_pos", F.explode(sq.site_range(F.col("site"), K))).join(s, "ref_pos").select("site", "event_id", (F.col("site") - F.col("ref_pos")).alias("at"))


@query("orientation_hits", S + ", h AS (SELECT DISTINCT ref_pos AS hit FROM series WHERE base = 'G' AND ref_pos % 11 = 0) SELECT hit, event_id, forward FROM series JOIN (SELECT hit, CAST(unnest(range(hit - 2, hit + 1)) AS BIGINT) AS ref_pos FROM h) USING (ref_pos) WHERE forward UNION ALL SELECT hit, event_id, forward FROM series JOIN (SELECT hit, CAST(unnest(range(hit - 3, hit)) AS BIGINT) AS ref_pos FROM h) USING (ref_pos) WHERE NOT forward")
def orientation_hits(spark, sf_dir):
    """Hits of forward reads on a range that ends at a place, and of backward reads on one three before it, together."""
    s = series(spark, sf_dir)
    hits = s.where("base = 'G' and ref_pos % 11 = 0").select(F.col("ref_pos").alias("hit")).distinct()
    ahead = hits.withColumn("ref_pos", F.explode(sq.site_range(F.col("hit"), K))).join(s.where("forward"), "ref_pos")
    back = hits.withColumn("ref_pos", F.explode(sq.site_range(F.col("hit") - 1, K))).join(s.where("not forward"), "ref_pos")
    return ahead.unionByName(back).select("hit", "event_id", "forward")


@query("rebased_pairs", S + "SELECT read_id, event_id, CASE WHEN forward THEN ref_pos - min(ref_pos) OVER w ELSE max(ref_pos) OVER w - ref_pos END AS x, event_index - min(event_index) OVER w AS y FROM series WINDOW w AS (PARTITION BY read_id)")
def rebased_pairs(spark, sf_dir):
    """Pairs from 0 on, and counted from the other end where the read runs backward."""
    w = Window.partitionBy("read_id")
    x = F.when(F.col("forward"), F.col("ref_pos") - F.min("ref_pos").over(w)).otherwise(F.max("ref_pos").over(w) - F.col("ref_pos"))
    return series(spark, sf_dir).select("read_id", "event_id", x.alias("x"), (F.col("event_index") - F.min("event_index").over(w)).alias("y"))


@query("strand_slices", SQ + "SELECT read_id, substr(sequence, 3, 10) AS template_target, reverse(translate(substr(sequence, 3, 10), 'ACGTE', 'TGCAG')) AS complement_target, CASE WHEN read_id % 2 = 0 THEN 2 ELSE 12 END AS ref_start, CASE WHEN read_id % 2 = 0 THEN 12 ELSE 2 END AS ref_end FROM seqs")
def strand_slices(spark, sf_dir):
    """A slice of each read for either strand, and its bounds, swapped for reads against the reference."""
    part = sq.at(F.col("sequence"), 2, 10)
    even = F.col("read_id") % 2 == 0
    return sequences(series(spark, sf_dir)).select("read_id", part.alias("template_target"), sq.reverse_complement(part).alias("complement_target"), F.when(even, 2).otherwise(12).alias("ref_start"), F.when(even, 12).otherwise(2).alias("ref_end"))


@query("alphabets", SQ + "SELECT read_id, array_to_string(list_sort(list_distinct(string_split(sequence, ''))), '') AS alphabet, CAST(len(list_distinct(string_split(sequence, ''))) AS INTEGER) AS n FROM seqs")
def alphabets(spark, sf_dir):
    letters = F.array_sort(F.array_distinct(F.filter(F.split("sequence", ""), lambda c: c != "")))
    return sequences(series(spark, sf_dir)).select("read_id", F.array_join(letters, "").alias("alphabet"), F.size(letters).alias("n"))


@query("marked_references", SQ + "SELECT read_id, string_agg(CASE WHEN i % 5 = 0 AND c = 'C' THEN 'X' WHEN i % 5 = 1 AND c = 'A' THEN 'I' ELSE c END, '' ORDER BY i) AS sequence FROM (SELECT read_id, i, substr(sequence, CAST(i AS BIGINT) + 1, 1) AS c FROM (SELECT read_id, sequence, unnest(range(length(sequence))) AS i FROM seqs)) GROUP BY read_id")
def marked_references(spark, sf_dir):
    """Ambiguity characters at listed positions, each only where its own base stands."""
    mark = lambda c, i: F.when((i % 5 == 0) & (c == "C"), "X").when((i % 5 == 1) & (c == "A"), "I").otherwise(c)
    return sequences(series(spark, sf_dir)).select("read_id", F.array_join(F.transform(F.split("sequence", ""), mark), "").alias("sequence"))


@query("pair_similarity", S + "SELECT read_id, round(greatest(0, least(1, sum(posterior) / least(count(*), count(DISTINCT ref_pos)))), 6) AS score FROM series GROUP BY read_id")
def pair_similarity(spark, sf_dir):
    n = F.least(F.count("*"), F.count_distinct("ref_pos"))
    return series(spark, sf_dir).groupBy("read_id").agg(r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum("posterior") / n))).alias("score"))


@query("assignments", SM + "SELECT event_id, kmer, strand, round((mean + 0.9 * level_mean - 1.1 * level_mean - 2.5) / 0.9, 9) AS descaled_mean, round(posterior, 6) AS posterior FROM series JOIN model USING (kmer) WHERE posterior >= 0.3 AND base <> 'T'")
def assignments(spark, sf_dir):
    """Pairs in the match state whose posterior reaches the threshold, with their level on the model's scale."""
    s = series(spark, sf_dir)
    both = s.where("posterior >= 0.3D and base <> 'T'").join(kmer_model(s), "kmer")
    return both.select("event_id", "kmer", "strand", r(em.descale(F.col("mean"), F.col("level_mean"), F.lit(1.1), F.lit(2.5), F.lit(0.9)), 9).alias("descaled_mean"), r("posterior").alias("posterior"))


@query("assignment_counts", S + "SELECT kmer, strand, count(*) AS n FROM series WHERE posterior >= 0.3 AND kmer IS NOT NULL GROUP BY ALL")
def assignment_counts(spark, sf_dir):
    return series(spark, sf_dir).where("posterior >= 0.3D and kmer is not null").groupBy("kmer", "strand").agg(F.count("*").alias("n"))


@query("exported_model", SM + "SELECT 'match' AS state, kmer, round(level_mean, 6) AS level_mean, round(level_sd, 6) AS level_sd FROM model UNION ALL SELECT 'extra', kmer, round(level_mean, 6), round(level_sd * 1.75, 6) FROM model")
def exported_model(spark, sf_dir):
    """The model's table for matches, and the wider one for further events of the same k-mer."""
    m = kmer_model(series(spark, sf_dir)).select("kmer", r("level_mean").alias("level_mean"), "level_sd")
    one = m.select(F.lit("match").alias("state"), "kmer", "level_mean", r("level_sd").alias("level_sd"))
    return one.unionAll(m.select(F.lit("extra"), "kmer", "level_mean", r(F.col("level_sd") * 1.75)))


@query("lognormal_noise", SM + "SELECT kmer, round(ln(pow(noise_mean, 2) / sqrt(pow(noise_sd, 2) + pow(noise_mean, 2))), 6) AS log_mean, round(sqrt(ln(1 + pow(noise_sd, 2) / pow(noise_mean, 2))), 6) AS log_sd FROM model")
def lognormal_noise(spark, sf_dir):
    m, v = F.col("noise_mean"), F.col("noise_sd") * F.col("noise_sd")
    return kmer_model(series(spark, sf_dir)).select("kmer", r(F.ln(m * m / F.sqrt(v + m * m))).alias("log_mean"), r(F.sqrt(F.ln(1 + v / (m * m)))).alias("log_sd"))


@query("percent_differences", SM + "SELECT event_id, round(abs((mean - level_mean) / level_mean) * 100, 6) AS difference FROM series JOIN model USING (kmer)")
def percent_differences(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.join(kmer_model(s), "kmer").select("event_id", r(F.abs((F.col("mean") - F.col("level_mean")) / F.col("level_mean")) * 100).alias("difference"))


@query("descaled_events", S + "SELECT event_id, round((mean - 2.5) / 1.1, 9) AS mean FROM series")
def descaled_events(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", r((F.col("mean") - 2.5) / 1.1, 9).alias("mean"))


@query("kept_model", SM + ", u AS (SELECT kmer, sum(posterior) AS p, sum(posterior * mean) / nullif(sum(posterior), 0) AS u FROM series WHERE kmer IS NOT NULL AND event_id % 3 = 0 GROUP BY kmer) SELECT kmer, round(CASE WHEN u > 0 THEN u ELSE level_mean END, 6) AS level_mean FROM model LEFT JOIN u USING (kmer)")
def kept_model(spark, sf_dir):
    """New level means of a maximisation step; k-mers that were not seen keep theirs."""
    s = series(spark, sf_dir)
    p, x = F.col("posterior"), F.col("mean")
    seen = s.where("kmer is not null and event_id % 3 = 0").groupBy("kmer").agg((F.sum(p * x) / F.nullif(F.sum(p), F.lit(0.0))).alias("u"))
    return kmer_model(s).join(seen, "kmer", "left").select("kmer", r(F.when(F.col("u") > 0, F.col("u")).otherwise(F.col("level_mean"))).alias("level_mean"))


@query("state_emissions", S + "SELECT strand AS state, kmer, round(sum(posterior) / sum(sum(posterior)) OVER (PARTITION BY strand), 9) AS p FROM series WHERE kmer IS NOT NULL GROUP BY strand, kmer")
def state_emissions(spark, sf_dir):
    """Discrete emissions of each state, normalised over its symbols."""
    sums = series(spark, sf_dir).where("kmer is not null").groupBy(F.col("strand").alias("state"), "kmer").agg(F.sum("posterior").alias("s"))
    return calls.normalised(sums, "s", ["state"], "p").select("state", "kmer", r("p", 9).alias("p"))


@query("inverse_cdf", S + ", c AS (SELECT read_id, event_index, round(sum(mean) OVER (PARTITION BY read_id ORDER BY event_index) / sum(mean) OVER (PARTITION BY read_id), 9) AS cdf FROM series) SELECT read_id, u, min(event_index) AS event_index FROM c JOIN (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(u) ON cdf >= u GROUP BY ALL")
def inverse_cdf(spark, sf_dir):
    """The first event at which the running share of the level reaches each of three heights."""
    c = windows.cumulative(series(spark, sf_dir), "mean", ["event_index"], "read_id").select("read_id", "event_index", r("cdf", 9).alias("cdf"))
    each = c.withColumn("u", F.explode(F.array(*[F.lit(u) for u in (0.25, 0.5, 0.9)]))).where("cdf >= u")
    return each.groupBy("read_id", "u").agg(F.min("event_index").alias("event_index"))
