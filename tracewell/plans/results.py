"""Registered queries on the pair HMM's output: result tables, calls, chains and columns, and corrections by reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import anchors, calls, consistency, correction, hmm, outputs
from ..sources import model_files
from ..sources.shared import shared_folder, written
from .posteriors import PAIRS, emission, hmm_blocks, hmm_sql, parts, shown
from .projection import SEQUENCES, SERIES, K, kmer_model, sequences, series, with_sql
from .registry import query


def r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def reads_of(s: DataFrame) -> DataFrame:
    """Each read against its own sequence, with its calibration: scale and shift to the levels of all reads, and its noise."""
    everything = s.agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("d"))
    own = s.groupBy("read_id").agg(F.avg("mean").alias("om"), F.stddev_pop("mean").alias("od"), F.sqrt(F.avg("stdv")).alias("scale_sd"))
    scale = F.col("od") / F.col("d")
    fitted = own.crossJoin(F.broadcast(everything)).select("read_id", scale.alias("scale"), (F.col("om") - scale * F.col("m")).alias("shift"), "scale_sd")  # one row is broadcast
    strand = F.when(F.col("read_id") % 3 == 0, "c").otherwise("t").alias("strand")
    return fitted.join(sequences(s), "read_id").select(
        "read_id", F.concat(F.lit("r"), "read_id").alias("label"), F.lit("ref").alias("contig"), strand, (F.col("read_id") % 2 == 0).alias("forward"), F.col("sequence").alias("target"),
        (F.col("read_id") * 10).alias("ref_offset"), (F.col("read_id") % 4).alias("first_event"), "scale", "shift", (1 + (F.col("read_id") % 5) / 10).alias("var"), "scale_sd",
    )


READS = f""", {SEQUENCES},
every AS (SELECT avg(mean) AS m, stddev_pop(mean) AS d FROM series),
own AS (SELECT read_id, stddev_pop(mean) / d AS scale, avg(mean) - stddev_pop(mean) / d * m AS shift, sqrt(avg(stdv)) AS scale_sd FROM series, every GROUP BY read_id, m, d),
rd AS (SELECT read_id, scale, shift, scale_sd, sequence AS target, CASE WHEN read_id % 3 = 0 THEN 'c' ELSE 't' END AS strand, read_id % 2 = 0 AS forward, 1 + (read_id % 5) / 10.0 AS var, (CASE WHEN read_id % 3 = 0 THEN 'c' ELSE 't' END = 't') = (read_id % 2 = 0) AS along FROM own JOIN seqs USING (read_id)),
pairs AS ({PAIRS}),
full_rows AS (
  SELECT p.read_id, CASE WHEN along THEN x + p.read_id * 10 ELSE (length(target) - 3) - (x + (length(target) - p.read_id * 10)) END AS ref_pos, substr(target, CAST(x AS BIGINT) + 1, 3) AS target_kmer, along, 'r' || p.read_id AS read, rd.strand, rd.forward,
    y + p.read_id % 4 AS event_ix, e.mean AS ev_mean, e.stdv AS ev_noise, e.duration AS ev_duration, level_mean * scale + shift AS scaled_mean, noise_mean * scale_sd AS scaled_noise, p, (e.mean + var * level_mean - scale * level_mean - shift) / var AS descaled_mean, level_mean, p.kmer AS path_kmer
  FROM pairs p JOIN rd ON rd.read_id = p.read_id JOIN series e ON e.read_id = p.read_id AND e.event_index = p.y JOIN model m ON m.kmer = p.kmer)
"""


def aligned(spark: SparkSession, sf_dir: str):
    """What `outputs.full` takes, from the banded alignment of all reads."""
    s = series(spark, sf_dir)
    pairs = shown(hmm.posteriors(hmm_blocks(spark, sf_dir), emission(spark, sf_dir), width=20))
    return pairs, s.select("read_id", F.col("event_index").alias("y"), "mean", "stdv", "duration"), reads_of(s), kmer_model(s), K


@query("aligned_full", hmm_sql(20, READS + """SELECT 'ref' AS contig, CAST(ref_pos AS BIGINT) AS ref_pos, CASE WHEN along THEN target_kmer ELSE reverse(translate(target_kmer, 'ACGTE', 'TGCAG')) END AS ref_kmer, read, strand, event_ix, round(ev_mean, 6) AS ev_mean, round(ev_noise, 6) AS ev_noise, round(ev_duration, 6) AS ev_duration,
  target_kmer, round(scaled_mean, 6) AS scaled_mean, round(scaled_noise, 6) AS scaled_noise, p AS posterior, round(descaled_mean, 6) AS descaled_mean, round(level_mean, 6) AS model_mean, path_kmer FROM full_rows"""))
def aligned_full(spark, sf_dir):
    """The full table of the banded alignment, each read with its own parameters."""
    rows = outputs.result_table("full", *aligned(spark, sf_dir))
    return rows.select("contig", "ref_pos", "ref_kmer", "read", "strand", "event_ix", *[r(c) for c in ("ev_mean", "ev_noise", "ev_duration")], "target_kmer", *[r(c) for c in ("scaled_mean", "scaled_noise")], "posterior", *[r(c) for c in ("descaled_mean", "model_mean")], "path_kmer")


@query("aligned_assignments", hmm_sql(20, READS + "SELECT path_kmer AS kmer, strand, round(descaled_mean, 6) AS descaled_mean, p AS posterior FROM full_rows"))
def aligned_assignments(spark, sf_dir):
    return outputs.result_table("assignments", *aligned(spark, sf_dir)).select("kmer", "strand", r("descaled_mean"), "posterior")


LETTERS = "ACEGT"
SHARES = ", ".join(f"coalesce(sum(p) FILTER (base = '{b}'), 0) / sum(p) AS p{b}" for b in LETTERS)


@query("aligned_marginals", hmm_sql(20, READS + f", b AS (SELECT ref_pos, strand, forward, p, substr(path_kmer, 1, 1) AS base FROM full_rows) SELECT CAST(ref_pos AS BIGINT) AS ref_pos, strand, forward, {', '.join(f'round(p{x}, 6) AS p{x}' for x in LETTERS)} FROM (SELECT ref_pos, strand, forward, {SHARES} FROM b GROUP BY ALL)"))
def aligned_marginals(spark, sf_dir):
    """The share of each letter at each place, by strand and direction, from the alignment's posteriors."""
    rows = outputs.full(*aligned(spark, sf_dir)).withColumn("base", F.substring("path_kmer", 1, 1))
    return calls.site_marginals(rows, LETTERS, ["ref_pos", "strand", "forward"]).select("ref_pos", "strand", "forward", *[r(f"p{b}") for b in LETTERS])


@query("called_cytosines")
def called_cytosines(spark, sf_dir):
    """Calls of C or E across reads from alignments to references whose cytosines are open; no SQL, its parts have theirs."""
    s = series(spark, sf_dir)
    pairs = hmm.posteriors(hmm_blocks(spark, sf_dir, ambiguous=True), emission(spark, sf_dir), width=12)
    events = s.select("read_id", F.col("event_index").alias("y"), "mean", "stdv", "duration")
    reads = reads_of(s).withColumn("target", F.translate("target", "CE", "XX"))
    rows = outputs.full(pairs, events, reads, kmer_model(s), K).where("forward and strand = 't'")
    sites = outputs.formats.variant_rows(rows).withColumn("forward", F.col("direction") == "forward")
    shares = calls.site_marginals(sites, LETTERS, ["ref_pos", "strand", "forward", "read"])
    return calls.consensus(shares, LETTERS).select("ref_pos", "depth", r("pC"), r("pE"), "call")


@query("heaviest_chains")
def heaviest_chains(spark, sf_dir):
    """Each read's heaviest chain of pairs of reference places and events; no SQL, tested by brute force."""
    s = series(spark, sf_dir).where("posterior is not null")
    pairs = s.select("read_id", F.col("ref_pos").alias("x"), F.col("event_index").alias("y"), F.col("posterior").alias("p"))
    return consistency.heaviest_chains(pairs).select("read_id", "x", "y", r("p"))


@query("merged_columns")
def merged_columns(spark, sf_dir):
    """Columns of reads in sets of ten, merged from the k-mers that neighbours in a set share; no SQL, tested by hand."""
    s = sequences(series(spark, sf_dir))
    own = s.select((F.col("read_id") / 10).cast("long").alias("contig"), F.col("read_id").alias("sequence"), F.length("sequence").cast("long").alias("length"))
    each = s.select("read_id", F.posexplode(sq.kmers(F.col("sequence"), 4)).alias("p", "kmer")).groupBy("read_id", "kmer").agg(F.min("p").cast("long").alias("p"), F.count("*").alias("n")).where("n = 1")
    after = each.select((F.col("read_id") - 1).alias("s"), F.col("read_id").alias("t"), "kmer", F.col("p").alias("y"))
    shared = each.select(F.col("read_id").alias("s"), "kmer", F.col("p").alias("x")).join(after, ["s", "kmer"]).where((F.col("s") / 10).cast("long") == (F.col("t") / 10).cast("long"))
    near = shared.select((F.col("s") / 10).cast("long").alias("contig"), "s", "x", "t", "y", (1 / (1 + F.abs(F.col("x") - F.col("y")))).alias("w"))
    return consistency.columns(own, near, 0.05)


def sequence_classes(s: DataFrame) -> DataFrame:
    """id, side (parity of the id), sequence and class of every read: the least id of those of its side with its sequence."""
    own = s.where("read_id is not null").select(F.col("read_id").alias("id"), F.pmod("read_id", F.lit(2)).alias("side"), "sequence")
    least = own.groupBy("side", "sequence").agg(F.min("id").alias("class"))
    return own.join(least, ["side", "sequence"]).select("id", "side", "sequence", "class")


@query("recursive_anchors")
def recursive_anchors(spark, sf_dir):
    """Anchors between reads of even and odd ids by 8-, 6- and 4-mers, the shorter ones in gaps only; no SQL, tested by hand.

    Rows 'anchor' are between the least ids of equal sequences; a row 'copy' says that id_b has the sequence of id_a, of
    its own side, and so its anchors. Work and rows grow with the links between different sequences.
    """
    reads = written(sequence_classes(sequences(series(spark, sf_dir))))
    side = lambda i: reads.where((F.col("side") == i) & (F.col("id") == F.col("class"))).select("id", "sequence")
    found = anchors.recursive_seeds(side(0), side(1), [8, 6, 4], 100).select("id_a", "id_b", "x", "y", F.lit("anchor").alias("role"))
    none = F.lit(None).cast("long")
    copies = reads.where("id <> class").select(F.col("class").alias("id_a"), F.col("id").alias("id_b"), none.alias("x"), none.alias("y"), F.lit("copy").alias("role"))
    return found.unionByName(copies)


@query("corrected_by_reads")
def corrected_by_reads(spark, sf_dir):
    """Every read's sequence, each 17th base replaced, corrected by the read's own events in cycles; no SQL, tested on planted changes."""
    s = series(spark, sf_dir).where("base is not null")
    kmers, events, marks = parts(series(spark, sf_dir))
    wrong = F.when(F.col("event_index") % 17 == 9, F.translate("base", "ACGTE", "CATGA")).otherwise(F.col("base"))
    reference = s.select(F.col("read_id").alias("contig"), F.col("event_index").alias("pos"), wrong.alias("base"))
    reads = kmers.groupBy("read_id").agg((F.max("x") + K).alias("end")).select("read_id", F.col("read_id").alias("contig"), F.lit(0).cast("long").alias("start"), "end")
    fixed, _ = correction.correct(reference, reads, events, marks, emission(spark, sf_dir), K, "ACEGT", steps=(6, 5), width=12)
    return fixed


@query("expectation_files", hmm_sql(20, f"""
, post AS ({PAIRS}), sums AS (SELECT p.kmer, sum(p.p7 / 1e7) AS p, sum(p.p7 / 1e7 * e.mean) AS px, sum(p.p7 / 1e7 * e.mean * e.mean) AS pxx FROM post p JOIN series e ON e.read_id = p.read_id AND e.event_index = p.y GROUP BY p.kmer),
ab AS (SELECT unnest(['A', 'C', 'E', 'G', 'T']) AS c, unnest(range(5)) AS n), word AS (SELECT a.c || b.c || d.c AS kmer, 25 * a.n + 5 * b.n + d.n AS id FROM ab a, ab b, ab d),
w AS (SELECT w.id, w.kmer, coalesce(p, 0) AS p, coalesce(px, 0) AS px, coalesce(pxx, 0) AS pxx, coalesce(level_mean, 0) AS m0, coalesce(level_sd, 0) AS m1, coalesce(noise_mean, 0) AS m2, coalesce(noise_sd, 0) AS m3, coalesce(noise_lambda, 0) AS m4 FROM word w LEFT JOIN sums s ON s.kmer = w.kmer LEFT JOIN model m ON m.kmer = w.kmer)
SELECT item, CAST(i AS BIGINT) AS i, kmer, CASE WHEN item = 'model' THEN round(value, 8) ELSE round(value, 3) END AS value FROM (
  SELECT 'model' AS item, 5 * id + unnest(range(5)) AS i, kmer, unnest([m0, m1, m2, m3, m4]) AS value FROM w UNION ALL SELECT 'expectation', 2 * id + unnest(range(2)), kmer, unnest([px, pxx]) FROM w
  UNION ALL SELECT 'posterior', id, kmer, p FROM w UNION ALL SELECT 'observed', id, kmer, CASE WHEN p > 0 THEN 1 ELSE 0 END FROM w)""".replace("round(floor", "round(floor").replace("/ 1000) / 1e4 AS p", "/ 1000) / 1e4 AS p, floor(least(f.m * g.m / z, 1) * 1e7) AS p7")))
def expectation_files(spark, sf_dir):
    """The k-mer items of an expectation file that is written from the alignment of all reads and read again."""
    sums = written(hmm.expectations(hmm_blocks(spark, sf_dir), emission(spark, sf_dir), hmm.TRANSITIONS, width=20))  # read once for each item
    model = written(kmer_model(series(spark, sf_dir)).drop("n"))
    path = shared_folder(spark)
    model_files.write_expectations(model_files.of_sums(sums, model, "all.expectations", LETTERS, K), path, LETTERS, K)
    rows = model_files.expectations(spark, path).where("kmer is not null")
    return rows.select("item", "i", "kmer", F.when(F.col("item") == "model", F.round("value", 8)).otherwise(F.round("value", 3)).alias("value"))


@query("kmer_value_files", with_sql(SERIES) + "SELECT kmer, mean AS value FROM series WHERE kmer IS NOT NULL AND mean > 0 AND mean < 100")
def kmer_value_files(spark, sf_dir):
    """Levels from 0 to 100 of every k-mer, from files of one k-mer each."""
    path = shared_folder(spark)
    model_files.write_kmer_values(series(spark, sf_dir).select("kmer", F.col("mean").alias("value")), path)
    return model_files.kmer_values(spark, path)
