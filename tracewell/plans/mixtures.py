"""Registered queries of the density mixture and of trees of k-mers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import splines
from ..operators import hdp, hmm, kmeans, metrics, training
from ..sources.shared import written
from .posteriors import STATES, hmm_blocks, parts, shown
from .projection import SERIES, kmer_model, series, with_sql
from .registry import query

S = with_sql(SERIES)
GAMMA, ALPHA, BINS = 2.0, 4.0, 8


def kmer_tree(s: DataFrame) -> DataFrame:
    """Every k-mer under its first base, and these under the root."""
    kmers = s.where("kmer is not null").select(F.col("kmer").alias("node"), F.substring("kmer", 1, 1).alias("parent")).distinct()
    return kmers.unionAll(kmers.select(F.col("parent").alias("node"), F.lit("").alias("parent")).distinct())


def binned(s: DataFrame) -> DataFrame:
    return s.where("kmer is not null and mean is not null").groupBy(F.col("kmer").alias("node"), F.least(F.floor(F.col("mean") / 40), F.lit(BINS - 1)).cast("int").alias("z")).agg(F.count("*").alias("n"))


@query("predictive_weights", S + f"""
, leaf AS (SELECT kmer AS node, least(CAST(floor(mean / 40) AS BIGINT), {BINS - 1}) AS z, count(*) AS c FROM series WHERE kmer IS NOT NULL AND mean IS NOT NULL GROUP BY ALL),
middle AS (SELECT substr(node, 1, 1) AS node, z, count(*) AS c FROM leaf GROUP BY ALL),
top AS (SELECT z, count(*) AS c FROM middle GROUP BY z),
bins AS (SELECT unnest(range(0, {BINS + 1})) AS z),
root AS (SELECT b.z, CASE WHEN b.z < {BINS} THEN coalesce(c, 0) ELSE {GAMMA} END / ({GAMMA} + (SELECT sum(c) FROM top)) AS w FROM bins b LEFT JOIN top USING (z)),
inner_w AS (SELECT m.node, r.z, (coalesce(c.c, 0) + {ALPHA} * r.w) / ({ALPHA} + m.n) AS w FROM (SELECT node, sum(c) AS n FROM middle GROUP BY node) m, root r LEFT JOIN middle c ON c.node = m.node AND c.z = r.z),
leaf_w AS (SELECT m.node, r.z, (coalesce(c.c, 0) + {ALPHA} * r.w) / ({ALPHA} + m.n) AS w FROM (SELECT node, sum(c) AS n FROM leaf GROUP BY node) m JOIN inner_w r ON r.node = substr(m.node, 1, 1) LEFT JOIN leaf c ON c.node = m.node AND c.z = r.z)
SELECT node, CAST(z AS INTEGER) AS z, round(w, 9) AS weight FROM (SELECT '' AS node, z, w FROM root UNION ALL SELECT node, z, w FROM inner_w UNION ALL SELECT node, z, w FROM leaf_w)""")
def predictive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of bins of levels at every node of the k-mer tree, where each bin that a child has is one table at its parent."""
    s = series(spark, sf_dir)
    tree = hdp.Tree.read(kmer_tree(s))
    at = {x: i for i, x in enumerate(tree.nodes)}
    counts = np.zeros((len(tree.nodes), BINS), np.int64)
    for r in binned(s).collect():  # nodes times bins
        counts[at[r["node"]], r["z"]] = r["n"]
    for level in reversed(list(tree.levels())):
        np.add.at(counts, tree.parent[level], counts[level] > 0)
    weights = hdp.push_down(tree, counts, [GAMMA, ALPHA, ALPHA])
    rows = [(x, z, float(w)) for x, row in zip(tree.nodes, weights, strict=True) for z, w in enumerate(row)]
    return spark.createDataFrame(rows, "node string, z int, weight double").withColumn("weight", F.round("weight", 9))


@query("observed_nodes", S + f"""
, leaf AS (SELECT DISTINCT kmer AS node FROM series WHERE kmer IS NOT NULL AND mean >= 200), known AS (SELECT DISTINCT kmer AS node FROM series WHERE kmer IS NOT NULL)
SELECT node, node IN (SELECT node FROM leaf) AS observed FROM known UNION ALL SELECT DISTINCT substr(node, 1, 1), substr(node, 1, 1) IN (SELECT substr(node, 1, 1) FROM leaf) FROM known UNION ALL SELECT '', count(*) > 0 FROM leaf""")
def observed_nodes(spark, sf_dir):
    """Nodes of the k-mer tree that have measurements of 200 or more, or have a node below that does."""
    s = series(spark, sf_dir)
    tree = hdp.Tree.read(kmer_tree(s))
    own = {r["kmer"] for r in s.where("kmer is not null and mean >= 200").select("kmer").distinct().collect()}  # k-mers
    seen = tree.observed(np.array([[x in own] for x in tree.nodes], int))
    return spark.createDataFrame([(x, bool(o)) for x, o in zip(tree.nodes, seen, strict=True)], "node string, observed boolean")


@query("nearest_density", S + """
, known AS (SELECT DISTINCT kmer FROM series WHERE kmer IS NOT NULL),
node AS (SELECT kmer AS node, substr(kmer, 1, 2) AS parent FROM known UNION SELECT substr(kmer, 1, 2), substr(kmer, 1, 1) FROM known UNION SELECT substr(kmer, 1, 1), '' FROM known),
v AS (SELECT kmer AS node, count(*) AS n, round(avg(mean), 6) AS value FROM series WHERE kmer IS NOT NULL GROUP BY kmer HAVING count(*) % 3 = 0 UNION ALL SELECT substr(kmer, 1, 1), 0, round(avg(mean), 6) FROM series WHERE kmer IS NOT NULL GROUP BY 2, substr(kmer, 1, 1) HAVING count(*) % 2 = 0)
SELECT n.node, coalesce(a.value, b.value, c.value) AS value FROM node n LEFT JOIN v a ON a.node = n.node LEFT JOIN v b ON b.node = n.parent LEFT JOIN v c ON length(n.node) = 3 AND c.node = substr(n.node, 1, 1)""".replace("GROUP BY 2, substr(kmer, 1, 1)", "GROUP BY substr(kmer, 1, 1)"))
def nearest_density(spark, sf_dir):
    """The value of each node of a tree of three levels, or of its nearest ancestor with one."""
    s = series(spark, sf_dir).where("kmer is not null")
    cut = lambda n: F.substring("kmer", 1, n)
    tree = s.select(F.col("kmer").alias("node"), cut(2).alias("parent")).union(s.select(cut(2), cut(1))).union(s.select(cut(1), F.lit(""))).distinct()
    mean = lambda key, m: s.groupBy(key.alias("node")).agg(F.round(F.avg("mean"), 6).alias("value"), F.count("*").alias("n")).where(F.col("n") % m == 0).select("node", "value")
    return metrics.with_fallback(mean(F.col("kmer"), 3).unionAll(mean(cut(1), 2)), tree)


def mixture_rows(s: DataFrame) -> DataFrame:
    return s.where("kmer is not null").select(F.col("kmer").alias("group"), F.col("event_id").alias("id"), F.col("mean").alias("x"))


@query("hdp_density")
def hdp_density(spark, sf_dir):
    """Densities of the bases under one root; no SQL, tested by its moments and by known mixtures."""
    rows = series(spark, sf_dir).select(F.col("base").alias("group"), F.col("event_id").alias("id"), F.col("mean").alias("x"))
    return hdp.densities(spark, *hdp.sample(rows, components=8, iterations=15, burn_in=5, thin=5), 0.0, 500.0, 101).where("group <> ''")


@query("tree_density")
def tree_density(spark, sf_dir):
    """Densities of all nodes of the k-mer tree, from starts by k-means; no SQL."""
    s = series(spark, sf_dir)
    tree, kept = hdp.sample(mixture_rows(s), kmer_tree(s), components=8, iterations=12, burn_in=4, thin=4, start="kmeans", concentrations=(1.0, 1.0))
    return hdp.densities(spark, tree, kept, 0.0, 500.0, 101)


@query("kmeans_centres")
def kmeans_centres(spark, sf_dir):
    """Centres of all levels and the objective; no SQL, tested against exhaustive cuts."""
    centres, cost = kmeans.kmeans(series(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("mean").alias("x")), 8)
    return spark.createDataFrame([(i, float(c), cost) for i, c in enumerate(centres)], "centre int, x double, objective double")


def normal_knots(m: DataFrame, low: float, high: float, points: int) -> DataFrame:
    """The model's normals at the points of a grid, with slopes."""
    step = (high - low) / (points - 1)
    at = m.select(F.col("kmer").alias("node"), "level_mean", "level_sd", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("grid_ix")).withColumn("x", low + F.col("grid_ix") * step)
    z = (F.col("x") - F.col("level_mean")) / F.col("level_sd")
    return splines.with_slopes(at.select("node", "grid_ix", "x", (F.exp(-0.5 * z * z) / (F.col("level_sd") * 2.5066282746310002)).alias("pdf")))


@query("density_posteriors")
def density_posteriors(spark, sf_dir):
    """Pairs from one percent on with tabulated densities as emissions; no SQL, tested to equal the normals' where both are one."""
    s = series(spark, sf_dir)
    return shown(hmm.posteriors(hmm_blocks(spark, sf_dir), hmm.tabulated_emission(normal_knots(kmer_model(s), 0.0, 1000.0, 501)), width=20))


@query("mixture_training")
def mixture_training(spark, sf_dir):
    """Transitions and log-likelihood after two rounds of alignment and sampling; no SQL."""
    s = series(spark, sf_dir)
    rows = written(hmm_blocks(spark, sf_dir))
    trans, _, history = training.train(rows, written(parts(s)[1]), kmer_model(s), kmer_tree(s), training.Grid(0.0, 1000.0, 251), 2, width=20, components=8, iterations=6, burn_in=3, thin=2)
    return spark.createDataFrame([(a, b, float(trans[i, j]), history[-1]) for i, a in enumerate(STATES) for j, b in enumerate(STATES)], "from_state string, to_state string, p double, log_likelihood double")
