"""Priors, splines, trees and streams against closed forms, brute force and batch results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import splines
from tracewell.operators import calls, hdp, priors, windows
from tracewell.streaming import site_sums as streams


def likelihood(p, mu, tau):
    a, b = p["alpha"], p["beta"]
    normal = 0.5 * np.log(p["nu"] * tau / (2 * math.pi)) - 0.5 * p["nu"] * tau * (mu - p["mu"]) ** 2
    return float((normal + a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(tau) - b * tau).sum())


def test_polygamma():
    assert priors.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert priors.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    for x in (0.3, 2.5, 40.0):
        assert priors.digamma(x + 1) - priors.digamma(x) == pytest.approx(1 / x, abs=1e-9)
        assert (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5 == pytest.approx(priors.digamma(x), abs=1e-5)


def test_normal_gamma_is_the_maximum(spark):
    mu, tau = np.array([-20.1, 2.8, -11.7, -39.3, -0.4]), np.array([0.01, 0.005, 0.0023, 0.013, 0.008])
    model = spark.createDataFrame([(float(m), float(t**-0.5)) for m, t in zip(mu, tau, strict=True)], "level_mean double, level_sd double")
    best = priors.normal_gamma_mle(model)
    top = likelihood(best, mu, tau)
    for name in best:
        for factor in (0.5, 0.9, 0.99, 1.01, 1.1, 2.0):
            assert likelihood(best | {name: best[name] * factor}, mu, tau) <= top + 1e-9
    assert all(math.isnan(v) for v in priors.normal_gamma_mle(model.where("false")).values())


def test_concentration_follows_the_number_of_tables():
    rng = np.random.default_rng(3)
    draw = lambda tables: np.mean([priors.concentration(rng, 2.0, np.full(10, 100), tables, 1.0, 1.0) for _ in range(300)])
    assert draw(15) < draw(60) < draw(200)


def test_trees(spark):
    for name in priors.TOPOLOGIES:
        rows = priors.tree(spark, "ACEGT", 3, name, "01102").collect()
        parent = {r["node"]: r["parent"] for r in rows}
        leaves = [n for n in parent if n and not n.startswith("<")]
        assert len(rows) == len(parent) and len(leaves) == 125
        assert all(parent[n] == "" or parent[parent[n]] == "" for n in leaves)
    middle = {r["node"]: r["parent"] for r in priors.tree(spark, "ACGT", 6, "middle").collect()}
    assert middle["AACGTT"] == "<CG>"


def test_splines(spark):
    x = np.arange(12) * 0.5 + 3
    assert np.allclose(splines.slopes(x, 2 * x + 1), 2)
    y = np.exp(-((x - 5) ** 2))
    d = spark.createDataFrame([("a", i, float(x[i]), float(y[i])) for i in range(12)], "node string, grid_ix long, x double, pdf double")
    knots = splines.with_slopes(d)
    at = spark.createDataFrame([("a", float(v)) for v in (*x, 4.26, 1.0, 50.0)] + [("none", 4.0), ("a", None)], "node string, x double")
    got = {(r["node"], r["x"]): r["density"] for r in splines.evaluate(at, knots, 3.0, 0.5, 12).collect()}
    for v, want in zip(x, y, strict=True):
        assert got["a", float(v)] == pytest.approx(want, abs=1e-12)
    assert got["a", 4.26] == pytest.approx(math.exp(-(0.74**2)), abs=5e-3)
    assert got["a", 1.0] == 0.0 and got["a", 50.0] is not None and got["none", 4.0] is None and got["a", None] is None
    s = splines.slopes(x, y)  # second derivatives agree at inner knots
    h = 0.5
    left = (2 * s[:-2] + 4 * s[1:-1]) / h - 6 * (y[1:-1] - y[:-2]) / h**2
    right = -(4 * s[1:-1] + 2 * s[2:]) / h + 6 * (y[2:] - y[1:-1]) / h**2
    assert np.allclose(left, right)


def test_assemble_and_column_pairs(spark):
    e = spark.createDataFrame([("r", 0, "ACG"), ("r", 1, "ACG"), ("r", 2, "CGT"), ("r", 4, "TAA"), ("r", 5, "GGG")], "read_id string, event_index int, kmer string")
    assert windows.assemble(e, 3).first()["sequence"] == "ACGTAAGGG"
    c = spark.createDataFrame([(1, "A"), (1, "A"), (1, "C"), (2, "C"), (2, "C"), (2, "C")], "ref_pos int, base string")
    assert {(r["a"], r["b"], r["pairs"]) for r in calls.column_pairs(c, "ref_pos").collect()} == {("A", "A", 1), ("A", "C", 2), ("C", "C", 3)}


@pytest.mark.parametrize(("n", "a"), [(1, 2.0), (7, 0.3), (400, 3.0), (50, 40.0)])
def test_tables_are_distributed_as_drawn_one_by_one(n, a):
    rng = np.random.default_rng(5)
    p = a / (a + np.arange(n))
    got = np.array([hdp.tables_of(rng, n, a) for _ in range(4000)])
    assert got.min() >= 1 and got.max() <= n
    assert abs(got.mean() - p.sum()) < 5 * np.sqrt((p * (1 - p)).sum() / 4000) + 1e-9
    assert abs(got.var() - (p * (1 - p)).sum()) < 0.15 * (p * (1 - p)).sum() + 1e-9


def test_tables_of_very_many_measurements():
    rng = np.random.default_rng(6)
    got = np.array([hdp.tables_of(rng, 10**12, 2.0) for _ in range(500)])
    mean = 2.0 * (np.log(1e12) - 0.42278433509846714)  # digamma(2)
    assert abs(got.mean() - mean) < 5 * np.sqrt(mean / 500)
    assert hdp.tables_of(rng, 10**6, 0.0) == 1


def test_mixture_with_drawn_concentrations(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("group"), "id", (F.col("id") % 2 * 50 + F.col("id") % 5).cast("double").alias("x"))
    found = hdp.sample(rows, components=4, iterations=6, burn_in=3, thin=2, concentrations=(1.0, 1.0))
    d = hdp.densities(spark, *found, -20.0, 80.0, 101).groupBy("group").agg(F.max_by("x", "pdf").alias("top")).collect()
    top = {r["group"]: r["top"] for r in d}
    assert abs(top["a"] - 2) < 5 and abs(top["b"] - 52) < 5


def test_streamed_sums_equal_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("ref_pos"), F.when(F.col("id") % 2 == 0, "t").otherwise("c").alias("strand"), F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("base"), (F.col("id") % 10 / 10).alias("posterior"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = streams.site_sums(stream, "AC").writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda t: sorted((r["ref_pos"], r["strand"], r["depth"], round(r["sA"], 6), round(r["sC"], 6)) for r in t.collect())
    assert key(spark.table("sums")) == key(streams.site_sums(rows, "AC"))


def test_windows_close_once_and_late_rows_go(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "ts string, base string").select(F.to_timestamp("ts").alias("ts"), "base").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run():
        stream = spark.readStream.schema("ts timestamp, base string").parquet(f"{tmp_path}/in")
        streams.run_available(streams.windowed_depth(stream, "ts", "1 minute", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((str(r["start"]), r["base"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put("in", [("2024-01-01 00:01:00", "A"), ("2024-01-01 00:02:00", "A"), ("2024-01-01 00:30:00", "C")])
    assert run() == [("2024-01-01 00:00:00", "A", 2)]
    put("in", [("2024-01-01 00:03:00", "A"), ("2024-01-01 01:00:00", "G")])  # the first is too late
    assert run() == [("2024-01-01 00:00:00", "A", 2), ("2024-01-01 00:30:00", "C", 1)]
