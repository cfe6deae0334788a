"""Densities on a grid: histograms, kernel estimates, moments, distances between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


MAX_DEPTH = 1000  #: of a tree of nodes
MAX_POINTS = 10_000  #: of a grid that is broadcast


def histogram(rows: DataFrame, key: str, x: str, width: float, bins: int) -> DataFrame:
    """key, grid_ix, x (bin middle), pdf: the share per unit in each of `bins` bins from 0; empty bins have 0, and values outside all bins count nowhere."""
    ix = F.floor(F.col(x) / width).cast("long")
    counts = rows.where((F.col(x) >= 0) & (F.col(x) < width * bins)).groupBy(key, ix.alias("grid_ix")).agg(F.count("*").alias("_n"))
    total = counts.groupBy(key).agg(F.sum("_n").alias("_t"))
    grid = total.select(key, "_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("grid_ix"))
    filled = grid.join(counts, [key, "grid_ix"], "left")
    return filled.select(key, "grid_ix", ((F.col("grid_ix") + 0.5) * width).alias("x"), (F.coalesce("_n", F.lit(0)) / (F.col("_t") * width)).alias("pdf"))


def pairs(density: DataFrame, key: str) -> DataFrame:
    """Both densities of every two keys a < b side by side on their grid."""
    a = density.select(F.col(key).alias("a"), "grid_ix", "x", F.col("pdf").alias("p"))
    b = density.select(F.col(key).alias("b"), "grid_ix", F.col("pdf").alias("q"))
    return a.join(b, "grid_ix").where("a < b")


def distances(both: DataFrame) -> DataFrame:
    """Symmetric Kullback-Leibler, Hellinger, L2 and Jensen-Shannon distances by the trapezoid rule.

    Terms with a density of 0 count as 0, as they do in the limit for Hellinger and Jensen-Shannon; the
    Kullback-Leibler sum leaves out points where either is 0.
    """
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    log = lambda a, b: F.ln(F.nullif(a, F.lit(0.0)) / F.nullif(b, F.lit(0.0)))
    term = {
        "kl": F.coalesce((p - q) * log(p, q), F.lit(0.0)),
        "bc": F.sqrt(p * q),
        "sq": (p - q) * (p - q),
        "js": F.coalesce(p * log(p, m), F.lit(0.0)) / 2 + F.coalesce(q * log(q, m), F.lit(0.0)) / 2,
    }
    by = Window.partitionBy("a", "b").orderBy("grid_ix")
    rows = both.select("a", "b", "grid_ix", "x", *[e.alias(n) for n, e in term.items()])
    area = rows.select("a", "b", *[((F.col(n) + F.lag(n).over(by)) / 2 * (F.col("x") - F.lag("x").over(by))).alias(n) for n in term])
    s = area.groupBy("a", "b").agg(*[F.sum(n).alias(n) for n in term])
    return s.select("a", "b", F.col("kl").alias("kl"), F.sqrt(F.greatest(1 - F.col("bc"), F.lit(0.0))).alias("hellinger"), F.sqrt("sq").alias("l2"), F.sqrt(F.greatest(F.col("js"), F.lit(0.0))).alias("jensen_shannon"))


def moments(density: DataFrame, key: str) -> DataFrame:
    """Expectation and variance by right Riemann sums."""
    by = Window.partitionBy(key).orderBy("grid_ix")
    step = density.select(key, "x", "pdf", (F.col("x") - F.lag("x").over(by)).alias("dx"))
    s = step.groupBy(key).agg(F.sum(F.col("x") * F.col("pdf") * F.col("dx")).alias("expected"), F.sum(F.col("x") * F.col("x") * F.col("pdf") * F.col("dx")).alias("_sq"))
    return s.select(key, "expected", (F.col("_sq") - F.col("expected") * F.col("expected")).alias("variance"))


def kernel_density(rows: DataFrame, key: str, x: str, grid: DataFrame, width: float) -> DataFrame:
    """Gaussian kernel estimate at the points of a small grid (grid_ix, x); equal values are counted once for each point."""
    binned = rows.groupBy(key, F.col(x).alias("_v")).agg(F.count("*").alias("_n"))
    if grid.limit(MAX_POINTS + 1).count() > MAX_POINTS:  # the grid is a parameter of the call, not data
        raise ValueError(f"more than {MAX_POINTS} grid points")
    points = F.broadcast(grid)
    z = (F.col("x") - F.col("_v")) / width
    at = binned.crossJoin(points).groupBy(key, "grid_ix", "x").agg(F.sum(F.col("_n") * F.exp(-0.5 * z * z)).alias("_s"), F.sum("_n").alias("_t"))
    return at.select(key, "grid_ix", "x", (F.col("_s") / (F.col("_t") * width * 2.5066282746310002)).alias("pdf"))


def with_fallback(density: DataFrame, tree: DataFrame) -> DataFrame:
    """node and value of each node of the tree: its own, or where it has none that of its nearest ancestor, or null without any.

    density: node, value; a null value is none. tree: node, parent, one row a node, of any depth. Each round goes up one
    level with the nodes that are still without, and is written, so a lost executor costs no more than a round.
    """
    values = density.where("value is not null").select(F.col("node").alias("_at"), "value")
    up = tree.select(F.col("node").alias("_at"), F.col("parent").alias("_up"))
    left, found = tree.select("node", F.col("node").alias("_at")), []
    while True:
        met = left.join(values, "_at", "left")
        found.append(met.where("value is not null").select("node", "value"))
        left = written(met.where("value is null").join(up, "_at").select("node", F.col("_up").alias("_at")))
        if not left.limit(1).count():
            break
        if len(found) > MAX_DEPTH:
            raise ValueError(f"a tree deeper than {MAX_DEPTH}, or one with a cycle")
    return tree.select("node").join(reduce(DataFrame.unionAll, found), "node", "left")
