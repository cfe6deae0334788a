"""Priors of the density hierarchy: normal-inverse-gamma parameters by maximum likelihood, concentrations, and trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq


def digamma(x: float) -> float:
    """Derivative of log gamma at x > 0, by recurrence up to 10 and the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_shape(gap: float) -> float:
    """The shape a of ln a - digamma(a) = gap, by Newton steps; infinite if all precisions are equal."""
    if gap <= 0:
        return math.inf
    a = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        step = (math.log(a) - digamma(a) - gap) / (1 / a - trigamma(a))
        a = a / 2 if a - step <= 0 else a - step
        if abs(step) < 1e-12 * a:
            break
    return a


def normal_gamma_mle(model: DataFrame, mean: str = "level_mean", sd: str = "level_sd") -> dict[str, float]:
    """mu, nu, alpha, beta under which the (mean, 1 / sd**2) of a model's k-mers are likeliest; two passes of sums."""
    rows = model.select(F.col(mean).alias("m"), (1 / (F.col(sd) * F.col(sd))).alias("t")).where("t > 0")
    one = rows.agg(F.count("*").alias("n"), F.sum("t").alias("t"), F.sum(F.col("t") * F.col("m")).alias("tm"), F.sum(F.ln("t")).alias("log")).first()
    if not one["n"]:
        return dict.fromkeys(("mu", "nu", "alpha", "beta"), math.nan)
    mu, mean_t = one["tm"] / one["t"], one["t"] / one["n"]
    spread = rows.agg(F.sum(F.col("t") * F.pow(F.col("m") - mu, F.lit(2.0)))).first()[0]
    alpha = gamma_shape(math.log(mean_t) - one["log"] / one["n"])
    return {"mu": mu, "nu": one["n"] / spread if spread else math.inf, "alpha": alpha, "beta": alpha / mean_t}


def concentration(rng: np.random.Generator, now: float, sizes: np.ndarray, tables: float, shape: float, rate: float) -> float:
    """A draw of a concentration given its groups' sizes and number of tables, with auxiliary beta and Bernoulli variables."""
    sizes = np.asarray(sizes, float)
    sizes = sizes[sizes > 0]
    w = rng.beta(now + 1, sizes)
    s = rng.random(len(sizes)) < sizes / (sizes + now)
    return float(rng.gamma(max(shape + tables - s.sum(), 1e-6)) / (rate - np.log(np.maximum(w, 1e-300)).sum()))


TOPOLOGIES = ("flat", "multiset", "grouped_multiset", "middle", "purines")


def tree(spark: SparkSession, alphabet: str, k: int, topology: str, groups: str | None = None) -> DataFrame:
    """node, parent of every k-mer and, for all but `flat`, of its middle nodes; the root is the empty string.

    groups has each letter's group (a digit) for grouped multisets. Purines are A and G.
    """
    leaves = spark.range(len(alphabet) ** k).select(sq.rank_kmer(F.col("id"), alphabet, k).alias("node"))
    word = F.col("node")
    if topology == "flat":
        return leaves.select("node", F.lit("").alias("parent"))
    half = (k - 1) // 2
    parent = {
        "multiset": sq.multiset(word),
        "grouped_multiset": sq.multiset(F.translate(word, alphabet, groups or alphabet)),
        "middle": sq.at(word, half, 2 - k % 2),
        "purines": (F.length(word) - F.length(F.translate(word, "AG", ""))).cast("string"),
    }[topology]
    low = leaves.select("node", F.concat(F.lit("<"), parent, F.lit(">")).alias("parent"))
    return low.unionAll(low.select(F.col("parent").alias("node"), F.lit("").alias("parent")).distinct())
