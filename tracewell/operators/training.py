"""Training of the pair HMM with a mixture of densities as its emissions, in rounds of alignment and sampling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splines
from ..sources.shared import written
from . import hdp, hmm


def assignments(pairs: DataFrame, events: DataFrame, threshold: float) -> DataFrame:
    """group, id and x: the k-mers of matches that reach the threshold with their events' levels. pairs: read_id, x, y, kmer, p; events: read_id, y, mean.

    An event that matches several k-mers belongs to each; ids are of event and k-mer, so that draws do not depend on the partitions.
    """
    near = pairs.where((F.col("p") >= threshold) & F.col("kmer").isNotNull()).join(events.where("mean is not null"), ["read_id", "y"])
    return near.select(F.col("kmer").alias("group"), F.xxhash64("read_id", "y", "x", "kmer").alias("id"), F.col("mean").alias("x"))


def transitions_of(sums: DataFrame, before: np.ndarray) -> np.ndarray:
    """Expected transitions as probabilities by row; a state that nothing leaves keeps its own."""
    counts = np.zeros((3, 3))
    for r in sums.where("kind = 't'").collect():  # nine rows
        counts[int(r["key"][0]), int(r["key"][1])] = r["p"]
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), before)


@dataclass
class Grid:
    """Where densities are tabulated."""

    low: float
    high: float
    points: int


def emission_of(spark, tree: hdp.Tree, kept: list[hdp.Sample], grid: Grid) -> hmm.Tabulated:
    return hmm.tabulated_emission(splines.with_slopes(hdp.densities(spark, tree, kept, grid.low, grid.high, grid.points), "group"), key="group")


def train(blocks: DataFrame, events: DataFrame, model: DataFrame, tree: DataFrame, grid: Grid, rounds: int, width: int | None = None, threshold: float = 0.5, **sampling) -> tuple[np.ndarray, hmm.Tabulated, list[float]]:
    """Transitions, emissions and the log-likelihood before each round.

    The first round aligns with the model's normals, every further one with the densities sampled in the round before.
    A round expects transitions under its emissions, assigns events to k-mers by matches from the threshold on and
    samples the mixture on the tree anew (reset assignments). Give blocks and events that are written.
    """
    spark, emission, trans, history = blocks.sparkSession, hmm.gaussian_emission(model), hmm.TRANSITIONS, []
    for _ in range(rounds):
        sums = written(hmm.expectations(blocks, emission, trans, width))
        history.append(float(sums.where("kind = 'z'").agg(F.sum("px")).first()[0] or 0.0))
        rows = assignments(hmm.posteriors(blocks, emission, threshold, width, trans), events, threshold)
        trans = transitions_of(sums, trans)
        emission = emission_of(spark, *hdp.sample(rows, tree, **sampling), grid)
    return trans, emission, history
