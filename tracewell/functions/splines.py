"""Natural cubic splines of tabulated densities: knot slopes per group, evaluation by a join with the two knots around x."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """First derivatives at the knots of the spline whose second derivative is 0 at both ends."""
    n = len(x)
    if n < 2:
        return np.zeros(n)
    h, rise = np.diff(x), np.diff(y) / np.diff(x)
    if n == 2:
        return np.array([rise[0], rise[0]])
    below, above = np.r_[1 / h], np.r_[1 / h]
    middle = 2 * (np.r_[1 / h, 0] + np.r_[0, 1 / h])
    right = 3 * (np.r_[rise / h, 0] + np.r_[0, rise / h])
    for i in range(1, n):  # elimination down the three diagonals
        f = below[i - 1] / middle[i - 1]
        middle[i] -= f * above[i - 1]
        right[i] -= f * right[i - 1]
    out = np.empty(n)
    out[-1] = right[-1] / middle[-1]
    for i in range(n - 2, -1, -1):
        out[i] = (right[i] - above[i] * out[i + 1]) / middle[i]
    return out


def cubic(v: np.ndarray, low: float, step: float, pdf: np.ndarray, slope: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Values at v of the splines in `row` of tables [spline, knot] on one even grid; straight lines beyond its ends, never below 0."""
    i = np.clip(np.floor((v - low) / step), 0, pdf.shape[1] - 2).astype(np.int64)
    t = (v - low) / step - i
    p, q, s, e = pdf[row, i], pdf[row, i + 1], slope[row, i] * step, slope[row, i + 1] * step
    inside = p * (1 + 2 * t) * (1 - t) * (1 - t) + s * t * (1 - t) * (1 - t) + q * t * t * (3 - 2 * t) + e * t * t * (t - 1)
    return np.maximum(np.where(t < 0, p + s * t, np.where(t > 1, q + e * (t - 1), inside)), 0.0)


def with_slopes(density: DataFrame, key: str = "node") -> DataFrame:
    """Adds `slope` to key, grid_ix, x, pdf. A group is one grid, whose size the caller chooses."""

    def one(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("grid_ix")
        return t.assign(slope=slopes(t["x"].to_numpy(float), t["pdf"].to_numpy(float)))

    rows = density.select(key, "grid_ix", "x", "pdf")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(one, f"{key} {kind}, grid_ix long, x double, pdf double, slope double")


def evaluate(rows: DataFrame, knots: DataFrame, low: float, step: float, points: int, key: str = "node", x: str = "x") -> DataFrame:
    """Adds `density` to rows (key and a value) on an evenly spaced grid: cubic between knots, straight lines beyond the ends, never below 0; null without value or knots."""
    v = F.col(x)
    ix = F.greatest(F.least(F.floor((v - low) / step), F.lit(points - 2)), F.lit(0)).cast("long")
    a = knots.select(key, F.col("grid_ix").alias("_i"), F.col("x").alias("_x"), F.col("pdf").alias("_p"), F.col("slope").alias("_s"))
    b = knots.select(key, (F.col("grid_ix") - 1).alias("_i"), F.col("pdf").alias("_q"), F.col("slope").alias("_t"))
    both = a.join(b, [key, "_i"])
    at = rows.withColumn("_i", ix).join(both, [key, "_i"], "left")
    t = (v - F.col("_x")) / step
    p, q, s, e = F.col("_p"), F.col("_q"), F.col("_s") * step, F.col("_t") * step
    cubic = p * (1 + 2 * t) * (1 - t) * (1 - t) + s * t * (1 - t) * (1 - t) + q * t * t * (3 - 2 * t) + e * t * t * (t - 1)
    value = F.when(t < 0, p + s * t).when(t > 1, q + e * (t - 1)).otherwise(cubic)
    return at.withColumn("density", F.when(value < 0, 0.0).otherwise(value)).drop("_i", "_x", "_p", "_s", "_q", "_t")
