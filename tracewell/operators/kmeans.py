"""Starts for mixtures: one-dimensional k-means over all rows, several restarts in one job, seeded by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CENTRES = 1 << 16  #: restarts times centres: bounds what each task and the driver hold


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value the nearest of ascending centres (the lower if equal), and the squared distance."""
    right = np.clip(np.searchsorted(centres, x), 1, max(len(centres) - 1, 1))
    left = right - 1
    right = np.minimum(right, len(centres) - 1)
    at = np.where(x - centres[left] <= centres[right] - x, left, right)
    return at, (x - centres[at]) ** 2


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and squared distances of the values by restart and nearest centre."""
    restarts, k = centres.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((3, restarts, k))
        for frame in frames:
            x = frame["x"].to_numpy(float)
            for r in range(restarts):
                at, d = _nearest(x, centres[r])
                out[:, r] += [np.bincount(at, w, k) for w in (np.ones(len(x)), x, d)]
        yield pd.DataFrame({"i": np.arange(restarts * k), "n": out[0].ravel(), "s": out[1].ravel(), "d": out[2].ravel()})

    total = np.zeros((3, restarts * k))
    for r in rows.select("x").mapInPandas(run, "i int, n double, s double, d double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("d").alias("d")).collect():
        total[:, r["i"]] = r["n"], r["s"], r["d"]
    return tuple(total.reshape(3, restarts, k))


def _draw(rows: DataFrame, centres: np.ndarray | None, restarts: int, salt: int) -> list[float | None]:
    """One value for each restart, drawn in proportion to the squared distance to its centres (alike without any).

    Of exponential times with these rates the first belongs to such a draw, so each task sends its earliest only.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full(restarts, np.inf)
        value = np.full(restarts, np.nan)
        for frame in frames:
            x = frame["x"].to_numpy(float)
            seed = frame["h"].to_numpy(np.int64).view(np.uint64)
            for r in range(restarts):
                h = seed * np.uint64(2 * r + 1) + np.uint64(r * 0x9E3779B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                u = ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)
                rate = np.ones(len(x)) if centres is None else _nearest(x, centres[r])[1]
                with np.errstate(divide="ignore"):
                    t = np.where(rate > 0, -np.log(u) / rate, np.inf)
                if len(t) and t.min() < best[r]:
                    best[r], value[r] = t.min(), x[t.argmin()]
        have = np.flatnonzero(np.isfinite(best))
        yield pd.DataFrame({"r": have, "t": best[have], "x": value[have]})

    first = rows.select("x", F.xxhash64("id", F.lit(salt)).alias("h")).mapInPandas(run, "r int, t double, x double").groupBy("r").agg(F.min_by("x", "t").alias("x"))
    found = {r["r"]: r["x"] for r in first.collect()}
    return [found.get(r) for r in range(restarts)]


def kmeans(rows: DataFrame, k: int, restarts: int = 5, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Ascending centres and the sum of squared distances of the best restart. rows: id (unique), x; null or NaN values do not count.

    Each of the k seeds of all restarts is one pass, and so is each round; they end when no centre moves. With fewer
    distinct values than k some centres are equal. Without values there are no centres and the objective is 0.
    """
    if restarts * k > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    rows = rows.where("x is not null and not isnan(x)")
    chosen: list[list[float]] = [[] for _ in range(restarts)]
    for step in range(k):
        now = np.sort(np.array(chosen), axis=1) if step else None
        for c, x in zip(chosen, _draw(rows, now, restarts, seed * 1009 + step), strict=True):
            if x is None and not c:
                return np.zeros(0), 0.0
            c.append(c[-1] if x is None else x)
    centres = np.sort(np.array(chosen, float), axis=1)
    for _ in range(rounds):
        n, s, _ = _sums(rows, centres)
        moved = np.sort(np.where(n > 0, s / np.maximum(n, 1), centres), axis=1)
        if np.array_equal(moved, centres):
            break
        centres = moved
    cost = _sums(rows, centres)[2].sum(axis=1)
    return centres[cost.argmin()], float(cost.min())
