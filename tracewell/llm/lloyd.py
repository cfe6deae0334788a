"""Centroid clustering: plain Lloyd rounds in integers, exact at any size and in any order of the rows.

Every round broadcasts the centroids, of which there are few by choice, assigns in numpy inside mapInPandas and sends
one row of integer sums for each partition and centroid; their sums by centroid and component are grouped in Spark, and
the driver divides k times `size` of them. No copy of the vectors is written: each round reads them anew. A round that
moves no centroid ends the loop, since all further ones would be equal to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 27  #: components count as this much at most, so that 64 squares of differences fit in 64 bits
MAX_CENTROIDS = 4096  #: bounds what is broadcast and summed on the driver
SLICE = 4096  #: rows compared at once, so that a batch's differences stay in memory whatever the batch's size


def quantised(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: int) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the rows whose vector has `size` components, none null or non-finite."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    ints = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("x")).withColumnRenamed("x", vector)
    return rows.where((F.size(vector) == size) & whole).select("vec_id", ints.alias("v"))


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the centroid of least squared difference (the smaller number if equal), and that difference."""
    best, least = np.zeros(len(v), np.int64), np.full(len(v), np.iinfo(np.int64).max)
    for c, centre in enumerate(centroids):
        d = v - centre
        d = np.einsum("ij,ij->i", d, d)
        closer = d < least
        best[closer], least[closer] = c, d[closer]
    return best, least


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for low in range(0, len(frame), SLICE):
            part = frame.iloc[low : low + SLICE]
            yield part["vec_id"], np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid that has rows: their number, the sum of their distances and the sums of their components."""
    k, size = centroids.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, size + 3), np.int64)  # components, rows, distances: low 32 bits and the rest
        for _, v in _slices(frames):
            best, least = nearest(v, centroids)
            for c in np.unique(best):
                own = best == c
                sums[c, :size] += v[own].sum(axis=0)
                sums[c, size:] += own.sum(), (least[own] & 0xFFFFFFFF).sum(), (least[own] >> 32).sum()
        have = np.flatnonzero(sums[:, size])
        yield pd.DataFrame({"cluster": np.repeat(have, size + 3), "item": np.tile(np.arange(size + 3), len(have)), "s": sums[have].ravel()})

    totals = rows.mapInPandas(run, "cluster int, item int, s long").groupBy("cluster", "item").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s"))
    by: dict[int, dict[int, int]] = {}
    for r in totals.collect():  # at most k times (size + 3) rows
        by.setdefault(r["cluster"], {})[r["item"]] = int(r["s"])
    return {c: (x[size], x[size + 1] + (x[size + 2] << 32), [x[i] for i in range(size)]) for c, x in by.items()}


def start_order(vec_id: Column, seed: int) -> Column:
    """The hash by which rows become first centroids; a null id counts as empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit(""))), 256)


def cluster(vectors: DataFrame, k: int, size: int, rounds: int = 10, scale: int = 1024, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every row that has a whole vector.

    Whole: `size` components, none null or non-finite; other rows, null vectors among them, give none. Components count
    as floor(scale * x), and as 2**27 at most, either sign. The first centroids are the k rows of least hash of seed and
    id, in that order; of rows that share an id, those of smaller vectors come first, and repeated rows may give equal
    centroids, of which only the first gets rows. With fewer than k rows each is a centroid; an empty table gives no
    rows. Rows that share an id, or have none, are rows of their own. Sums of distances over 64 bits are null.
    """
    if not 0 < k <= MAX_CENTROIDS:
        raise ValueError(f"k must be between 1 and {MAX_CENTROIDS}")
    rows = quantised(vectors, vec_id, vector, size, scale)
    first = rows.orderBy(start_order(F.col("vec_id"), seed), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), size)
    for _ in range(rounds if len(first) else 0):
        moved = centroids.copy()
        for c, (n, _, sums) in _sums(rows, centroids).items():
            moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    far = {c: d for c, (_, d, _) in _sums(rows, centroids).items()} if len(first) else {}
    whole = lambda x: x if x < 1 << 63 else None
    each = {c: whole(d) for c, d in far.items()}
    total = whole(sum(far.values()))
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, v in _slices(frames):
            best, least = nearest(v, centroids)
            own = best.tolist()
            yield pd.DataFrame({"vec_id": ids.astype("Int64"), "cluster": best, "distance": least, "cluster_inertia": pd.array([each[c] for c in own], "Int64"), "inertia": pd.array([total] * len(own), "Int64"), "centroid_sha256": [names[c] for c in own]})

    return rows.mapInPandas(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
