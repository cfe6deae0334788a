"""Sharding by a Hilbert curve: quantise metadata, sort by curve index, cut runs of equal row counts.

Every dimension is quantised at cut points that `percentile_approx` takes over all rows, so that each has about as
many rows between any two. Strings are compared whole with the exact quantiles of all rows' values, so that prefixes
they share do not matter; numbers, booleans, dates and times by their value, with NaN above all. Other types have no order here and raise a ValueError. Rows near on the curve
are near in every dimension, hence each shard spans a small box and a file's min/max statistics prune on all of them.

Law: row counts of any two shards differ by one at most; slots are gapless from 0 in curve order. Ties on the curve
are ordered by text checksum, size and doc_id, so equal texts with equal metadata are neighbours and a source with
a third of all rows is still cut anywhere. Defined results: null dimensions sort first; null texts have size 1 and
checksum 0; repeated rows get slots of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import cut, shards


def curve_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of `axes` (rows x dimensions, values below 2**bits), by Skilling's transposition."""
    x, n = axes.T.astype(np.int64), axes.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in reversed(range(bits)):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def string_cuts(docs: DataFrame, columns: list[str], pieces: int) -> dict[str, list[str]]:
    """Quantiles of the whole strings of all rows: each column's values at the k-th of `pieces` equal parts, k from 1 on.

    Values are counted once each and sorted over all partitions; a value's rank follows from the rows before its
    partition and those before it within. Only the counts of partitions and the cuts reach the driver.
    """
    if not columns:
        return {}
    each = [F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in columns]
    values = docs.select(F.explode(F.array(*each)).alias("s")).select("s.*").where("v is not null")
    counted = values.groupBy("c", "v").agg(F.count("*").alias("n"))
    placed = cut(counted.repartitionByRange(shards(docs.sparkSession), "c", "v").withColumn("_p", F.spark_partition_id()))
    before, total = [], dict.fromkeys(columns, 0)
    for r in sorted(placed.groupBy("c", "_p").agg(F.sum("n").alias("n")).collect()):  # one row a partition, and one more a column
        before.append((r["c"], r["_p"], total[r["c"]]))
        total[r["c"]] += r["n"]
    offsets = docs.sparkSession.createDataFrame([(*x, total[x[0]]) for x in before], "c string, _p int, _from long, all long")
    by = Window.partitionBy("_p", "c").orderBy("v")
    upto = placed.join(F.broadcast(offsets), ["c", "_p"]).select("c", "v", "n", "all", (F.col("_from") + F.sum("n").over(by)).alias("upto"))
    part = lambda x: F.floor((x * pieces + pieces - 1) / F.col("all"))
    crossed = F.least(part(F.col("upto") - 1), F.lit(pieces - 1)) > F.least(part(F.col("upto") - F.col("n") - 1), F.lit(pieces - 1))
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in upto.where(crossed).select("c", "v").collect():  # at most `pieces` a column
        found[r["c"]].append(r["v"])
    return {c: sorted(x, key=str.encode) for c, x in found.items()}


def ordinal(c: Column, kind: str, cuts: list[str] | None) -> Column:
    """A long or double with the column's order; strings by the cuts they reach; null below all."""
    if cuts is not None:
        reached = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<string>"), lambda x: x <= c))
        return F.coalesce(F.when(c.isNotNull(), reached).cast("long"), F.lit(-1).cast("long"))
    if kind.startswith("timestamp"):
        c, kind = F.unix_micros(c.cast("timestamp")), "bigint"
    if kind == "date":
        c, kind = F.unix_date(c), "bigint"
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    if kind in ("float", "double") or kind.startswith("decimal"):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    raise ValueError(f"no order for dimensions of type {kind}")


def hilbert_shards(docs: DataFrame, dims: list[str], n_shards: int = 16, bits: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row."""
    kinds = dict(docs.dtypes)
    cuts_of = string_cuts(docs, [d for d in dims if kinds[d] == "string"], 4 << bits)
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *[ordinal(F.col(f"`{d}`"), kinds[d], cuts_of.get(d)).alias(f"_d{i}") for i, d in enumerate(dims)],
    )
    rows = cut(rows.withColumn(f"_d{len(dims)}", F.col("size")))
    axes = [f"_d{i}" for i in range(len(dims) + 1)]
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = rows.agg(*[F.percentile_approx(a, steps, 1000).alias(a) for a in axes]).first()
    types = dict(rows.dtypes)
    cuts = [np.unique(np.array(found[a] or [], np.float64 if types[a] == "double" else np.int64)) for a in axes]

    @F.pandas_udf("long")
    def curve(*cols: pd.Series) -> pd.Series:
        axes = np.stack([np.searchsorted(c, v.to_numpy(c.dtype), "right") for c, v in zip(cuts, cols, strict=True)], axis=1)
        return pd.Series(curve_index(axes, bits))

    keyed = rows.select("doc_id", "size", "text_crc32", curve(*axes).alias("curve"))
    order = ["curve", "text_crc32", "size", "doc_id"]
    placed = keyed.repartitionByRange(shards(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    counts = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts = np.concatenate([[0], np.cumsum([n for _, n in counts])]).astype(int)
    total = int(starts[-1])
    offsets = docs.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(counts, starts, strict=False)], "_p long, _from long")
    rank = F.col("_from") + F.col("_at").bitwiseAND((1 << 33) - 1)
    ranked = placed.join(F.broadcast(offsets), "_p").withColumn("_rank", rank)
    shard = F.expr(f"cast(_rank * {n_shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")
