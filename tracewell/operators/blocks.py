"""Blocks of reads for the pair HMM: cuts in large gaps between anchors, and what lies in each block.

Between two anchors, or an anchor and an end, that leave more than `limit` cells between them, a block ends up to
sqrt(limit) places after the first and the next begins as much before the second; what is between stays unaligned, and
the blocks' ends there are ragged. So no block is dense beyond the limit, and a read's blocks are aligned independently.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

SPLIT = 3000 * 3000  #: default number of cells between anchors above which a read is cut


def spans(lengths: DataFrame, anchors: DataFrame, limit: int = SPLIT, ragged_left: bool = False, ragged_right: bool = False, key: str = "read_id") -> DataFrame:
    """key, block, x0, y0, x1, y1 (ends are beyond the last place), ragged_left, ragged_right.

    lengths: key, nx, ny. anchors: key, x, y, in one strict order within a key; those outside the read are left out. A
    read with a ragged end has no block between that end and a gap that is cut.
    """
    side = math.isqrt(limit)
    inner = anchors.join(lengths, key).where("x >= 0 and x < nx and y >= 0 and y < ny").select(key, "x", "y", "nx", "ny", F.lit(False).alias("end"))
    ends = lengths.where("nx > 0 and ny > 0").select(key, F.col("nx").alias("x"), F.col("ny").alias("y"), "nx", "ny", F.lit(True).alias("end"))
    by = Window.partitionBy(key).orderBy("x", "y")
    before = lambda c: F.coalesce(F.lag(c).over(by) + 1, F.lit(0))
    gaps = inner.unionByName(ends).select("*", before("x").alias("px"), before("y").alias("py"), F.lag("x").over(by).isNull().alias("first"))
    wide = ((F.col("x") - F.col("px")) * (F.col("y") - F.col("py")) > limit).alias("wide")
    half = lambda a, b: F.least(F.floor((F.col(a) - F.col(b)) / 2), F.lit(side))
    marks = gaps.select("*", wide, half("x", "px").alias("hx"), half("y", "py").alias("hy")).where("wide or end")
    # each cut ends one block and begins the next; the read's end ends the last
    at = Window.partitionBy(key).orderBy("x", "y")
    cut = F.col("wide")
    stops = marks.select(key, "x", "y", "end", "wide", "first", F.when(cut, F.col("px") + F.col("hx")).otherwise(F.col("nx")).alias("x1"), F.when(cut, F.col("py") + F.col("hy")).otherwise(F.col("ny")).alias("y1"), F.when(cut, F.col("x") - F.col("hx")).alias("nx0"), F.when(cut, F.col("y") - F.col("hy")).alias("ny0"), "nx", "ny")
    blocks = stops.select(key, "first", "end", "wide", "x1", "y1", "nx0", "ny0", "nx", "ny", F.coalesce(F.lag("nx0").over(at), F.lit(0)).alias("x0"), F.coalesce(F.lag("ny0").over(at), F.lit(0)).alias("y0"), F.lag("nx0").over(at).isNull().alias("opens"))
    # a gap before the read's end is cut as well: what comes after it is a block up to the end
    own = blocks.select(key, "x0", "y0", "x1", "y1", (F.lit(ragged_left) | ~F.col("opens")).alias("ragged_left"), (F.lit(ragged_right) | F.col("wide")).alias("ragged_right"), F.when(F.lit(ragged_left), ~(F.col("first") & F.col("wide"))).otherwise(F.lit(True)).alias("take"))
    tail = blocks.where("end and wide").select(key, F.col("nx0").alias("x0"), F.col("ny0").alias("y0"), F.col("nx").alias("x1"), F.col("ny").alias("y1"), F.lit(True).alias("ragged_left"), F.lit(ragged_right).alias("ragged_right"), F.lit(not ragged_right).alias("take"))
    kept = own.unionByName(tail).where("take").drop("take")
    return kept.withColumn("block", (F.row_number().over(Window.partitionBy(key).orderBy("x0", "y0")) - 1).cast("long"))


def lengths_of(kmers: DataFrame, events: DataFrame, key: str = "read_id") -> DataFrame:
    """key, nx, ny: one more than the last place of each read's k-mers and events; reads that lack either are left out."""
    last = lambda t, c, n: t.groupBy(key).agg((F.max(c) + 1).cast("long").alias(n))
    return last(kmers, "x", "nx").join(last(events, "y", "ny"), key)


def read_blocks(kmers: DataFrame, events: DataFrame, anchors: DataFrame, limit: int = SPLIT, ragged_left: bool = False, ragged_right: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """One row of the pair HMM's input for each block. kmers: read_id, x, options; events: read_id, y, mean; anchors: read_id, x, y.

    lengths: `lengths_of` of both, if they are known otherwise. The cuts are written once, one row a block. All joins are on read_id and share one partitioning. Places that `kmers` or `events` leave out within a read would
    move those after them, so both must have every place, with null options or levels where nothing is known.
    """
    cuts = written(spans(lengths_of(kmers, events) if lengths is None else lengths, anchors, limit, ragged_left, ragged_right))

    def within(rows: DataFrame, place: str, low: str, high: str, item, name: str) -> DataFrame:
        at = rows.join(cuts.select("read_id", "block", low, high), "read_id").where((F.col(place) >= F.col(low)) & (F.col(place) < F.col(high)))
        listed = at.groupBy("read_id", "block").agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), item.alias("v")))).alias("l"))
        return listed.select("read_id", "block", F.transform("l", lambda e: e["v"]).alias(name))

    options = F.when(F.col("options").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("options"))
    x = within(kmers, "x", "x0", "x1", options, "kmers")
    y = within(events, "y", "y0", "y1", F.col("mean"), "events")
    near = anchors.join(cuts.select("read_id", "block", "x0", "y0", "x1", "y1"), "read_id").where("x >= x0 and x < x1 and y >= y0 and y < y1")
    own = F.struct((F.col("x") - F.col("x0")).cast("int").alias("x"), (F.col("y") - F.col("y0")).cast("int").alias("y"))
    marks = near.groupBy("read_id", "block").agg(F.array_sort(F.collect_list(own)).alias("anchors"))
    rows = cuts.join(x, ["read_id", "block"]).join(y, ["read_id", "block"]).join(marks, ["read_id", "block"], "left")
    return rows.select("read_id", "block", F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"), "kmers", "events", "anchors", "ragged_left", "ragged_right")
