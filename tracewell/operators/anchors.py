"""Anchor pairs: from alignments and shared k-mers, monotone filter, remapping, splitting of large gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import kmers
from .seeding import seeded


def monotone(pairs: DataFrame, key: str | list[str] = "read_id") -> DataFrame:
    """Pairs (x, y) that are in one strict order with all other distinct pairs of their key, both ways."""
    keys = [key] if isinstance(key, str) else key
    distinct = pairs.select(*keys, "x", "y").distinct()
    before = Window.partitionBy(*keys).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc("y")).rowsBetween(Window.unboundedPreceding, -1)
    lim = distinct.select("*", F.min("x").over(after).alias("_x1"), F.min("y").over(after).alias("_y1")).select("*", F.max("x").over(before).alias("_x0"), F.max("y").over(before).alias("_y0"))
    keep = F.coalesce((F.col("x") > F.col("_x0")) & (F.col("y") > F.col("_y0")), F.lit(True)) & F.coalesce((F.col("x") < F.col("_x1")) & (F.col("y") < F.col("_y1")), F.lit(True))
    return lim.where(keep).select(*keys, "x", "y")


def remap(pairs: DataFrame, event_map: DataFrame, key: str = "read_id") -> DataFrame:
    """Pairs with y as a base turned into pairs with y as an event."""
    at = event_map.select(key, F.col("base_pos").alias("y"), F.col("event_index").alias("_e"))
    return pairs.join(at, [key, "y"]).select(key, "x", F.col("_e").alias("y"))


def from_cigar(ops: DataFrame, trim: int, key: str = "read_id") -> DataFrame:
    """Anchors of match runs, `trim` left out at both ends. ops: key, op_index, n, op, x_start, y_start."""
    before = Window.partitionBy(key).orderBy("op_index").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda kinds: F.coalesce(F.sum(F.when(F.col("op").isin(*kinds), F.col("n")).otherwise(0)).over(before), F.lit(0))
    at = ops.select(key, "n", "op", (F.col("x_start") + moved("MD=X")).alias("_x"), (F.col("y_start") + moved("MI=X")).alias("_y"))
    runs = at.where(F.col("op").isin("M", "=", "X") & (F.col("n") > 2 * trim))
    step = runs.withColumn("_i", F.explode(F.sequence(F.lit(trim).cast("long"), F.col("n") - trim - 1)))
    return step.select(key, (F.col("_x") + F.col("_i")).alias("x"), (F.col("_y") + F.col("_i")).alias("y"))


def seeds(a: DataFrame, b: DataFrame, k: int, most: int = 1) -> DataFrame:
    """Shared k-mers of two sequence tables (id, sequence) that occur at most `most` times in each sequence; id_a, id_b, x, y."""

    def places(t: DataFrame, name: str, pos: str) -> DataFrame:
        each = t.select(F.col("id").alias(name), F.posexplode(kmers(F.col("sequence"), k)).alias(pos, "kmer"))
        return each.groupBy(name, "kmer").agg(F.min(pos).cast("long").alias(pos), F.count("*").alias("_n")).where(F.col("_n") <= most).drop("_n")

    return places(a, "id_a", "x").join(places(b, "id_b", "y"), "kmer").select("id_a", "id_b", "x", "y", "kmer")


TILE = 1 << 19  #: letters of one side of a tile
PAIRS = "id_a long, id_b long, x long, y long"


def tiles(t: DataFrame, number: int) -> DataFrame:
    """One row a tile: its number and its sequences."""
    rows = t.where("sequence is not null").select(F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("tile"), F.struct(F.col("id").cast("long").alias("id"), "sequence").alias("s"))
    return rows.groupBy("tile").agg(F.collect_list("s").alias("s"))


def recursive_seeds(a: DataFrame, b: DataFrame, ks: list[int], limit: int) -> DataFrame:
    """id_a, id_b, x, y: anchors by ever shorter k-mers, each k only inside the gaps that the longer ones leave.

    a, b: id, sequence. The first k joins k-mers that both have once, for any two sequences; then gaps of more than
    `limit` cells between anchors (their ends included) are seeded with the next k, by k-mers that each side of the gap
    has once. After each k only anchors in one strict order stay, those of longer k-mers first. A pair ends with the last
    k, or when it has no gap larger than the limit.

    Both tables are cut into tiles, and each two tiles meet in one row, some sequences of `a` at a time. What is between
    the first seeds and the last anchors never leaves the task, so only the tiles are shuffled: each side as many times
    as the other has tiles.
    """
    size = lambda t: t.agg(F.sum(F.length("sequence"))).first()[0] or 0
    n_a, n_b = (max(-(-n // TILE), min(8, -(-n // 4096)), 1) for n in (size(a), size(b)))
    sides = [tiles(a, n_a).select(F.col("tile").alias("t"), F.col("s").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("u")), tiles(b, n_b).select(F.col("tile").alias("u"), F.col("s").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_a - 1))).alias("t"))]
    parts = min(n_a * n_b, max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_a * n_b // 4))
    pairs = sides[0].join(sides[1], ["t", "u"]).select("a", "b").repartition(parts)  # else few bytes, but much work, come together in one task
    return pairs.mapInArrow(lambda batches: seeded(batches, ks, limit), PAIRS)


def split_blocks(pairs: DataFrame, limit: int, key: str = "read_id") -> DataFrame:
    """A block number for each anchor; a new block begins where the gap to the anchor before spans more than `limit` cells."""
    by = Window.partitionBy(key).orderBy("x", "y")
    gap = (F.col("x") - F.lag("x").over(by)) * (F.col("y") - F.lag("y").over(by))
    flagged = pairs.withColumn("_new", F.when(gap > limit, 1).otherwise(0))
    return flagged.select(key, "x", "y", F.sum("_new").over(by).cast("long").alias("block"))


def block_bounds(blocks: DataFrame, key: str = "read_id") -> DataFrame:
    return blocks.groupBy(key, "block").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n_anchors"))
