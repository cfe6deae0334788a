"""Site calls: marginal base probabilities per site, and consensus across reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import reads_forward


def site_marginals(rows: DataFrame, alphabet: str, key: list[str]) -> DataFrame:
    """Per key and base the share of the summed posterior; bases without any have 0. rows: key, base, posterior."""
    sums = rows.groupBy(*key).pivot("base", list(alphabet)).agg(F.sum("posterior"))
    total = F.nullif(sum((F.coalesce(F.col(b), F.lit(0.0)) for b in alphabet), F.lit(0.0)), F.lit(0.0))  # null where nothing was seen
    return sums.select(*key, *[(F.coalesce(F.col(b), F.lit(0.0)) / total).alias(f"p{b}") for b in alphabet])


def consensus(calls: DataFrame, alphabet: str, site: str = "ref_pos", min_depth: int = 1) -> DataFrame:
    """Per site the summed marginals of all reads, those against the reference complemented, and the likeliest base.

    calls: site, strand, forward and p<base>. Of equal bases the first of the alphabet is called.
    """
    swap = {"A": "T", "C": "G", "G": "C", "T": "A"}
    along = reads_forward(F.col("strand"), F.col("forward"))
    each = [F.sum(F.when(along, F.col(f"p{b}")).otherwise(F.col(f"p{swap.get(b, b)}"))).alias(f"_s{b}") for b in alphabet]
    sums = calls.groupBy(site).agg(F.count("*").alias("depth"), *each).where(F.col("depth") >= min_depth)
    total = F.nullif(sum((F.col(f"_s{b}") for b in alphabet), F.lit(0.0)), F.lit(0.0))
    shares = sums.select(site, "depth", *[(F.col(f"_s{b}") / total).alias(f"p{b}") for b in alphabet])
    top = F.greatest(*[F.round(f"p{b}", 9) for b in alphabet])
    return shares.withColumn("call", F.coalesce(*[F.when(F.round(f"p{b}", 9) == top, b) for b in alphabet]))


def apply_calls(reference: DataFrame, calls: DataFrame, site: str = "ref_pos") -> DataFrame:
    """The reference string with called bases in place: contig, sequence; calls: contig, site, call."""
    chars = reference.select("contig", F.posexplode(F.split("sequence", "")).alias(site, "base"))
    new = chars.join(calls.select("contig", site, "call"), ["contig", site], "left").select("contig", site, F.coalesce("call", "base").alias("base"))
    return new.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(site, "base"))), lambda x: x["base"]), "").alias("sequence"))


def column_pairs(rows: DataFrame, column: str) -> DataFrame:
    """a, b (a <= b), pairs, columns: pairs of rows that show bases a and b in one column; a column costs its few base counts."""
    n = rows.groupBy(column, "base").agg(F.count("*").alias("n"))
    x, y = n.select(column, F.col("base").alias("a"), F.col("n").alias("_m")), n.select(column, F.col("base").alias("b"), F.col("n").alias("_n"))
    pairs = F.when(F.col("a") == F.col("b"), F.expr("_m * (_m - 1) div 2")).otherwise(F.col("_m") * F.col("_n"))
    return x.join(y, column).where("a <= b").groupBy("a", "b").agg(F.sum(pairs).alias("pairs"), F.count("*").alias("columns"))


def normalised(rows: DataFrame, value: str, within: list[str], out: str) -> DataFrame:
    return rows.withColumn(out, F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*within)), F.lit(0)))
