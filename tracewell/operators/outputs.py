"""Result tables of alignments: posterior pairs with their events, reference places and each read's own calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import emissions as em
from ..functions import sequences as sq
from ..sources import formats

READS = "read_id, label, contig, strand, forward, target, ref_offset, first_event, scale, shift, var, scale_sd"


def full(pairs: DataFrame, events: DataFrame, reads: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """The columns of the full table, and `forward`.

    pairs: read_id, x, y, kmer, p, in places of the read's slices; events: read_id, y, mean, stdv, duration, in the same
    places; reads: READS, one row a read, with the slice of the reference that it was aligned to and its parameters;
    model: kmer, level_mean, noise_mean. Pairs whose k-mer the model lacks, or without event or read, give no row.
    """
    at = pairs.join(events, ["read_id", "y"]).join(reads, "read_id").join(model.select("kmer", "level_mean", "noise_mean"), "kmer")
    target = F.substring("target", F.col("x").cast("int") + 1, F.lit(k))
    place = sq.reference_position(F.col("x"), F.col("ref_offset"), F.length("target"), k, F.col("strand"), F.col("forward"))
    level = F.col("level_mean")
    return at.select(
        "contig", place.cast("long").alias("ref_pos"), sq.strand_kmer(target, F.col("strand"), F.col("forward")).alias("ref_kmer"), F.col("label").alias("read"), "strand",
        (F.col("y") + F.col("first_event")).alias("event_ix"), F.col("mean").alias("ev_mean"), F.col("stdv").alias("ev_noise"), F.col("duration").alias("ev_duration"), target.alias("target_kmer"),
        (level * F.col("scale") + F.col("shift")).alias("scaled_mean"), (F.col("noise_mean") * F.col("scale_sd")).alias("scaled_noise"), F.col("p").alias("posterior"),
        em.descale(F.col("mean"), level, F.col("scale"), F.col("shift"), F.col("var")).alias("descaled_mean"), level.alias("model_mean"), F.col("kmer").alias("path_kmer"), "forward",
    )


def assignments(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("path_kmer").alias("kmer"), "strand", "descaled_mean", "posterior")


TABLES = {  # name of a format: its rows from full ones, and its schema
    "full": (lambda rows: rows.drop("forward"), formats.FULL),
    "variantCaller": (formats.variant_rows, formats.VARIANT),
    "assignments": (assignments, formats.ASSIGNMENTS),
}


def result_table(kind: str, pairs: DataFrame, events: DataFrame, reads: DataFrame, model: DataFrame, k: int) -> DataFrame:
    """The table of a format of TABLES."""
    if kind not in TABLES:
        raise ValueError(f"no output format {kind!r}; there are {', '.join(TABLES)}")
    return TABLES[kind][0](full(pairs, events, reads, model, k))


def write_result(kind: str, path: str, *inputs, mode: str = "append") -> None:
    formats.write_table(result_table(kind, *inputs), path, TABLES[kind][1], mode)
