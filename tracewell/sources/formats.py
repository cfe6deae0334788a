"""Readers and writers of the text formats, as DataFrames with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import reads_forward

# Columns of the headerless tables, in file order.
FULL = "contig STRING, ref_pos BIGINT, ref_kmer STRING, read STRING, strand STRING, event_ix BIGINT, ev_mean DOUBLE, ev_noise DOUBLE, ev_duration DOUBLE, target_kmer STRING, scaled_mean DOUBLE, scaled_noise DOUBLE, posterior DOUBLE, descaled_mean DOUBLE, model_mean DOUBLE, path_kmer STRING"
VARIANT = "event_ix BIGINT, ref_pos BIGINT, base STRING, posterior DOUBLE, strand STRING, direction STRING, read STRING"
ASSIGNMENTS = "kmer STRING, strand STRING, descaled_mean DOUBLE, posterior DOUBLE"
CALLS = "site BIGINT, strand STRING, pA DOUBLE, pC DOUBLE, pG DOUBLE, pT DOUBLE, read STRING"
BUILD = "c0 STRING, c1 STRING, c2 STRING, c3 STRING, strand STRING, c5 STRING, c6 STRING, c7 STRING, c8 STRING, kmer STRING, c10 STRING, c11 STRING, c12 STRING, event_mean DOUBLE, c14 STRING"
SAM = "qname STRING, flag INT, rname STRING, pos BIGINT, mapq INT, cigar STRING, rnext STRING, pnext BIGINT, tlen BIGINT, seq STRING, qual STRING"
READ_PARAMS = ("scale", "shift", "var", "scale_sd", "var_sd", "drift")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table without header; only the columns that are used are parsed."""
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """A `full` table with the file it came from and whether its read is a forward one, by the file's name."""
    rows = read_table(spark, path, FULL).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("forward", ~F.endswith("file", F.lit(".backward.tsv")))


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty trimmed lines of a list of files."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def input_files(spark: SparkSession, path: str, pattern: str, n: int, seed: int = 0) -> DataFrame:
    """At most n of the non-empty files under a folder, chosen by a hash of their path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    return files.orderBy(F.xxhash64("path", F.lit(seed))).limit(n)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, sequence (upper case) and its complement."""
    rows = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.select(head.alias("contig"), body.alias("sequence")).withColumn("complement", F.translate("sequence", "ACGT", "TGCA"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """contig, strand, pos of a positions file: lines of a label and positions, first the forward strand's, then the backward's."""
    tokens = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("trim(value) <> ''").withColumn("t", tokens)
    rank = F.row_number().over(Window.partitionBy(F.get("t", F.lit(0))).orderBy("line"))
    by = rows.select(F.get("t", F.lit(0)).alias("contig"), F.when(rank == 1, "forward").otherwise("backward").alias("strand"), F.slice("t", F.lit(2), F.size("t")).alias("p"))
    return by.select("contig", "strand", F.explode("p").alias("pos")).withColumn("pos", F.col("pos").cast("long"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """start <= end of each line, however the file orders them."""
    t = F.split(F.trim("value"), r"\s+")
    a, b = F.get(t, F.lit(0)).cast("long"), F.get(t, F.lit(1)).cast("long")
    return spark.read.text(path).where("trim(value) <> ''").select(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A model file as its k-mer table and its transitions; counts that do not agree with its header raise an error."""
    lines = spark.read.text(path, wholetext=True).select(F.transform(F.split(F.trim("value"), "\n"), lambda x: F.split(F.trim(x), r"\s+")).alias("l"))
    head = lines.select(F.get("l", F.lit(0)).alias("h"), F.get("l", F.lit(1)).alias("t"), F.get("l", F.lit(2)).alias("p"))
    sized = head.select("h", "t", "p", F.get("h", F.lit(2)).alias("alphabet"), F.get("h", F.lit(3)).cast("int").alias("k"))
    right = (F.size("h") == 4) & (F.size("t") == 10) & (F.size("p") == 5 * F.pow(F.length("alphabet"), "k")) & (F.length("alphabet") == F.get("h", F.lit(1)).cast("int"))
    checked = sized.where(F.coalesce(F.assert_true(right, F.lit("model file: header, transitions and parameters do not agree")).isNull(), F.lit(True)))
    params = checked.select("alphabet", "k", F.posexplode("p").alias("i", "v")).groupBy("alphabet", "k", F.expr("cast(i div 5 as bigint)").alias("kmer_id"))
    names = ("level_mean", "level_sd", "noise_mean", "noise_sd", "noise_lambda")
    wide = params.agg(*[F.max(F.when(F.col("i") % 5 == j, F.col("v").cast("double"))).alias(n) for j, n in enumerate(names)])
    digits = F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: F.substring("alphabet", (F.floor(F.col("kmer_id") / F.pow(F.length("alphabet"), F.col("k") - j)) % F.length("alphabet")).cast("int") + 1, F.lit(1)))
    moves = checked.select(F.posexplode("t").alias("i", "v")).where("i < 9")
    return wide.select("kmer_id", F.array_join(digits, "").alias("kmer"), *names), moves.select(F.expr("i div 3").cast("int").alias("from_state"), F.expr("i % 3").alias("to_state"), F.col("v").cast("double").alias("p"))


def _numbers(line: Column, kind: str) -> Column:
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def signal_reads(spark: SparkSession, path: str) -> DataFrame:
    """Read files of fourteen lines: header, sequences, strand maps, event maps, and events of four numbers each."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("read_id"), F.split("value", "\n").alias("l"))
    line = lambda i: F.get("l", F.lit(i))
    h = F.split(F.trim(line(0)), r"\s+")

    def events(i: int) -> Column:
        v = _numbers(line(i), "double")
        each = F.sequence(F.lit(0), (F.size(v) / 4 - 1).cast("int"))
        return F.when(F.size(v) >= 4, F.transform(each, lambda j: F.struct(*[F.get(v, (j * 4 + o).cast("int")).alias(n) for o, n in enumerate(("mean", "stdv", "length", "start"))]))).otherwise(F.array().cast("array<struct<mean:double,stdv:double,length:double,start:double>>"))

    def params(first: int) -> Column:
        return F.struct(*[F.get(h, F.lit(first + i)).cast("double").alias(n) for i, n in enumerate(READ_PARAMS)])

    return lines.select(
        "read_id", F.get(h, F.lit(0)).cast("long").alias("two_d_length"), F.get(h, F.lit(1)).cast("long").alias("n_template_events"), F.get(h, F.lit(2)).cast("long").alias("n_complement_events"),
        params(6).alias("template_params"), params(12).alias("complement_params"), F.trim(line(1)).alias("seq_2d"), F.trim(line(2)).alias("template_read"),
        _numbers(line(3), "long").alias("template_strand_map"), F.trim(line(4)).alias("complement_read"), _numbers(line(5), "long").alias("complement_strand_map"),
        _numbers(line(6), "long").alias("template_map"), events(7).alias("template_events"), _numbers(line(8), "long").alias("complement_map"), events(9).alias("complement_events"),
    )


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The first primary mapped record of each query, with its CIGAR; flags other than 0 and 16 are left out."""
    rows = spark.read.text(path).where("value not like '@%'")
    names = [f.split()[0] for f in SAM.split(", ")]
    t = F.split("value", "\t")
    cols = rows.select(*[F.get(t, F.lit(i)).cast(f.split()[1]).alias(n) for i, (n, f) in enumerate(zip(names, SAM.split(", "), strict=True))], F.monotonically_increasing_id().alias("_at"))
    first = Window.partitionBy("qname").orderBy("_at")
    return cols.where("flag in (0, 16)").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "_at")


# --- writers ---------------------------------------------------------------------------------------------------------


def write_table(rows: DataFrame, path: str, schema: str, mode: str = "append") -> None:
    """Tab-separated, in the schema's column order, without header."""
    rows.select(*[f.split()[0] for f in schema.split(", ")]).write.mode(mode).option("sep", "\t").csv(path)


def variant_rows(full: DataFrame) -> DataFrame:
    """One row for each ambiguous place of the strand's reference k-mer: the base that the path puts there, and its position.

    A path runs with its read, so against the reference its places count from the other end. Without a column `forward`
    all reads are forward ones.
    """
    forward = F.col("forward") if "forward" in full.columns else F.lit(True)
    at = F.filter(F.sequence(F.lit(0), F.length("ref_kmer") - 1), lambda i: F.substring("ref_kmer", i + 1, F.lit(1)) == "X")
    each = full.where(F.contains("ref_kmer", F.lit("X"))).withColumn("_i", F.explode(at))
    place = F.when(reads_forward(F.col("strand"), forward), F.col("_i")).otherwise(F.length("ref_kmer") - 1 - F.col("_i"))
    return each.select("event_ix", (F.col("ref_pos") + F.col("_i")).alias("ref_pos"), F.substring("path_kmer", place + 1, F.lit(1)).alias("base"), "posterior", "strand", F.when(forward, "forward").otherwise("backward").alias("direction"), "read")


def build_rows(assignments: DataFrame) -> DataFrame:
    """Assignments in the fifteen-column layout, fillers where nothing is read."""
    blank = {f.split()[0]: F.lit("blank") for f in BUILD.split(", ")}
    return assignments.select(*[{"strand": F.col("strand"), "kmer": F.col("kmer"), "event_mean": F.col("descaled_mean")}.get(n, v).alias(n) for n, v in blank.items()])


def write_fasta(sequences: DataFrame, path: str) -> None:
    sequences.select(F.concat(F.lit(">"), "contig", F.lit("\n"), "sequence").alias("value")).write.mode("overwrite").text(path)
