"""Expectation files of aligned reads, in both variants, and per-k-mer dumps, as long tables; written and read through Spark's own text files.

A file has a header (states, alphabet size, alphabet, k), nine transitions and a likelihood, the model's five parameters
for each k-mer, and then either, for normal emissions, two expectations for each k-mer, posteriors and an observation
mask, or, for densities, the levels assigned to k-mers and those k-mers. As rows: item, i (its place in the item), kmer
(where the item has one) and value. Counts that do not agree with the header raise an error when the rows are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq

STATES = 3
NORMAL = {"model": 5, "expectation": 2, "posterior": 1, "observed": 1}  #: items of a k-mer, in the file's order of lines
ROWS = "file string, item string, i long, kmer string, value double"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != "")


def _kmer(i: Column, alphabet: Column, k: Column) -> Column:
    """The k-mer of a rank over an alphabet that stands in the row."""
    size = F.length(alphabet)
    digit = lambda j: F.substring(alphabet, (F.floor(i / F.pow(size, k - j)) % size).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), k), digit), "")


def expectations(spark: SparkSession, path: str, densities: bool = False) -> DataFrame:
    """ROWS of all files under a path; `file` is the folder that `write_expectations` made, or the file's own name."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"file=([^/]+)/[^/]*$", 1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  of the folder's name, and of its path
    lines = whole.select(F.when(name != "", decoded(decoded(name))).otherwise(F.col("_metadata.file_name")).alias("file"), F.split("value", "\n").alias("l"))
    line = lambda n: _tokens(F.coalesce(F.get("l", F.lit(n)), F.lit("")))
    names = ["assignment", "assigned"] if densities else list(NORMAL)[1:]
    cut = lines.select("file", line(0).alias("h"), line(1).alias("t"), line(2).alias("model"), *[line(3 + n).alias(x) for n, x in enumerate(names)])
    sized = cut.withColumns({"alphabet": F.get("h", F.lit(2)), "k": F.get("h", F.lit(3)).cast("int")})
    n = F.pow(F.length("alphabet"), F.col("k")).cast("long")
    right = (F.size("h") == 4) & (F.size("t") == STATES * STATES + 1) & (F.length("alphabet") == F.get("h", F.lit(1)).cast("int")) & (F.size("model") == NORMAL["model"] * n)
    if densities:
        right = right & (F.size("assignment") == F.size("assigned")) & F.forall("assigned", lambda x: F.length(x) == F.col("k"))
    else:
        for x in names:
            right = right & (F.size(x) == NORMAL[x] * n)
    checked = sized.where(F.coalesce(F.assert_true(F.coalesce(right, F.lit(False)), F.concat(F.lit("counts do not agree with the header of "), "file")).isNull(), F.lit(True)))

    def item(name: str, label: Column, kmer: Column | None = None) -> DataFrame:
        each = checked.select("file", "alphabet", "k", *(["assigned"] if densities else []), F.posexplode(name).alias("i", "v"))
        return each.select("file", label.alias("item"), F.col("i").cast("long").alias("i"), (F.lit(None).cast("string") if kmer is None else kmer).alias("kmer"), F.col("v").cast("double").alias("value"))

    of = lambda width: _kmer(F.floor(F.col("i") / width), F.col("alphabet"), F.col("k"))
    out = item("t", F.when(F.col("i") < STATES * STATES, "transition").otherwise("likelihood")).unionAll(item("model", F.lit("model"), of(NORMAL["model"])))
    for x in names[:1] if densities else names:
        out = out.unionAll(item(x, F.lit(x), F.get("assigned", F.col("i")) if densities else of(NORMAL[x])))
    return out


def write_expectations(rows: DataFrame, path: str, alphabet: str, k: int, mode: str = "errorifexists") -> None:
    """One file for each `file`, in a folder of its name. rows: ROWS, with `assignment` items or with those of NORMAL, not both.

    A file's rows meet in one task, as they do in one file.
    """
    listed = rows.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("i", F.col("value").cast("string").alias("v"), "kmer"))).alias("x"))
    by = listed.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("item", "x"))).alias("m"))
    at = lambda item, field="v": F.array_join(F.transform(F.coalesce(F.try_element_at("m", F.lit(item)), F.expr("cast(array() as array<struct<i:bigint,v:string,kmer:string>>)")), lambda s: s[field]), "\t")
    head = F.lit("\t".join(map(str, (STATES, len(alphabet), alphabet, k))))
    first = [head, F.concat_ws("\t", at("transition"), at("likelihood")), at("model")]
    normal, dense = [at(x) for x in list(NORMAL)[1:]], [at("assignment"), at("assignment", "kmer")]
    text = F.when(F.map_contains_key("m", F.lit("assignment")), F.concat_ws("\n", *first, *dense)).otherwise(F.concat_ws("\n", *first, *normal))
    by.select("file", text.alias("value")).write.partitionBy("file").mode(mode).text(path)


def of_sums(sums: DataFrame, model: DataFrame, file: str, alphabet: str, k: int) -> DataFrame:
    """Rows of a file from expected sums (kind, key, p, px, pxx) and a model (kmer and five parameters): unseen k-mers have 0."""
    spark = sums.sparkSession
    ranks = spark.range(len(alphabet) ** k).select("id", sq.rank_kmer(F.col("id"), alphabet, k).alias("kmer"))
    row = lambda item, i, kmer, value: (F.lit(file).alias("file"), F.lit(item).alias("item"), i.cast("long").alias("i"), kmer.alias("kmer"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    moves = sums.where("kind = 't'").select(*row("transition", F.substring("key", 1, 1).cast("long") * STATES + F.substring("key", 2, 1).cast("long"), none, F.col("p")))
    total = sums.where("kind = 'z'").select(*row("likelihood", F.lit(STATES * STATES), none, F.col("px")))
    at = ranks.join(sums.where("kind = 'k'").select(F.col("key").alias("kmer"), "p", "px", "pxx"), "kmer", "left").join(model, "kmer", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    items = {
        "model": [zero(c) for c in ("level_mean", "level_sd", "noise_mean", "noise_sd", "noise_lambda")],
        "expectation": [zero("px"), zero("pxx")], "posterior": [zero("p")], "observed": [(zero("p") > 0).cast("int")],
    }
    out = moves.unionAll(total)
    for name, values in items.items():
        each = at.select("id", "kmer", F.posexplode(F.array(*[v.cast("double") for v in values])).alias("j", "v"))
        out = out.unionAll(each.select(*row(name, F.col("id") * len(values) + F.col("j"), F.col("kmer"), F.col("v"))))
    return out


def write_kmer_values(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder for each k-mer with its values, one a line. rows: kmer, value."""
    rows.where("kmer is not null and value is not null").select("kmer", F.col("value").cast("string").alias("value")).write.partitionBy("kmer").mode(mode).text(path)


def kmer_values(spark: SparkSession, path: str, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """kmer and the values between low and high, both left out, of such folders."""
    rows = spark.read.schema("value string, kmer string").text(path)
    return rows.select("kmer", F.col("value").cast("double").alias("value")).where((F.col("value") > low) & (F.col("value") < high))
