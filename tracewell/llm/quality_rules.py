"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows inside a text. The cross-document
rule hashes every line (lower case, without digits and white space; a line of nothing else does not count) and counts
the distinct documents of its host that have it. A line of more than `max_docs` documents is above the limit; it is
taken away wherever it stands but in the document of least doc_id that has it, so that nothing vanishes with all its
copies. A document that loses over `depleted` of its words that way is rejected; the text that the others go on with
is the column `clean`, if one is named.

Lines are counted with partial sums in each task, so a host with a third of all rows or a line on every page is
small before it is dealt; the lines above the limit, and the places where they stand, are written before they are
joined, so that adaptive execution can split those joins. Without `clean` no text is shuffled.

Defined results: null or empty texts have no words and fail the base rule; a null host is a host of its own; rows
that share a doc_id are one document of a host, and a row without one is its own; rows that share the least doc_id all
keep their lines; a null doc_id is not the least unless all are null; texts of any length are one row and are never cut; columns of the input
never clash with the operator's own, and the result carries only those asked for. Lines, texts and windows count as
equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import kept_table

WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"
LEFT_OUT = r"[0-9\x20\x09\x0B-\x0D]+"  #: of lines, before they are hashed
SYMBOLS = "[#*$%&|<>]"
HOST = ["_host", "_nohost"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def normal_lines(text: Column) -> Column:
    """The text's lines as they are compared, in place."""
    return F.split(F.lower(F.regexp_replace(text, LEFT_OUT, "")), "\n")


def base_metrics(rows: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words to rows whose `text` is not null."""
    t = F.col(text)
    filled = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    one = rows.withColumns({"_w": words_of(t), "_lines": filled})
    two = one.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_g": F.when(F.size("_w") < 3, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.slice("_w", 3, F.size("_w")), lambda w, i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), w))),
    }).drop("_lines", "_w")
    # windows in order of hash, then place; only texts that repeat one at all
    three = two.withColumn("_s", F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(None)).otherwise(F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, i: F.get("_s", i)["h"] == s["h"]
    four = three.withColumn("_at", F.sort_array(F.transform(F.filter("_s", lambda s, i: F.coalesce(same(s, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(s, F.greatest(i - 1, F.lit(0))), F.lit(False)))), lambda s: s["i"])))
    covered = F.aggregate("_at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n"), (p + 3).alias("to")), lambda a: a["n"])
    five = four.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_g", "_s", "_at")
    # a filter on the counts must not be pushed below them: inside the lambdas it would rebuild the arrays for each element
    six = five.withColumn("_row", F.monotonically_increasing_id())
    return six.withColumns({c: F.when(F.col("_row") >= 0, F.col(c)) for c in ("n_words", "n_repeat_words")}).drop("_row")


def frequent_lines(texts: DataFrame, max_docs: int) -> DataFrame:
    """Host, hash and first document of the lines above the limit. texts: _host, _nohost, _id, _text."""
    keys = F.array_distinct(F.transform(F.filter(normal_lines(F.col("_text")), lambda x: x != ""), lambda x: F.xxhash64(x)))
    lines = lambda t: t.select(*HOST, "_id", F.explode(keys).alias("line"))
    counts = lines(texts).groupBy(*HOST, "line").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    # rows that share an id are one document: what they count twice is taken off again, which only touches such rows
    again = kept_table(texts.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"))
    if again.limit(1).count():
        twice = lines(texts.join(again, "_id", "left_semi")).groupBy(*HOST, "line", "_id").agg((F.count("*") - 1).alias("more"))
        counts = counts.join(twice.groupBy(*HOST, "line").agg(F.sum("more").alias("more")), [*HOST, "line"], "left").withColumn("n", F.col("n") - F.coalesce("more", F.lit(0)))
    return kept_table(counts.where(F.col("n") > max_docs).select(*HOST, "line", "first"))


def places_of(texts: DataFrame, over: DataFrame) -> DataFrame:
    """For each distinct text of a host that has such lines: `_cut`, their places, words and first documents."""
    each = F.zip_with(normal_lines(F.col("_text")), F.split("_text", "\n"), lambda x, raw: F.struct(F.when(x != "", F.xxhash64(x)).alias("line"), F.size(words_of(raw)).alias("words")))
    lines = texts.select(*HOST, "_key", F.posexplode(each).alias("place", "s")).select(*HOST, "_key", "place", "s.line", "s.words").where("line is not null")
    found = lines.join(over, [*HOST, "line"]).groupBy(*HOST, "_key").agg(F.collect_set(F.struct("place", "words", "first")).alias("_cut"))
    return kept_table(found)


def quality_rules(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", host: str = "source", doc_id: str = "doc_id", min_words: int = 50, max_docs: int = 10, depleted: float = 0.3, clean: str | None = None) -> DataFrame:
    """`keep`, the base counts, base_failed, n_removed_words (of lines above the limit) and kept of every row; and
    if `clean` names a column, there the text without these lines (a null text's is empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(doc_id).alias("_id"), body.alias("_text"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.col(host).isNull().alias("_nohost"), F.xxhash64(body, F.octet_length(body)).alias("_key"))
    texts = rows.select(*HOST, "_id", "_key", "_text")
    places = places_of(texts, frequent_lines(texts, max_docs))

    judged = base_metrics(rows, "_text")
    if clean:  # texts are dealt at any size, so that a run does not change its way where a broadcast would end
        places = places.hint("merge")
    judged = (judged if clean else judged.drop("_text")).join(places, [*HOST, "_key"], "left")
    gone = F.filter("_cut", lambda s: ~s["first"].eqNullSafe(F.col("_id")))
    removed = F.coalesce(F.aggregate(gone, F.lit(0).cast("long"), lambda n, s: n + s["words"]), F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    at = F.transform(gone, lambda s: s["place"])
    left = F.array_join(F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains(at, i)), "\n")
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        removed.alias("n_removed_words"),
        (~failed & (removed <= depleted * F.col("n_words"))).alias("kept"),
        *([F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(left).alias(clean)] if clean else []),
    )
