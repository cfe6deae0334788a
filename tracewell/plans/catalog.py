"""Registered queries over the projected tables, each with the SQL it must agree with.

Doubles are rounded, since sums depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import emissions as em
from ..functions import sequences as sq
from ..functions import splines
from ..operators import anchors, calls, metrics, priors, scaling, windows
from .projection import MODEL, SEQUENCES, SERIES, K, kmer_model, sequences, series, with_sql
from . import alignments, coordinates, mixtures, posteriors, results  # noqa: F401  register their queries
from .projection import anchors as anchor_pairs
from .registry import query, table

S = with_sql(SERIES)
SM = with_sql(SERIES, MODEL)
SQ = with_sql(SERIES, SEQUENCES)
DIGITS = " + ".join(f"(instr('ACEGT', substr(kmer, {i + 1}, 1)) - 1) * {5 ** (2 - i)}" for i in range(3))


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir)
    return s.join(kmer_model(s), "kmer")


# --- sequences -----------------------------------------------------------------------------------------------------


@query("kmer_explode", "SELECT item_id, pos, substr(text, CAST(pos AS BIGINT) + 1, 5) AS kmer FROM (SELECT item_id, text, unnest(range(0, length(text) - 4)) AS pos FROM benchmark)")
def kmer_explode(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sq.kmers(F.col("text"), 5)).alias("pos", "kmer")).select("item_id", F.col("pos").cast("long").alias("pos"), "kmer")


@query("kmer_distinct", "SELECT kmer, count(*) AS n FROM (SELECT substr(text, CAST(pos AS BIGINT) + 1, 3) AS kmer FROM (SELECT text, unnest(range(0, length(text) - 2)) AS pos FROM documents)) GROUP BY kmer")
def kmer_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(sq.kmers(F.col("text"), 3)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("kmer_rank", S + f"SELECT kmer, CAST({DIGITS} AS BIGINT) AS kmer_id, count(*) AS n FROM series WHERE kmer IS NOT NULL GROUP BY kmer")
def kmer_rank(spark, sf_dir):
    s = series(spark, sf_dir).where("kmer is not null").groupBy("kmer").agg(F.count("*").alias("n"))
    return s.select("kmer", sq.kmer_rank(F.col("kmer"), sq.METHYL, K).alias("kmer_id"), "n")


@query("all_words", "SELECT CAST(id AS BIGINT) AS id, substr('ACEGT', CAST(id // 25 AS BIGINT) + 1, 1) || substr('ACEGT', CAST(id // 5 % 5 AS BIGINT) + 1, 1) || substr('ACEGT', CAST(id % 5 AS BIGINT) + 1, 1) AS word FROM range(125) t(id)")
def all_words(spark, sf_dir):
    return spark.range(len(sq.METHYL) ** K).select("id", sq.rank_kmer(F.col("id"), sq.METHYL, K).alias("word"))


@query("multiset_rank", S + "SELECT kmer, comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS BIGINT) AS multiset_id FROM (SELECT DISTINCT kmer, array_to_string(list_sort(string_split(kmer, '')), '') AS comp FROM series WHERE kmer IS NOT NULL)")
def multiset_rank(spark, sf_dir):
    k = series(spark, sf_dir).where("kmer is not null").select("kmer").distinct().withColumn("comp", sq.multiset(F.col("kmer")))
    ranks = k.select("comp").distinct().withColumn("multiset_id", (F.row_number().over(Window.orderBy("comp")) - 1).cast("long"))  # at most the multisets of the alphabet
    return k.join(F.broadcast(ranks), "comp").select("kmer", "comp", "multiset_id")


@query("composition", S + "SELECT kmer, translate(array_to_string(list_sort(string_split(translate(kmer, 'ACEGT', '01102'), '')), ''), '012', 'RYZ') AS grouped, substr(kmer, 2, 1) AS middle, CAST(length(kmer) - length(translate(kmer, 'AG', '')) AS BIGINT) AS purines FROM (SELECT DISTINCT kmer FROM series WHERE kmer IS NOT NULL)")
def composition(spark, sf_dir):
    k = series(spark, sf_dir).where("kmer is not null").select("kmer").distinct()
    grouped = F.translate(sq.multiset(F.translate("kmer", "ACEGT", "01102")), "012", "RYZ")
    return k.select("kmer", grouped.alias("grouped"), sq.at(F.col("kmer"), 1, 1).alias("middle"), (F.length("kmer") - F.length(F.translate("kmer", "AG", ""))).cast("long").alias("purines"))


@query("strand_sequences", SQ + "SELECT read_id, sequence, translate(sequence, 'ACGTE', 'TGCAG') AS complement, reverse(translate(sequence, 'ACGTE', 'TGCAG')) AS reverse_complement FROM seqs")
def strand_sequences(spark, sf_dir):
    s = F.col("sequence")
    return sequences(series(spark, sf_dir)).select("read_id", s, sq.complement(s).alias("complement"), sq.reverse_complement(s).alias("reverse_complement"))


@query("motif_positions", SQ + "SELECT read_id, CAST(pos AS BIGINT) AS pos, substr(sequence, 1, CAST(pos AS BIGINT)) || 'XG' || substr(sequence, CAST(pos AS BIGINT) + 3) AS substituted FROM (SELECT *, unnest(range(0, length(sequence) - 1)) AS pos FROM seqs) WHERE substr(sequence, CAST(pos AS BIGINT) + 1, 2) = 'CG'")
def motif_positions(spark, sf_dir):
    hits = sequences(series(spark, sf_dir)).select("read_id", "sequence", F.explode(sq.motif_positions(F.col("sequence"), "CG")).alias("pos"))
    return hits.select("read_id", F.col("pos").cast("long").alias("pos"), F.overlay("sequence", F.lit("XG"), F.col("pos") + 1, F.lit(2)).alias("substituted"))


@query("strided_mask", "SELECT item_id, CAST(s AS BIGINT) AS register, string_agg(CASE WHEN (i - 1) % 4 = s THEN 'X' ELSE substr(text, CAST(i AS BIGINT), 1) END, '' ORDER BY i) AS masked FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark), range(4) t(s) GROUP BY item_id, s")
def strided_mask(spark, sf_dir):
    refs = table(spark, sf_dir, "benchmark").withColumn("register", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return refs.select("item_id", F.col("register").cast("long").alias("register"), sq.strided_mask(F.col("text"), 4, F.col("register")).alias("masked"))


_OPT = "(SELECT * FROM (VALUES ('C'), ('E'), ('O')) t(o))"


@query("path_expand", S + f", k AS (SELECT DISTINCT translate(kmer, 'C', 'X') AS kmer FROM series WHERE kmer IS NOT NULL) SELECT kmer, a.o || b.o || c.o AS path FROM k, LATERAL (SELECT o FROM {_OPT} WHERE substr(kmer, 1, 1) = 'X' UNION ALL SELECT substr(kmer, 1, 1) WHERE substr(kmer, 1, 1) <> 'X') a, LATERAL (SELECT o FROM {_OPT} WHERE substr(kmer, 2, 1) = 'X' UNION ALL SELECT substr(kmer, 2, 1) WHERE substr(kmer, 2, 1) <> 'X') b, LATERAL (SELECT o FROM {_OPT} WHERE substr(kmer, 3, 1) = 'X' UNION ALL SELECT substr(kmer, 3, 1) WHERE substr(kmer, 3, 1) <> 'X') c")
def path_expand(spark, sf_dir):
    k = series(spark, sf_dir).where("kmer is not null").select(F.translate("kmer", "C", "X").alias("kmer")).distinct()
    return k.select("kmer", F.explode(sq.expand_ambiguous(F.col("kmer"), K, sq.OPTIONS["cytosine3"])).alias("path"))


@query("cigar_parse", S + ", c AS (SELECT read_id, string_agg(CAST(event_index % 9 + 1 AS VARCHAR) || CASE base WHEN 'A' THEN 'M' WHEN 'C' THEN 'I' WHEN 'E' THEN 'D' WHEN 'G' THEN 'M' ELSE 'S' END, '' ORDER BY event_index) AS cigar FROM series GROUP BY read_id) SELECT read_id, CAST(sum(CASE WHEN instr('MDN=X', op) > 0 THEN n ELSE 0 END) AS BIGINT) AS reference_span, CAST(sum(CASE WHEN instr('MI=X', op) > 0 THEN n ELSE 0 END) AS BIGINT) AS query_span FROM (SELECT read_id, CAST(regexp_extract(x, '\\d+') AS BIGINT) AS n, right(x, 1) AS op FROM (SELECT read_id, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS x FROM c)) GROUP BY read_id")
def cigar_parse(spark, sf_dir):
    op = F.concat(((F.col("event_index") % 9) + 1).cast("string"), F.translate("base", "ACEGT", "MIDMS"))
    c = series(spark, sf_dir).groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_index", op.alias("op")))), lambda x: x["op"]), "").alias("cigar"))
    ops = sq.cigar_ops(F.col("cigar"))
    return c.select("read_id", sq.cigar_span(ops, "MDN=X").alias("reference_span"), sq.cigar_span(ops, "MI=X").alias("query_span"))


@query("kmer_overlap_shift", S + "SELECT read_id, event_index, CAST(CASE WHEN substr(a, 2, 2) = substr(kmer, 1, 2) THEN 1 WHEN substr(a, 3, 1) = substr(kmer, 1, 1) THEN 2 ELSE 3 END AS BIGINT) AS shift FROM (SELECT read_id, event_index, kmer, lag(kmer, 2) OVER (PARTITION BY read_id ORDER BY event_index) AS a FROM series) WHERE a IS NOT NULL AND kmer IS NOT NULL")
def kmer_overlap_shift(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("event_index")
    s = series(spark, sf_dir).select("read_id", "event_index", "kmer", F.lag("kmer", 2).over(w).alias("a")).where("a is not null and kmer is not null")
    return s.select("read_id", "event_index", sq.overlap_shift(F.col("a"), F.col("kmer"), K).cast("long").alias("shift"))


@query("assembled_reads", S + """, d AS (SELECT read_id, event_index, kmer, lag(kmer) OVER (PARTITION BY read_id ORDER BY event_index) AS a FROM series WHERE kmer IS NOT NULL AND event_id % 5 <> 0)
SELECT read_id, string_agg(CASE WHEN a IS NULL THEN kmer WHEN a = kmer THEN '' WHEN substr(a, 2, 2) = substr(kmer, 1, 2) THEN right(kmer, 1) WHEN substr(a, 3, 1) = substr(kmer, 1, 1) THEN right(kmer, 2) ELSE kmer END, '' ORDER BY event_index) AS sequence FROM d GROUP BY read_id""")
def assembled_reads(spark, sf_dir):
    """Reads put together from their events' k-mers where a fifth of the events is missing."""
    return windows.assemble(series(spark, sf_dir).where("kmer is not null and event_id % 5 <> 0"), K)


@query("reference_positions", S + "SELECT event_id, CASE WHEN (strand = 't') = forward THEN ref_pos + 7 ELSE 97 - (ref_pos + 93) END AS position, CASE WHEN (strand = 't') = forward THEN kmer ELSE reverse(translate(kmer, 'ACGTE', 'TGCAG')) END AS ref_kmer FROM series")
def reference_positions(spark, sf_dir):
    st, fw = F.col("strand"), F.col("forward")
    return series(spark, sf_dir).select("event_id", sq.reference_position(F.col("ref_pos"), F.lit(7), F.lit(100), K, st, fw).cast("long").alias("position"), sq.strand_kmer(F.col("kmer"), st, fw).alias("ref_kmer"))


@query("label_translate", S + "SELECT translate(kmer, 'C', 'E') AS label_kmer, strand, count(*) AS n FROM series WHERE kmer IS NOT NULL AND contains(kmer, 'C') GROUP BY ALL")
def label_translate(spark, sf_dir):
    s = series(spark, sf_dir).where(F.contains("kmer", F.lit("C")))
    return s.groupBy(F.translate("kmer", "C", "E").alias("label_kmer"), "strand").agg(F.count("*").alias("n"))


# --- filters and joins ---------------------------------------------------------------------------------------------


@query("posterior_threshold", S + "SELECT event_id, floor(least(posterior, 1.0) * 1e7)::BIGINT / 1e7::DOUBLE AS p FROM series WHERE posterior >= 0.25")
def posterior_threshold(spark, sf_dir):
    return series(spark, sf_dir).where("posterior >= 0.25D").select("event_id", em.fixed_point(F.col("posterior")).alias("p"))


@query("kmer_values", S + "SELECT event_id, kmer, mean FROM series WHERE strand = 't' AND posterior >= 0.1 AND kmer IS NOT NULL AND ref_pos NOT IN (SELECT ref_pos FROM series WHERE base = 'G' GROUP BY ref_pos HAVING count(*) > (SELECT count(*) / 500 FROM series))")
def kmer_values(spark, sf_dir):
    s = series(spark, sf_dir)
    dense = s.where("base = 'G'").groupBy("ref_pos").agg(F.count("*").alias("n")).join(F.broadcast(s.agg((F.count("*") / 500).alias("t"))), F.col("n") > F.col("t"))
    return s.where("strand = 't' and posterior >= 0.1D and kmer is not null").join(dense, "ref_pos", "left_anti").select("event_id", "kmer", "mean")


@query("covers_region", S + "SELECT read_id, lo, hi FROM (SELECT read_id, min(ref_pos) AS lo, max(ref_pos) AS hi FROM series GROUP BY read_id) x WHERE EXISTS (SELECT 1 FROM (SELECT least(r_regionkey * 7, r_regionkey * 7 + 60) AS a, r_regionkey * 7 + 60 AS b FROM region) g WHERE lo <= a AND hi >= b)")
def covers_region(spark, sf_dir):
    span = series(spark, sf_dir).groupBy("read_id").agg(F.min("ref_pos").alias("lo"), F.max("ref_pos").alias("hi"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 7).alias("a"), (F.col("r_regionkey") * 7 + 60).alias("b"))
    return span.join(regions, (F.col("lo") <= F.col("a")) & (F.col("hi") >= F.col("b")), "left_semi")


@query("legal_transitions", S + ", k AS (SELECT DISTINCT kmer FROM series WHERE kmer IS NOT NULL) SELECT x.kmer AS a, y.kmer AS b FROM k x JOIN k y ON substr(x.kmer, 2) = substr(y.kmer, 1, 2)")
def legal_transitions(spark, sf_dir):
    k = series(spark, sf_dir).where("kmer is not null").select("kmer").distinct()
    left, right = k.select(F.col("kmer").alias("a"), sq.at(F.col("kmer"), 1, 2).alias("o")), k.select(F.col("kmer").alias("b"), sq.at(F.col("kmer"), 0, 2).alias("o"))
    return left.join(right, "o").select("a", "b")


@query("model_lookup", SM + "SELECT event_id, coalesce(round(level_mean, 9), 0) AS level_mean FROM series LEFT JOIN model USING (kmer)")
def model_lookup(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.join(kmer_model(s), "kmer", "left").select("event_id", F.coalesce(r("level_mean", 9), F.lit(0.0)).alias("level_mean"))


_MONO = S + """, d AS (SELECT DISTINCT read_id, ref_pos AS x, event_index AS y FROM series),
m AS (SELECT *, max(x) OVER b AS x0, max(y) OVER b AS y0, min(x) OVER a AS x1, min(y) OVER a AS y1 FROM d
  WINDOW b AS (PARTITION BY read_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY read_id ORDER BY x, y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
mono AS (SELECT read_id, x, y FROM m WHERE coalesce(x > x0 AND y > y0, true) AND coalesce(x < x1 AND y < y1, true))
"""


@query("monotone_anchors", _MONO + "SELECT * FROM mono")
def monotone_anchors(spark, sf_dir):
    return anchors.monotone(anchor_pairs(series(spark, sf_dir)))


@query("split_points", S + """, d AS (SELECT read_id, max(ref_pos) OVER (PARTITION BY read_id ORDER BY event_index) + event_index AS x, event_index AS y, event_id FROM series),
f AS (SELECT *, CASE WHEN (x - lag(x) OVER w) * (y - lag(y) OVER w) > 12 THEN 1 ELSE 0 END AS s FROM d WINDOW w AS (PARTITION BY read_id ORDER BY x, y))
SELECT read_id, block, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n_anchors FROM (SELECT *, CAST(sum(s) OVER (PARTITION BY read_id ORDER BY x, y) AS BIGINT) AS block FROM f) GROUP BY read_id, block""")
def split_points(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("event_index")
    chain = series(spark, sf_dir).select("read_id", (F.max("ref_pos").over(w) + F.col("event_index")).alias("x"), F.col("event_index").alias("y"))
    return anchors.block_bounds(anchors.split_blocks(chain, 12))


@query("anchor_remap", S + ", em AS (SELECT read_id, event_index // 2 AS y, max(event_index) AS e FROM series GROUP BY ALL) SELECT s.read_id, s.ref_pos AS x, em.e AS y FROM series s JOIN em ON em.read_id = s.read_id AND em.y = s.event_index")
def anchor_remap(spark, sf_dir):
    s = series(spark, sf_dir)
    event_map = s.groupBy("read_id", F.expr("event_index div 2").alias("base_pos")).agg(F.max("event_index").alias("event_index"))
    return anchors.remap(anchor_pairs(s), event_map)


@query("cigar_to_anchors", S + """, o AS (SELECT read_id, event_index AS op_index, event_id % 12 + 1 AS n, CASE base WHEN 'C' THEN 'I' WHEN 'E' THEN 'D' ELSE 'M' END AS op FROM series),
p AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER w, 0) AS x, coalesce(sum(CASE WHEN op IN ('M', 'I') THEN n ELSE 0 END) OVER w, 0) AS y FROM o WINDOW w AS (PARTITION BY read_id ORDER BY op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT read_id, CAST(x + i AS BIGINT) AS x, CAST(y + i AS BIGINT) AS y FROM (SELECT *, unnest(range(3, n - 3)) AS i FROM p WHERE op = 'M' AND n > 6)""")
def cigar_to_anchors(spark, sf_dir):
    ops = series(spark, sf_dir).select("read_id", F.col("event_index").alias("op_index"), (F.col("event_id") % 12 + 1).alias("n"), F.translate("base", "ACEGT", "MIDMM").alias("op"), F.lit(0).alias("x_start"), F.lit(0).alias("y_start"))
    return anchors.from_cigar(ops, 3)


_REFERENCE = "ref AS (SELECT string_agg(base, '' ORDER BY ref_pos) AS sequence FROM (SELECT ref_pos, base FROM series WHERE base IS NOT NULL AND ref_pos IS NOT NULL GROUP BY ref_pos, base QUALIFY row_number() OVER (PARTITION BY ref_pos ORDER BY count(*) DESC, base) = 1))"


def reference(s: DataFrame) -> DataFrame:
    """contig, sequence: each position's most frequent base, ties to the first letter. One row, as long as there are positions."""
    n = s.where("base is not null and ref_pos is not null").groupBy("ref_pos", "base").agg(F.count("*").alias("n"))
    top = n.groupBy("ref_pos").agg(F.min_by("base", F.struct(-F.col("n"), F.col("base"))).alias("base"))
    return top.groupBy(F.lit("ref").alias("contig")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ref_pos", "base"))), lambda x: x["base"]), "").alias("sequence"))


@query("seed_anchors", SQ + f", {_REFERENCE}" + """,
ka AS (SELECT substr(sequence, CAST(pos AS BIGINT) + 1, 5) AS kmer, CAST(min(pos) AS BIGINT) AS x FROM (SELECT *, unnest(range(0, length(sequence) - 4)) AS pos FROM ref) GROUP BY kmer HAVING count(*) = 1),
kb AS (SELECT read_id, substr(sequence, CAST(pos AS BIGINT) + 1, 5) AS kmer, CAST(min(pos) AS BIGINT) AS y FROM (SELECT *, unnest(range(0, length(sequence) - 4)) AS pos FROM seqs) GROUP BY read_id, kmer HAVING count(*) = 1)
SELECT read_id, x, y, kmer FROM ka JOIN kb USING (kmer)""")
def seed_anchors(spark, sf_dir):
    """Five-mers that a read and the reference each have once."""
    s = series(spark, sf_dir)
    found = anchors.seeds(reference(s).select(F.col("contig").alias("id"), "sequence"), sequences(s).select(F.col("read_id").alias("id"), "sequence"), 5)
    return found.select(F.col("id_b").alias("read_id"), "x", "y", "kmer")


@query("corrected_reference", S + f", {_REFERENCE}" + """, c AS (SELECT ref_pos, base FROM series WHERE base IS NOT NULL AND ref_pos IS NOT NULL GROUP BY ref_pos, base QUALIFY row_number() OVER (PARTITION BY ref_pos ORDER BY round(sum(posterior), 6) DESC NULLS LAST, base) = 1)
SELECT CAST(g AS BIGINT) AS register, string_agg(CASE WHEN i % 4 = g THEN coalesce(base, 'X') ELSE substr(sequence, CAST(i AS BIGINT) + 1, 1) END, '' ORDER BY i) AS sequence
FROM (SELECT sequence, unnest(range(0, length(sequence))) AS i FROM ref) r CROSS JOIN range(4) t(g) LEFT JOIN c ON c.ref_pos = i GROUP BY g""")
def corrected_reference(spark, sf_dir):
    """Every register's degenerate reference, its masked places filled with the calls of the largest summed posterior."""
    s = series(spark, sf_dir)
    sums = s.where("base is not null and ref_pos is not null").groupBy("ref_pos", "base").agg(F.coalesce(r(F.sum("posterior")), F.lit(-1.0)).alias("p"))
    called = sums.groupBy("ref_pos").agg(F.min_by("base", F.struct(-F.col("p"), F.col("base"))).alias("call"))
    masked = reference(s).withColumn("register", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    masked = masked.select(F.col("register").alias("contig"), sq.strided_mask(F.col("sequence"), 4, F.col("register").cast("int")).alias("sequence"))
    at = called.withColumn("contig", F.pmod("ref_pos", F.lit(4)))
    return calls.apply_calls(masked, at).select(F.col("contig").alias("register"), "sequence")


@query("ancestor_fallback", SM + ", nodes AS (SELECT DISTINCT kmer FROM series WHERE kmer IS NOT NULL), v1 AS (SELECT substr(kmer, 1, 1) AS g, round(avg(level_mean), 9) AS v FROM model GROUP BY 1) SELECT n.kmer AS node, coalesce(round(CASE WHEN m.n >= 90 THEN m.level_mean END, 9), v1.v) AS value FROM nodes n LEFT JOIN model m USING (kmer) LEFT JOIN v1 ON v1.g = substr(n.kmer, 1, 1)")
def ancestor_fallback(spark, sf_dir):
    s = series(spark, sf_dir)
    m = kmer_model(s)
    tree = s.where("kmer is not null").select(F.col("kmer").alias("node"), F.substring("kmer", 1, 1).alias("parent")).distinct()
    values = m.where("n >= 90").select(F.col("kmer").alias("node"), r("level_mean", 9).alias("value")).unionAll(m.groupBy(F.substring("kmer", 1, 1).alias("node")).agg(r(F.avg("level_mean"), 9).alias("value")))
    return metrics.with_fallback(values, tree)


@query("unmapped_reads", S + "SELECT DISTINCT read_id FROM series WHERE read_id NOT IN (SELECT read_id FROM series WHERE ref_pos = 5)")
def unmapped_reads(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("read_id").distinct().join(s.where("ref_pos = 5").select("read_id").distinct(), "read_id", "left_anti")


# --- windows -------------------------------------------------------------------------------------------------------

_MOVES = S + ", mv AS (SELECT read_id, event_index, CASE WHEN event_index = 0 THEN 1 ELSE event_id % 2 END AS move, posterior AS p FROM series)"


@query("event_map_1d", _MOVES + ", a AS (SELECT read_id, event_index, CAST(sum(move) OVER w AS BIGINT) AS base_pos, move > 0 OR p > lag(p, 1, 0.0) OVER w AS take FROM mv WINDOW w AS (PARTITION BY read_id ORDER BY event_index)) SELECT read_id, base_pos, max(event_index) AS event_index FROM a WHERE take GROUP BY read_id, base_pos")
def event_map_1d(spark, sf_dir):
    s = series(spark, sf_dir).select("read_id", "event_index", F.when(F.col("event_index") == 0, 1).otherwise(F.col("event_id") % 2).cast("long").alias("move"), F.col("posterior").alias("p"))
    return windows.event_map_1d(s)


@query("event_map_gapfill", S + "SELECT read_id, event_index, coalesce(last_value(CASE WHEN base <> 'T' THEN event_id END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried, coalesce(first_value(CASE WHEN base <> 'T' THEN event_id END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY event_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), -1) AS next FROM series")
def event_map_gapfill(spark, sf_dir):
    known = F.when(F.col("base") != "T", F.col("event_id"))
    s = series(spark, sf_dir).select("read_id", "event_index", known.alias("carried"), known.alias("next"))
    return windows.fill_event_map(windows.fill_event_map(s, "event_index", "carried"), "event_index", "next", backward=True).fillna(-1, ["carried", "next"])


@query("site_groups", S + """, t AS (SELECT read_id, ref_pos, max(posterior) AS delta FROM series GROUP BY ALL),
g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY read_id ORDER BY ref_pos) AS BIGINT) AS group_id FROM (SELECT *, CASE WHEN ref_pos - lag(ref_pos) OVER (PARTITION BY read_id ORDER BY ref_pos) >= 6 THEN 1 ELSE 0 END AS f FROM t))
SELECT read_id, group_id, ref_pos, round(delta, 6) AS delta FROM g QUALIFY row_number() OVER (PARTITION BY read_id, group_id ORDER BY delta DESC, ref_pos) = 1""")
def site_groups(spark, sf_dir):
    sites = series(spark, sf_dir).groupBy("read_id", "ref_pos").agg(F.max("posterior").alias("delta"))
    best = windows.best_of_groups(windows.gap_groups(sites, "ref_pos", 6, ["read_id"]), "ref_pos", "delta", ["read_id"])
    return best.select("read_id", "group_id", "ref_pos", r("delta").alias("delta"))


@query("first_increases", S + "SELECT read_id, event_index, ref_pos FROM (SELECT *, max(ref_pos) OVER (PARTITION BY read_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM series) WHERE m IS NULL OR ref_pos > m")
def first_increases(spark, sf_dir):
    return windows.first_increases(series(spark, sf_dir), ["event_index"], "ref_pos").select("read_id", "event_index", "ref_pos")


@query("drift_adjust", S + "SELECT event_id, round(mean - start * 1e-7, 6) AS adjusted FROM series")
def drift_adjust(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", r(windows.remove_drift(F.col("mean"), F.col("start"), F.lit(1e-7))).alias("adjusted"))


@query("cap_collect", S + ", f AS (SELECT strand, read_id, count(*) AS n FROM series WHERE base = 'C' GROUP BY ALL) SELECT strand, read_id, n FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY strand ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) WHERE b < 500")
def cap_collect(spark, sf_dir):
    f = series(spark, sf_dir).where("base = 'C'").groupBy("strand", "read_id").agg(F.count("*").alias("n"))
    return windows.capped(f, "n", 500, "read_id", ["strand"])


@query("cdf_prefix", S + "SELECT event_id, round(sum(mean) OVER (PARTITION BY read_id ORDER BY event_index) / sum(mean) OVER (PARTITION BY read_id), 6) AS cdf FROM series")
def cdf_prefix(spark, sf_dir):
    return windows.cumulative(series(spark, sf_dir), "mean", ["event_index"], "read_id").select("event_id", r("cdf").alias("cdf"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("kmer_model", SM + "SELECT kmer, n, round(level_mean, 9) AS level_mean, round(level_sd, 6) AS level_sd, round(noise_mean, 9) AS noise_mean, round(noise_sd, 6) AS noise_sd, round(noise_lambda, 3) AS noise_lambda FROM model")
def kmer_model_query(spark, sf_dir):
    m = kmer_model(series(spark, sf_dir))
    return m.select("kmer", "n", r("level_mean", 9).alias("level_mean"), r("level_sd").alias("level_sd"), r("noise_mean", 9).alias("noise_mean"), r("noise_sd", 6).alias("noise_sd"), r("noise_lambda", 3).alias("noise_lambda"))


_P = ", ".join(f"coalesce(sum(posterior) FILTER (base = '{b}'), 0) / nullif(sum(posterior), 0) AS p{b}" for b in sq.METHYL)
_R = ", ".join(f"round(p{b}, 6) AS p{b}" for b in sq.METHYL)


@query("site_marginals", S + f"SELECT ref_pos, strand, {_R} FROM (SELECT ref_pos, strand, {_P} FROM series GROUP BY ref_pos, strand)")
def site_marginals(spark, sf_dir):
    c = calls.site_marginals(series(spark, sf_dir), sq.METHYL, ["ref_pos", "strand"])
    return c.select("ref_pos", "strand", *[r(f"p{b}").alias(f"p{b}") for b in sq.METHYL])


_ALONG = "(strand = 't') = forward"
_SWAP = {"A": "T", "C": "G", "G": "C", "T": "A", "E": "E"}
_SUMS = ", ".join(f"sum(CASE WHEN {_ALONG} THEN p{b} ELSE p{_SWAP[b]} END) AS s{b}" for b in sq.METHYL)
_TOT = " + ".join(f"s{b}" for b in sq.METHYL)
_SH = ", ".join(f"s{b} / nullif({_TOT}, 0) AS p{b}" for b in sq.METHYL)
_TOP = "greatest(" + ", ".join(f"round(p{b}, 9)" for b in sq.METHYL) + ")"
_CALL = "CASE " + " ".join(f"WHEN round(p{b}, 9) = {_TOP} THEN '{b}'" for b in sq.METHYL) + " END"


@query("site_consensus", S + f", c AS (SELECT ref_pos, strand, read_id, forward, {_P} FROM series GROUP BY ALL), z AS (SELECT ref_pos, count(*) AS depth, {_SUMS} FROM c GROUP BY ref_pos HAVING count(*) >= 2) SELECT ref_pos, depth, {_R}, {_CALL} AS call FROM (SELECT ref_pos, depth, {_SH} FROM z)")
def site_consensus(spark, sf_dir):
    c = calls.site_marginals(series(spark, sf_dir), sq.METHYL, ["ref_pos", "strand", "read_id", "forward"])
    out = calls.consensus(c, sq.METHYL, min_depth=2)
    return out.select("ref_pos", "depth", *[r(f"p{b}").alias(f"p{b}") for b in sq.METHYL], "call")


@query("read_score", S + "SELECT read_id, strand, round(100 * avg(posterior), 6) AS score, count(*) AS n FROM series GROUP BY ALL")
def read_score(spark, sf_dir):
    return series(spark, sf_dir).groupBy("read_id", "strand").agg(r(100 * F.avg("posterior")).alias("score"), F.count("*").alias("n"))


_W = "w AS (SELECT read_id, count(*) AS n, sum(1/(level_sd*level_sd)) AS w, sum(level_mean/(level_sd*level_sd)) AS wx, sum(level_mean*level_mean/(level_sd*level_sd)) AS wxx, sum(mean/(level_sd*level_sd)) AS wy, sum(level_mean*mean/(level_sd*level_sd)) AS wxy FROM series JOIN model USING (kmer) GROUP BY read_id)"


@query("wls_scale_shift", SM + f", {_W} SELECT read_id, n, round((wy*wxx-wx*wxy)/(w*wxx-wx*wx), 4) AS shift, round((w*wxy-wy*wx)/(w*wxx-wx*wx), 4) AS scale FROM w WHERE w*wxx-wx*wx > 1e-9")
def wls_scale_shift(spark, sf_dir):
    fit = scaling.scale_shift(with_model(spark, sf_dir))
    return fit.where("shift is not null").select("read_id", "n", r("shift", 4).alias("shift"), r("scale", 4).alias("scale"))


@query("wls_noise", SM + ", w AS (SELECT read_id, sum(q) AS w, sum(q*noise_mean) AS wx, sum(q*noise_mean*noise_mean) AS wxx, sum(q*stdv) AS wy, sum(q*noise_mean*stdv) AS wxy FROM (SELECT *, noise_lambda/pow(noise_mean, 3) AS q FROM series JOIN model USING (kmer)) GROUP BY read_id) SELECT read_id, round((wy*wxx-wx*wxy)/(w*wxx-wx*wx), 4) AS shift_sd, round((w*wxy-wy*wx)/(w*wxx-wx*wx), 4) AS scale_sd FROM w WHERE w*wxx-wx*wx > 1e-9")
def wls_noise(spark, sf_dir):
    fit = scaling.noise_scale_shift(with_model(spark, sf_dir)).where("shift_sd is not null")
    return fit.select("read_id", r("shift_sd", 4).alias("shift_sd"), r("scale_sd", 4).alias("scale_sd"))


@query("wls_drift", SM + """, d AS (SELECT read_id, 1 / (level_sd * level_sd) AS w, level_mean AS x, start / 1e6 AS t, mean AS y FROM series JOIN model USING (kmer)),
c AS (SELECT read_id, sum(w * x) / sum(w) AS mx, sum(w * t) / sum(w) AS mt, sum(w * y) / sum(w) AS my, count(*) AS n FROM d GROUP BY read_id),
s AS (SELECT read_id, n, mx, mt, my, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (x - mx) * (t - mt)) AS xt, sum(w * (t - mt) * (t - mt)) AS tt, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (t - mt) * (y - my)) AS ty FROM d JOIN c USING (read_id) GROUP BY ALL),
f AS (SELECT *, (xy * tt - xt * ty) / nullif(xx * tt - xt * xt, 0) AS scale, (xx * ty - xy * xt) / nullif(xx * tt - xt * xt, 0) AS drift FROM s)
SELECT read_id, n, round(my - scale * mx - drift * mt, 3) AS shift, round(scale, 3) AS scale, round(drift, 3) AS drift FROM f""")
def wls_drift(spark, sf_dir):
    rows = with_model(spark, sf_dir).withColumn("start", F.col("start") / 1e6)
    return scaling.scale_shift_drift(rows).select("read_id", "n", r("shift", 3).alias("shift"), r("scale", 3).alias("scale"), r("drift", 3).alias("drift"))


@query("transition_norm", S + "SELECT a, b, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM (SELECT base AS b, lag(base) OVER (PARTITION BY read_id ORDER BY event_index) AS a, count(*) AS n FROM (SELECT * FROM series) GROUP BY ALL) WHERE a IS NOT NULL".replace("SELECT base AS b, lag(base) OVER (PARTITION BY read_id ORDER BY event_index) AS a, count(*) AS n FROM (SELECT * FROM series) GROUP BY ALL", "SELECT a, b, count(*) AS n FROM (SELECT base AS b, lag(base) OVER (PARTITION BY read_id ORDER BY event_index) AS a FROM series) GROUP BY a, b"))
def transition_norm(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("event_index")
    t = series(spark, sf_dir).select(F.lag("base").over(w).alias("a"), F.col("base").alias("b")).where("a is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return calls.normalised(t, "n", ["a"], "p").select("a", "b", r("p").alias("p"))


@query("emission_mstep", S + "SELECT kmer, round(u, 6) AS level_mean, round(sqrt(greatest(q / nullif(p, 0) - u * u, 0)), 4) AS level_sd FROM (SELECT kmer, sum(posterior) AS p, sum(posterior * mean) / nullif(sum(posterior), 0) AS u, sum(posterior * mean * mean) AS q FROM series WHERE kmer IS NOT NULL GROUP BY kmer)")
def emission_mstep(spark, sf_dir):
    p, x = F.col("posterior"), F.col("mean")
    s = series(spark, sf_dir).where("kmer is not null").groupBy("kmer").agg(F.sum(p).alias("p"), (F.sum(p * x) / F.nullif(F.sum(p), F.lit(0.0))).alias("u"), F.sum(p * x * x).alias("q"))
    return s.select("kmer", r("u").alias("level_mean"), r(F.sqrt(F.greatest(F.col("q") / F.nullif(F.col("p"), F.lit(0.0)) - F.col("u") * F.col("u"), F.lit(0.0))), 4).alias("level_sd"))


@query("indel_probability", S + ", m AS (SELECT read_id, max(ref_pos) AS top FROM series GROUP BY read_id), spot AS (SELECT read_id, unnest(range(0, top + 1)) AS x FROM m) SELECT r.read_id, CAST(r.x AS BIGINT) AS ref_pos, round(greatest(0, 1 - coalesce(p, 0)), 6) AS p_indel FROM spot r LEFT JOIN (SELECT read_id, ref_pos, sum(posterior) / 2 AS p FROM series GROUP BY ALL) s ON s.read_id = r.read_id AND s.ref_pos = r.x")
def indel_probability(spark, sf_dir):
    """What pairs leave of each place of a read's span, from 0 to its last place."""
    s = series(spark, sf_dir)
    places = s.groupBy("read_id").agg(F.max("ref_pos").alias("top")).where("top >= 0").select("read_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("ref_pos"))
    sums = s.groupBy("read_id", "ref_pos").agg((F.sum("posterior") / 2).alias("p"))
    return places.join(sums, ["read_id", "ref_pos"], "left").select("read_id", "ref_pos", r(F.greatest(F.lit(0.0), 1 - F.coalesce("p", F.lit(0.0)))).alias("p_indel"))


@query("reweight_pairs", S + "SELECT event_id, round(posterior - 0.5 * (greatest(0, 1 - sum(posterior) OVER (PARTITION BY read_id, ref_pos)) + greatest(0, 1 - posterior)), 6) AS weight FROM series")
def reweight_pairs(spark, sf_dir):
    px = F.greatest(F.lit(0.0), 1 - F.sum("posterior").over(Window.partitionBy("read_id", "ref_pos")))
    return series(spark, sf_dir).select("event_id", r(F.col("posterior") - 0.5 * (px + F.greatest(F.lit(0.0), 1 - F.col("posterior")))).alias("weight"))


@query("nig_stats", S + "SELECT kmer, round(avg(mean), 6) AS mu, CAST(count(*) AS DOUBLE) AS nu, (count(*) - 1) / 2.0::DOUBLE AS alpha, round(var_pop(mean) * count(*) / 2, 2) AS beta FROM series WHERE kmer IS NOT NULL GROUP BY kmer")
def nig_stats(spark, sf_dir):
    g = scaling.gaussian_posterior(series(spark, sf_dir).where("kmer is not null"), "kmer", "mean")
    return g.select("kmer", r("mu").alias("mu"), "nu", "alpha", r("beta", 2).alias("beta"))


@query("substitutions", S + """, c AS (SELECT read_id, ref_pos, max_by(base, (posterior, event_id)) AS base FROM series WHERE posterior IS NOT NULL GROUP BY ALL),
n AS (SELECT ref_pos, base, count(*) AS n FROM c GROUP BY ALL)
SELECT a.base AS a, b.base AS b, CAST(sum(CASE WHEN a.base = b.base THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) AS BIGINT) AS pairs, count(*) AS columns FROM n a JOIN n b USING (ref_pos) WHERE a.base <= b.base GROUP BY ALL""")
def substitutions(spark, sf_dir):
    """Over all columns, how many pairs of reads have bases a and b there; from each column's base counts, not from pairs."""
    c = series(spark, sf_dir).where("posterior is not null").groupBy("read_id", "ref_pos").agg(F.max_by("base", F.struct("posterior", "event_id")).alias("base"))
    return calls.column_pairs(c, "ref_pos")


@query("upper_median", S + "SELECT kmer, list_sort(list(mean))[CAST(count(*) // 2 AS BIGINT) + 1] AS median, max(mean) AS top FROM series WHERE kmer IS NOT NULL GROUP BY kmer")
def upper_median(spark, sf_dir):
    """The element of rank n div 2, the upper of two middle ones."""
    s = series(spark, sf_dir).where("kmer is not null")
    w = Window.partitionBy("kmer")
    ranked = s.select("kmer", "mean", F.row_number().over(w.orderBy("mean")).alias("k"), F.count("*").over(w).alias("n"))
    return ranked.groupBy("kmer").agg(F.max(F.when(F.expr("k = n div 2 + 1"), F.col("mean"))).alias("median"), F.max("mean").alias("top"))


# --- densities -----------------------------------------------------------------------------------------------------


@query("emission_match", SM + "SELECT event_id, round(-0.9189385332046727 - ln(level_sd) - 0.5 * pow((mean - level_mean) / level_sd, 2), 6) AS level_logp, round((ln(noise_lambda) - ln(2 * pi()) - 3 * ln(stdv) - noise_lambda * pow((stdv - noise_mean) / noise_mean, 2) / stdv) / 2, 6) AS noise_logp FROM series JOIN model USING (kmer)")
def emission_match(spark, sf_dir):
    c = F.col
    return with_model(spark, sf_dir).select("event_id", r(em.log_gauss(c("mean"), c("level_mean"), c("level_sd"))).alias("level_logp"), r(em.log_inv_gauss(c("stdv"), c("noise_mean"), c("noise_lambda"))).alias("noise_logp"))


@query("descale", SM + "SELECT event_id, round((mean + 0.9 * level_mean - 1.1 * level_mean - 2.5) / 0.9, 9) AS descaled FROM series JOIN model USING (kmer)")
def descale(spark, sf_dir):
    return with_model(spark, sf_dir).select("event_id", r(em.descale(F.col("mean"), F.col("level_mean"), F.lit(1.1), F.lit(2.5), F.lit(0.9)), 9).alias("descaled"))


@query("skip_bins", SM + "SELECT event_id, CAST(least(floor(abs(level_mean - prev) / 0.5), 29) AS BIGINT) AS bin FROM (SELECT event_id, round(level_mean, 3) AS level_mean, lag(round(level_mean, 3)) OVER (PARTITION BY read_id ORDER BY event_index) AS prev FROM series JOIN model USING (kmer)) WHERE prev IS NOT NULL")
def skip_bins(spark, sf_dir):
    w = Window.partitionBy("read_id").orderBy("event_index")
    s = with_model(spark, sf_dir).withColumn("level_mean", r("level_mean", 3))
    return s.select("event_id", "level_mean", F.lag("level_mean").over(w).alias("prev")).where("prev is not null").select("event_id", em.skip_bin(F.col("level_mean"), F.col("prev")).alias("bin"))


@query("scaled_model", SM + "SELECT kmer, round(level_mean * 1.1 + 2.5, 9) AS level_mean, round(level_sd * 0.9, 7) AS level_sd, round(noise_mean * 1.2, 9) AS noise_mean, round(sqrt(pow(noise_mean * 1.2, 3) / (noise_lambda * 0.8)), 6) AS noise_sd FROM model")
def scaled_model(spark, sf_dir):
    m, c = kmer_model(series(spark, sf_dir)), F.col
    return m.select("kmer", r(c("level_mean") * 1.1 + 2.5, 9).alias("level_mean"), r(c("level_sd") * 0.9, 7).alias("level_sd"), r(c("noise_mean") * 1.2, 9).alias("noise_mean"), r(em.noise_sd(c("noise_mean") * 1.2, c("noise_lambda") * 0.8)).alias("noise_sd"))


@query("bivariate_gauss", SM + "SELECT event_id, round(-(a*a - 0.6*a*b + b*b) / (2 * 0.91) - ln(2 * pi() * level_sd * noise_sd * sqrt(0.91)), 6) AS logp FROM (SELECT *, (mean - level_mean) / level_sd AS a, (stdv - noise_mean) / noise_sd AS b FROM series JOIN model USING (kmer))")
def bivariate_gauss(spark, sf_dir):
    c = F.col
    return with_model(spark, sf_dir).select("event_id", r(em.log_bivariate_gauss(c("mean"), c("level_mean"), c("level_sd"), c("stdv"), c("noise_mean"), c("noise_sd"), 0.3)).alias("logp"))


@query("stay_durations", S + "SELECT event_id, round((event_index % 8) * ln(1.5) - 1.5 - ln(CAST(factorial(CAST(event_index % 8 AS INTEGER)) AS DOUBLE)), 6) AS logp FROM series")
def stay_durations(spark, sf_dir):
    return series(spark, sf_dir).select("event_id", r(em.log_poisson(F.col("event_index") % 8, 1.5)).alias("logp"))


_H = S + """, c AS (SELECT base, CAST(least(floor(mean / 10.0), 49) AS BIGINT) AS grid_ix, count(*) AS n FROM series WHERE mean >= 0 AND mean < 500 GROUP BY ALL),
t AS (SELECT base, sum(n) AS t FROM c GROUP BY base), density AS (SELECT t.base, CAST(i AS BIGINT) AS grid_ix, (i + 0.5) * 10 AS x, coalesce(n, 0) / (t * 10.0) AS pdf FROM t CROSS JOIN range(50) g(i) LEFT JOIN c ON c.base = t.base AND c.grid_ix = i)"""


@query("distribution_distances", _H + """, r AS (SELECT a.base AS a, b.base AS b, a.grid_ix, a.x, a.pdf AS p, b.pdf AS q FROM density a JOIN density b USING (grid_ix) WHERE a.base < b.base),
e AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN (p - q) * ln(p / q) ELSE 0 END AS kl, sqrt(p * q) AS bc, (p - q) * (p - q) AS sq, (CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM r),
s AS (SELECT a, b, sum(kl) AS kl, sum(bc) AS bc, sum(sq) AS sq, sum(js) AS js FROM (SELECT a, b, (kl + lag(kl) OVER w) * 5 AS kl, (bc + lag(bc) OVER w) * 5 AS bc, (sq + lag(sq) OVER w) * 5 AS sq, (js + lag(js) OVER w) * 5 AS js FROM e WINDOW w AS (PARTITION BY a, b ORDER BY grid_ix)) GROUP BY a, b)
SELECT a, b, round(kl, 6) AS kl, round(sqrt(greatest(1 - bc, 0)), 6) AS hellinger, round(sqrt(sq), 6) AS l2, round(sqrt(greatest(js, 0)), 6) AS jensen_shannon FROM s""")
def distribution_distances(spark, sf_dir):
    h = metrics.histogram(series(spark, sf_dir), "base", "mean", 10.0, 50)
    return metrics.distances(metrics.pairs(h, "base")).select("a", "b", *[r(c).alias(c) for c in ("kl", "hellinger", "l2", "jensen_shannon")])


@query("normal_distance", _H + """, m AS (SELECT base, avg(mean) AS mu, stddev_pop(mean) AS sd FROM series WHERE base IS NOT NULL GROUP BY base),
b AS (SELECT base, grid_ix, pdf AS p, exp(-0.5 * pow((x - mu) / sd, 2)) / (sd * sqrt(2 * pi())) AS q FROM density JOIN m USING (base)),
w AS (SELECT base, (bc + lag(bc) OVER o) * 5 AS bc, (sq + lag(sq) OVER o) * 5 AS sq FROM (SELECT *, sqrt(p * q) AS bc, (p - q) * (p - q) AS sq FROM b) WINDOW o AS (PARTITION BY base ORDER BY grid_ix))
SELECT base, round(sqrt(greatest(1 - sum(bc), 0)), 6) AS hellinger, round(sqrt(sum(sq)), 6) AS l2 FROM w GROUP BY base""")
def normal_distance(spark, sf_dir):
    """Each base's histogram against the normal density of its mean and deviation."""
    s = series(spark, sf_dir).where("base is not null")
    m = s.groupBy("base").agg(F.avg("mean").alias("mu"), F.stddev_pop("mean").alias("sd"))
    both = metrics.histogram(s, "base", "mean", 10.0, 50).withColumnRenamed("pdf", "p").join(m, "base").withColumn("q", F.exp(em.log_gauss(F.col("x"), F.col("mu"), F.col("sd"))))
    d = metrics.distances(both.select(F.col("base").alias("a"), F.lit("normal").alias("b"), "grid_ix", "x", "p", "q"))
    return d.select(F.col("a").alias("base"), r("hellinger").alias("hellinger"), r("l2").alias("l2"))


_CH = [f"substr('ACEGT', CAST(id // {5 ** (2 - i)} % 5 AS BIGINT) + 1, 1)" for i in range(3)]


@query("density_trees", "WITH w AS (SELECT " + " || ".join(_CH) + """ AS node FROM range(125) t(id)),
p AS (SELECT node, 'flat' AS topology, '' AS parent FROM w
  UNION ALL SELECT node, 'multiset', '<' || array_to_string(list_sort(string_split(node, '')), '') || '>' FROM w
  UNION ALL SELECT node, 'grouped_multiset', '<' || array_to_string(list_sort(string_split(translate(node, 'ACEGT', '01102'), '')), '') || '>' FROM w
  UNION ALL SELECT node, 'middle', '<' || substr(node, 2, 1) || '>' FROM w
  UNION ALL SELECT node, 'purines', '<' || CAST(length(node) - length(translate(node, 'AG', '')) AS VARCHAR) || '>' FROM w)
SELECT topology, node, parent FROM p UNION ALL SELECT DISTINCT topology, parent, '' FROM p WHERE parent <> ''""")
def density_trees(spark, sf_dir):
    """The trees that the hierarchies of k-mer densities take, one for each topology."""
    out = None
    for name in priors.TOPOLOGIES:
        one = priors.tree(spark, sq.METHYL, K, name, "01102").select(F.lit(name).alias("topology"), "node", "parent")
        out = one if out is None else out.unionAll(one)
    return out


@query("spline_density", _H.replace("WITH", "WITH RECURSIVE", 1) + """,
k AS (SELECT base, grid_ix AS i, x, pdf AS y, lead(pdf) OVER w AS up, lag(pdf) OVER w AS down FROM density WINDOW w AS (PARTITION BY base ORDER BY grid_ix)),
f AS (
  SELECT base, CAST(0 AS BIGINT) AS i, 0.5::DOUBLE AS c, 3 * (up - y) / 10 / 2 AS d FROM k WHERE i = 0
  UNION ALL SELECT k.base, k.i, 1 / (CASE WHEN up IS NULL THEN 2 ELSE 4 END - f.c), (3 * (coalesce(up, y) - down) / 10 - f.d) / (CASE WHEN up IS NULL THEN 2 ELSE 4 END - f.c) FROM f JOIN k ON k.base = f.base AND k.i = f.i + 1),
m AS (SELECT base, i, d AS s FROM f WHERE i = 49 UNION ALL SELECT f.base, f.i, f.d - f.c * m.s FROM m JOIN f ON f.base = m.base AND f.i = m.i - 1),
e AS (SELECT event_id, base, mean, greatest(least(CAST(floor((mean - 5) / 10) AS BIGINT), 48), 0) AS i FROM series WHERE base IS NOT NULL),
v AS (SELECT event_id, e.base, (mean - a.x) / 10 AS t, a.y AS p, b.y AS q, ma.s * 10 AS s, mb.s * 10 AS u FROM e LEFT JOIN k a ON a.base = e.base AND a.i = e.i LEFT JOIN k b ON b.base = e.base AND b.i = e.i + 1 LEFT JOIN m ma ON ma.base = e.base AND ma.i = e.i LEFT JOIN m mb ON mb.base = e.base AND mb.i = e.i + 1)
SELECT event_id, base, round(greatest(CASE WHEN t < 0 THEN p + s * t WHEN t > 1 THEN q + u * (t - 1) ELSE p * (1 + 2 * t) * (1 - t) * (1 - t) + s * t * (1 - t) * (1 - t) + q * t * t * (3 - 2 * t) + u * t * t * (t - 1) END, 0), 9) AS density FROM v""")
def spline_density(spark, sf_dir):
    """Each event's density on the spline through its base's histogram."""
    s = series(spark, sf_dir).where("base is not null")
    knots = splines.with_slopes(metrics.histogram(s, "base", "mean", 10.0, 50), "base")
    return splines.evaluate(s.select("event_id", "base", "mean"), knots, 5.0, 10.0, 50, "base", "mean").select("event_id", "base", r("density", 9).alias("density"))


_PSI = "(ln(a + 10) - 0.5 / (a + 10) - 1 / (12 * pow(a + 10, 2)) + 1 / (120 * pow(a + 10, 4)) - 1 / (252 * pow(a + 10, 6)) + 1 / (240 * pow(a + 10, 8)) - (" + " + ".join(f"1 / (a + {i})" for i in range(10)) + "))"
_PSI1 = "(1 / (a + 10) + 0.5 / pow(a + 10, 2) + 1 / (6 * pow(a + 10, 3)) - 1 / (30 * pow(a + 10, 5)) + 1 / (42 * pow(a + 10, 7)) - 1 / (30 * pow(a + 10, 9)) + " + " + ".join(f"1 / pow(a + {i}, 2)" for i in range(10)) + ")"


@query("normal_gamma_prior", SM.replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT level_mean AS m, 1 / (level_sd * level_sd) AS t FROM model),
one AS (SELECT count(*) AS n, sum(t * m) / sum(t) AS mu, avg(t) AS mt, avg(ln(t)) AS ml FROM p),
two AS (SELECT any_value(n) / sum(t * pow(m - mu, 2)) AS nu FROM p, one),
newton AS (SELECT 0 AS step, ln(mt) - ml AS gap, (3 - (ln(mt) - ml) + sqrt(pow(ln(mt) - ml - 3, 2) + 24 * (ln(mt) - ml))) / (12 * (ln(mt) - ml)) AS a FROM one
  UNION ALL SELECT step + 1, gap, a - (ln(a) - {_PSI} - gap) / (1 / a - {_PSI1}) FROM newton WHERE step < 20),
shape AS (SELECT a FROM newton WHERE step = 20)
SELECT parameter, round(value, 5) AS value FROM (SELECT 'mu' AS parameter, mu AS value FROM one UNION ALL SELECT 'nu', nu FROM two UNION ALL SELECT 'alpha', a FROM shape UNION ALL SELECT 'beta', a / mt FROM shape, one)""")
def normal_gamma_prior(spark, sf_dir):
    found = priors.normal_gamma_mle(kmer_model(series(spark, sf_dir)))
    return spark.createDataFrame([(n, round(float(v), 5)) for n, v in found.items()], "parameter string, value double")


@query("grid_moments", _H + " SELECT base, round(sum(x * pdf * dx), 6) AS expected, round(sum(x * x * pdf * dx) - pow(sum(x * pdf * dx), 2), 4) AS variance FROM (SELECT *, x - lag(x) OVER (PARTITION BY base ORDER BY grid_ix) AS dx FROM density) GROUP BY base")
def grid_moments(spark, sf_dir):
    m = metrics.moments(metrics.histogram(series(spark, sf_dir), "base", "mean", 10.0, 50), "base")
    return m.select("base", r("expected").alias("expected"), r("variance", 4).alias("variance"))


@query("kernel_density", S + ", v AS (SELECT base, mean AS v, count(*) AS n FROM series GROUP BY ALL) SELECT base, CAST(i AS BIGINT) AS grid_ix, round(sum(n * exp(-0.5 * pow((i * 10.0 - v) / 4.0, 2))) / (sum(n) * 4.0 * 2.5066282746310002), 8) AS pdf FROM v, range(50) g(i) GROUP BY base, i")
def kernel_density(spark, sf_dir):
    grid = spark.range(50).select(F.col("id").alias("grid_ix"), (F.col("id") * 10.0).alias("x"))
    return metrics.kernel_density(series(spark, sf_dir), "base", "mean", grid, 4.0).select("base", "grid_ix", r("pdf", 8).alias("pdf"))


@query("embedding_l2", "SELECT a.label AS a, b.label AS b, round(sqrt(sum(pow(a.v - b.v, 2))), 4) AS l2 FROM (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) a JOIN (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) b USING (i) WHERE a.label < b.label GROUP BY ALL")
def embedding_l2(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("v"))
    a, b = c.select(F.col("label").alias("a"), "i", F.col("v").alias("va")), c.select(F.col("label").alias("b"), "i", F.col("v").alias("vb"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(r(F.sqrt(F.sum(F.pow(F.col("va") - F.col("vb"), F.lit(2.0)))), 4).alias("l2"))
