"""The registered query of each training-data operator, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hilbert, kneser_ney, language_id, lloyd, packing, parity_join, quality_lm, quality_rules, ranked_search, repeats, token_counts, url_filter

QUERIES: dict = {}
ORACLES: dict = {}

#: action, host, path of the production URL list
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.benchmark_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_distinct(F.transform("matches", lambda m: m["item_id"]))
    names = F.array_sort(F.transform(items, lambda i: i.cast("string")))
    rows = found.select("doc.doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


ORACLES["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1) GROUP BY r),
l AS (SELECT r, doc_id, source, raw, regexp_replace(lower(raw), '[0-9\x20\x09\x0B-\x0D]+', '', 'g') AS x, len(list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words
  FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS raw FROM d)),
over_limit AS (SELECT source, x, min(doc_id) AS first FROM l WHERE x <> '' GROUP BY ALL HAVING count(DISTINCT coalesce('d' || doc_id, 'r' || r)) > 10),
lost AS (SELECT r, sum(words) AS n FROM l JOIN over_limit o ON o.source IS NOT DISTINCT FROM l.source AND o.x = l.x WHERE first IS DISTINCT FROM doc_id GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT raw) AS n FROM l WHERE words > 0 GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN again USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.3 * n_words AS kept
FROM m"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), ["lang", "source"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(counts, packing.tokens_and_end())


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


ORACLES["op9_url_filter"] = """
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(action, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM p"""


@query
def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("rest.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = kneser_ney.id_remainder(F.col("doc_id"), 7) == 2
    model = kneser_ney.train(docs.where(~held_out))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op1_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id")
    return quality_lm.quality_by_perplexity(table(spark, sf_dir, "documents"), trusted)


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_ranked_search"] = r"""
WITH lower_docs AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lower_docs),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, total),
items AS (SELECT DISTINCT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
q AS (SELECT item_id, t, term, count(*) AS repeats FROM (SELECT item_id, t, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items) GROUP BY ALL),
scores AS (
  SELECT item_id, t, r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (r), total GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, t ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""


@query
def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"), k=8, size=64, rounds=10, seed=3)


def _lloyd_sql(rounds: int) -> str:
    """Each round as its own part of the query; floor of a quotient of integers is written out, as // cuts towards 0."""
    nearest = lambda i: f"d{i} AS MATERIALIZED (SELECT p.vec_id, c.cluster, CAST(sum((p.v - c.v) * (p.v - c.v)) AS BIGINT) AS distance FROM p JOIN c{i} c ON p.i = c.i GROUP BY ALL), a{i} AS MATERIALIZED (SELECT vec_id, cluster, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS o FROM d{i}) WHERE o = 1)"
    moved = lambda i: f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, c.i, CAST(coalesce((s - ((s % n) + n) % n) // n, c.v) AS BIGINT) AS v FROM c{i} c LEFT JOIN (SELECT a.cluster, p.i, CAST(sum(p.v) AS BIGINT) AS s, count(*) AS n FROM a{i} a JOIN p USING (vec_id) GROUP BY ALL) m ON m.cluster = c.cluster AND m.i = c.i)"
    parts = [x for i in range(rounds) for x in (nearest(i), moved(i))] + [nearest(rounds)]
    return f"""
WITH whole AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
p AS MATERIALIZED (SELECT vec_id, i, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, e, unnest(range(1, 65)) AS i FROM whole)),
starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS cluster FROM whole),
c0 AS MATERIALIZED (SELECT cluster, i, v FROM starts JOIN p USING (vec_id) WHERE cluster < 8),
{(',' + chr(10)).join(parts)},
names AS (SELECT cluster, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster),
sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a{rounds}) AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (cluster) JOIN sums USING (cluster)"""


ORACLES["op12_lloyd"] = _lloyd_sql(10)


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = kneser_ney.id_remainder(F.col("doc_id"), 5) == 0
    net = language_id.train(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), net, keep=["doc_id", "held_out"])
