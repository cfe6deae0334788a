"""Quality classifier: per-language Kneser-Ney models of all trusted text, sharded in the shared folder, quantile thresholds.

The model is that of `kneser_ney`, one for each language, trained on every trusted document of the language that is not
kept for calibration. Each language has shards in proportion to its trained text, one at least, and the arrays of all
are counted in one pass: a block's bigrams are dealt by language and shard. Workers map the arrays as `kneser_ney` does
and score whole texts, each by its own language's model.

Training text is found without a shuffle of all text: a bit table of the trained ids, of `filter_bits` bits at most
whatever their number, leaves out most other rows, and what it lets through is joined to the ids themselves.

A bound on the training text of each language, `train_bytes`, is taken only if the caller names one: then those train
that come first in order of a hash of their id, as many as have `train_bytes` bytes of text together (a text counts 64
bytes at least). Texts over an eighth of that bound come after all others, the shortest first, so that none of them ends
a sample that others could fill; a text over the whole bound never trains.

Of the trusted documents, those with crc32(doc_id) mod 3 = 0 never train: a language's threshold is the `quantile` of
the perplexities of all of them. A document is kept if its perplexity is not above its language's threshold.

Defined results: a null or empty text is its end only, and is scored like any other; a null language is a language of
its own; a language with under `min_calibration` calibration documents has no threshold and keeps all, and so does one
without a training text, whose perplexities are all 1; repeated rows are scored each, and texts of any length whole; without trusted documents everything is kept.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import batch_of, chunks
from .kneser_ney import BLOCK_TOKENS, DONE, PAIRS, WORDS, Model, _merge, _words, deal_pairs, histories, id_remainder, model_of, token_scores, tokens
from .support import cut, freed_shuffles, shared_dir, shards

OUT = "doc_id long, lang string, n_tokens long, log10_prob double"
SHARD_BYTES = 128 << 20


def by_language(langs: pa.Array, ptr: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each language of a slice, null as empty: its rows, and which tokens are theirs."""
    coded = langs.fill_null("").dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    token_codes = np.repeat(codes, np.diff(ptr))
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == k), token_codes == k


def _count(first: dict[str, int], parts: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS of lang and text, a language's shards numbered from `first` on."""
    held: dict[str, list] = defaultdict(list)
    n = 0

    def dealt() -> pa.RecordBatch:
        rows = []
        for lang, pairs in held.items():
            u, w = (np.concatenate(x) for x in zip(*pairs, strict=True))
            rows += [(first[lang] + s, *rest) for s, *rest in deal_pairs(u, w, parts[lang])]
        return batch_of(rows, PAIRS)

    for batch, buf, off in chunks(batches):
        t, ptr = tokens(buf, off)
        u = histories(t, ptr)
        for lang, _, own in by_language(batch.column(0), ptr):
            held[lang].append((u[own], t[own]))
        n += len(t)
        if n >= BLOCK_TOKENS:
            yield dealt()
            held.clear()
            n = 0
    if n:
        yield dealt()


def _own_shard(firsts: list[int], step: Callable[[int, pa.Table], pa.Table], table: pa.Table) -> pa.Table:
    """A step of one model's shard on a shard of all models; `step` is given the model's number."""
    model = bisect_right(firsts, table["shard"][0].as_py()) - 1
    moved = lambda t, by: t.set_column(0, "shard", pa.array(t["shard"].to_numpy() + by, pa.int32()))
    return moved(step(model, moved(table, -firsts[model])), firsts[model])


def train(docs: DataFrame, sizes: dict[str, int], n: int) -> dict[str, Model]:
    """A model for each language over all rows of docs (lang without nulls, text), in n shards or a few more; sizes: each language's bytes."""
    langs = sorted(sizes)
    parts = {lang: max(1, -(-n * sizes[lang] // max(sum(sizes.values()), 1))) for lang in langs}
    first = dict(zip(langs, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    firsts, ns = [first[x] for x in langs], [parts[x] for x in langs]
    base = f"{shared_dir(docs.sparkSession).rstrip('/')}/lm-{uuid.uuid4().hex}"
    pairs = docs.select("lang", "text").mapInArrow(lambda it: _count(first, parts, it), PAIRS)
    merged = pairs.groupBy("shard").applyInArrow(lambda t: _own_shard(firsts, lambda i, x: _merge(ns[i], f"{base}/{i}", x), t), WORDS)
    with freed_shuffles(docs.sparkSession):
        done = merged.groupBy("shard").applyInArrow(lambda t: _own_shard(firsts, lambda i, x: _words(f"{base}/{i}", x), t), DONE).collect()  # one row a shard
    own: dict[int, list] = defaultdict(list)
    for r in done:
        i = bisect_right(firsts, r["shard"]) - 1
        own[i].append(r.asDict() | {"shard": r["shard"] - firsts[i]})
    return {langs[i]: model_of(f"{base}/{i}", ns[i], rows) for i, rows in own.items()}


def score(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, lang, n_tokens and log10_prob of every row of docs (doc_id, lang, text); log10_prob is 0 without a model."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, opened = shared.value, {}
        for model in models.values():
            model.opened = opened  # the bound on what is held is one for all
        for batch, buf, off in chunks(batches):
            t, ptr = tokens(buf, off)
            n, total = np.diff(ptr), np.zeros(len(off) - 1)
            for lang, rows, own in by_language(batch.column(1), ptr):
                if lang in models:
                    own_ptr = np.append(0, np.cumsum(n[rows]))
                    total[rows] = np.add.reduceat(token_scores(models[lang], t[own], own_ptr)[0], own_ptr[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(total)], names=[f.split()[0] for f in OUT.split(", ")])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, OUT)


def with_ids(rows: DataFrame, ids: DataFrame, filter_bits: int) -> DataFrame:
    """The rows whose doc_id is among the ids (distinct, not null). A bit table goes first, so that few other rows are shuffled."""
    slot = F.xxhash64("doc_id").bitwiseAND(F.lit(filter_bits - 1))
    bit = F.expr("shiftleft(1L, cast(_s & 63 as int))")
    table = ids.select(slot.alias("_s")).groupBy(F.shiftright("_s", 6).alias("_w")).agg(F.bit_or(bit).alias("_m"))  # filter_bits / 64 rows at most
    likely = rows.withColumn("_s", slot).withColumn("_w", F.shiftright("_s", 6)).join(F.broadcast(table), "_w").where(F.col("_m").bitwiseAND(bit) != 0)
    # an inner join, since Spark would put a semi join before the bit table; merged at every size, so that disk grows as the input does
    return likely.select(*rows.columns).join(ids.hint("merge"), "doc_id").select(*rows.columns)


def training_sample(candidates: DataFrame, train_bytes: int) -> DataFrame:
    """Language and doc_id of the texts that train, from their _l, doc_id, size and rank."""
    # at least 64 bytes are reckoned for a text, which bounds the rows of the sample, and so what is broadcast
    texts = cut(candidates.groupBy("_l", "doc_id", "rank").agg(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(64)).cast("long")).alias("size")).where(F.col("size") <= train_bytes))
    step = max(train_bytes // 4096, 1)
    large = F.when(F.col("size") * 8 > train_bytes, F.col("size")).otherwise(0)
    texts = texts.withColumn("large", large).withColumn("part", F.when(F.col("large") > 0, 4096 + F.floor(F.col("large") / step)).otherwise(F.shiftrightunsigned("rank", 52)))
    # a language's last part within the bound, so that the running sum is taken over few rows more than the sample has
    upto = Window.partitionBy("_l").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = texts.groupBy("_l", "part").agg(F.sum("size").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    last = parts.where(F.col("before") <= train_bytes).groupBy("_l").agg(F.max("part").alias("last"))
    order = Window.partitionBy("_l").orderBy("part", "large", F.shiftrightunsigned("rank", 1), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    first = texts.join(F.broadcast(last), "_l").where("part <= last")
    return first.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= train_bytes).select("_l", "doc_id")


def quality_by_perplexity(docs: DataFrame, trusted: DataFrame, quantile: float = 0.99, train_bytes: int | None = None, min_calibration: int = 5, filter_bits: int = 1 << 25, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold and kept of every row; trusted: the doc_id of trusted documents."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    named = F.coalesce("lang", F.lit(""))
    good = trusted.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    holds = id_remainder(F.col("doc_id"), 3) == 0
    ids = cut(good.where(~holds))
    sizes = rows.select("doc_id", named.alias("_l"), F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("rank")).join(ids, "doc_id")
    texts = rows.withColumn("_l", named)
    if train_bytes is None:
        taught = with_ids(texts, ids, filter_bits)
    else:
        chosen = cut(training_sample(sizes, train_bytes))
        taught, sizes = texts.join(F.broadcast(chosen), ["_l", "doc_id"], "left_semi"), sizes.join(F.broadcast(chosen), ["_l", "doc_id"], "left_semi")
    of = {r["_l"]: r["size"] for r in sizes.groupBy("_l").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()}  # one row a language
    n = shards(docs.sparkSession, sum(of.values()) // SHARD_BYTES)
    models = train(taught.select(F.col("_l").alias("lang"), "text"), of, n) if of else {}

    scored = cut(score(rows, models).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))))
    calibration = scored.where(holds).join(good, "doc_id", "left_semi").groupBy(named.alias("_l"))
    trained = F.col("_l").isin(*models) if models else F.lit(False)
    limits = calibration.agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"), F.count("*").alias("n")).where((F.col("n") >= min_calibration) & trained).drop("n")
    judged = scored.withColumn("_l", named).join(limits, "_l", "left").drop("_l")
    return judged.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
