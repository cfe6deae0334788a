"""Ranked lexical search: a join of all items with all documents that seeds each item's threshold from stored term impacts.

The documents are read once for a block of items, whose size is bounded, and kept as a table of postings of the block's
terms, packed document by document; nothing is shuffled for that. A term's impact on a document is its part of the score
for one occurrence in the item. Of every term the greatest and the k-th greatest impact over all documents are stored:

* an item's k-th score is at least the k-th impact of any of its terms times the term's repeats, its threshold;
* with an item's terms in descending order of their greatest part, those from the first place on at which the greatest
  parts left sum to less than the threshold cannot alone lift a document into the result. The terms before are the
  item's seeds, and a document that has none of them is no candidate;
* a candidate whose parts of seeds and greatest parts of other terms sum to less than the threshold is dropped, and the
  rest are scored exactly. All bounds are in integers and a document that reaches a threshold stays, so ties are exact.

A task keeps the k best of each item, so what is shuffled is k rows for each item and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import ALNUM, LOWER, batch_of, chunks, owner, packed, schema_of, unpacked, word_hashes
from .support import kept_table, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
POSTINGS = "ids binary,valid binary,n binary,ptr binary,terms binary,tfs binary,n_docs long,n_words long"
EXPANDED = 2 << 20  #: (document, item, term) triples that a task holds at once; one document with a whole block is more
SPREAD = 256  #: parts in which the tasks' best rows of one key are cut before they meet


@dataclass
class Block:
    """A block's distinct terms, in order of their hashes, and each item's terms with their repeats."""

    hashes: np.ndarray
    body: np.ndarray  # the terms' bytes, end to end
    start: np.ndarray
    item_ptr: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


def block_of(items: list[list[str]]) -> Block:
    terms = sorted({t for words in items for t in words})
    text = np.frombuffer(" ".join(terms).encode(), np.uint8)
    h, start, end, _ = word_hashes(text, np.array([0, len(text)]), ALNUM)
    order = np.argsort(h, kind="stable")
    number = {terms[t]: i for i, t in enumerate(order.tolist())}
    size = (end - start)[order]
    body = text[np.repeat(start[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())] if len(terms) else text
    rows = [np.unique(np.array([number[w] for w in words], np.int64), return_counts=True) for words in items]
    return Block(h[order], body, np.append(0, np.cumsum(size)), np.append(0, np.cumsum([len(t) for t, _ in rows])).astype(np.int64), np.concatenate([t for t, _ in rows] or [np.zeros(0, np.int64)]), np.concatenate([r for _, r in rows] or [np.zeros(0, np.int64)]))


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, of each pair in turn."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def find_terms(block: Block, text: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are terms of the block, and their terms; equal hashes are confirmed by the bytes."""
    if not len(block.hashes) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = np.minimum(np.searchsorted(block.hashes, h), len(block.hashes) - 1)
    at = np.flatnonzero((block.hashes[t] == h) & (block.start[t + 1] - block.start[t] == end - start))
    t, size = t[at], (end - start)[at]
    same = text[spread(start[at], size)] == block.body[spread(block.start[t], size)]
    ok = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(at) else np.zeros(0, bool)
    return at[ok], t[ok]


def _postings(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of documents: their ids and numbers of words, and the block's terms in each with frequencies."""
    block = shared.value
    many = max(len(block.hashes), 1)
    for batch, buf, off in chunks(batches):
        text = LOWER[buf]
        h, start, end, ptr = word_hashes(text, off, ALNUM)
        at, term = find_terms(block, text, h, start, end)
        both, tf = np.unique(owner(ptr)[at] * many + term, return_counts=True)
        n, ids = np.diff(ptr), batch.column(0)
        docs = (ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), ids.is_valid().to_numpy(zero_copy_only=False).tobytes())
        yield batch_of([(*docs, packed(n), packed(np.searchsorted(both // many, np.arange(len(n) + 1))), packed(both % many), packed(tf), int((n > 0).sum()), int(n.sum()))], POSTINGS)


@dataclass
class Postings:
    """One row of the table, unpacked: each posting's document (in the row), term and frequency."""

    ids: np.ndarray
    valid: np.ndarray
    n: np.ndarray
    ptr: np.ndarray
    term: np.ndarray
    tf: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return owner(self.ptr)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[Postings]:
    for batch in batches:
        for r in batch.to_pylist():
            wide = [unpacked(r[c]).astype(np.int64) for c in ("n", "ptr", "terms", "tfs")]
            yield Postings(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["valid"], bool), *wide)


@dataclass
class Weights:
    """What a block's scores need of all documents: terms' weights, the number of documents with words, all words."""

    w: np.ndarray
    n_docs: int
    n_words: int

    def impacts(self, p: Postings) -> np.ndarray:
        top = 75 * int(p.n.max(initial=0)) * self.n_docs
        n = p.n if top < 1 << 63 else p.n.astype(object)
        m = (25 + (75 * n * self.n_docs) // max(self.n_words, 1)).astype(np.int64)
        return self.w[p.term] * ((1_000_000_000 * p.tf) // (1000 * p.tf + 8 * m[p.doc]))


def top_of(key: np.ndarray, value: np.ndarray, k: int, *then: np.ndarray) -> np.ndarray:
    """Places of the k greatest values of each key; equal values by `then`, the last first."""
    order = np.lexsort((*then, -value, key))
    s = key[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - begin < k]


def _frequencies(n_terms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(n_terms, np.int64)
    for p in _read(batches):
        df += np.bincount(p.term, minlength=n_terms)
    have = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], schema=schema_of("term long,df long"))


def _best_impacts(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k greatest impacts of each term in this partition."""
    weights, term, impact = shared.value, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p in _read(batches):
        term, impact = np.concatenate([term, p.term]), np.concatenate([impact, weights.impacts(p)])
        keep = top_of(term, impact, k)
        term, impact = term[keep], impact[keep]
    part = np.full(len(term), TaskContext.get().partitionId() % SPREAD)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(impact), pa.array(part, pa.int32())], schema=schema_of("term long,impact long,part int"))


@dataclass
class Plan:
    """Each item's threshold, seeds (by term, for the search) and other terms (by item, for the bounds and the score)."""

    weights: Weights
    threshold: np.ndarray
    rest: np.ndarray  # greatest sum of the parts of the terms that are no seeds
    seed_ptr: np.ndarray
    seed_item: np.ndarray
    seed_repeats: np.ndarray
    other_ptr: np.ndarray
    other_term: np.ndarray
    other_repeats: np.ndarray


def plan_of(block: Block, weights: Weights, most: np.ndarray, kth: np.ndarray) -> Plan:
    """most, kth: the greatest and k-th greatest impact of each term; 0 for a k-th that does not exist."""
    n = len(block.item_ptr) - 1
    item, part, floor = owner(block.item_ptr), block.repeats * most[block.term], block.repeats * kth[block.term]
    threshold = np.zeros(n, np.int64)
    np.maximum.at(threshold, item, floor)
    order = np.lexsort((block.term, -part, item))
    # the sum of the parts from each place of that order to its item's end
    ends = np.append(np.cumsum(part[order][::-1])[::-1], 0)
    left = ends[: len(order)] - ends[block.item_ptr[1:]][item]
    seed = np.ones(len(order), bool)
    seed[:] = (left >= threshold[item]) | (threshold[item] == 0)  # `item` is in ascending order, as `order` keeps it
    rest = np.zeros(n, np.int64)
    np.add.at(rest, item[~seed], part[order][~seed])
    term, repeats = block.term[order], block.repeats[order]
    by = np.argsort(term[seed], kind="stable")
    return Plan(
        weights, threshold, rest, np.searchsorted(term[seed][by], np.arange(len(block.hashes) + 1)), item[seed][by], repeats[seed][by],
        np.searchsorted(item[~seed], np.arange(n + 1)), term[~seed], repeats[~seed],
    )


def steps(count: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose counts sum to at most `limit`, or of one."""
    total, low = np.append(0, np.cumsum(count)), 0
    while low < len(count):
        high = max(low + 1, int(np.searchsorted(total, total[low] + limit, "right")) - 1)
        yield low, high
        low = high


def scored(plan: Plan, p: Postings, threshold: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, items and exact scores of all pairs that may be in the result."""
    impact, doc, n_items, n_terms = plan.weights.impacts(p), p.doc, len(threshold), len(plan.seed_ptr) - 1
    keys = doc * n_terms + p.term  # ascending
    count = plan.seed_ptr[p.term + 1] - plan.seed_ptr[p.term]
    by_doc = np.append(0, np.cumsum(count))[p.ptr]
    for low, high in steps(np.diff(by_doc), EXPANDED):
        a, b = p.ptr[low], p.ptr[high]
        at = spread(plan.seed_ptr[p.term[a:b]], count[a:b])
        if not len(at):
            continue
        pair = np.repeat(doc[a:b], count[a:b]) * n_items + plan.seed_item[at]
        part = np.repeat(impact[a:b], count[a:b]) * plan.seed_repeats[at]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        score, pair = np.add.reduceat(part[order], first), pair[first]
        item = pair % n_items
        alive = score + plan.rest[item] >= threshold[item]
        score, pair, item = score[alive], pair[alive], item[alive]
        others = plan.other_ptr[item + 1] - plan.other_ptr[item]
        for x, y in steps(others, EXPANDED):
            at = spread(plan.other_ptr[item[x:y]], others[x:y])
            mine = np.repeat(np.arange(x, y), others[x:y])
            want = (pair[mine] // n_items) * n_terms + plan.other_term[at]
            found = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            hit = keys[found] == want
            np.add.at(score, mine[hit], impact[found[hit]] * plan.other_repeats[at][hit])
        good = (score >= threshold[item]) & (score > 0)
        yield pair[good] // n_items, item[good], score[good]


def _search(shared, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plan = shared.value
    threshold = plan.threshold.copy()
    item, score, ids, null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for p in _read(batches):
        for doc, i, s in scored(plan, p, threshold):
            item, score, ids, null = np.concatenate([item, i]), np.concatenate([score, s]), np.concatenate([ids, p.ids[doc]]), np.concatenate([null, ~p.valid[doc]])
        keep = top_of(item, score, k, ids, null)
        item, score, ids, null = item[keep], score[keep], ids[keep], null[keep]
        full = np.flatnonzero(np.bincount(item, minlength=len(threshold)) == k)
        last = np.searchsorted(item, full, "right") - 1
        threshold[full] = np.maximum(threshold[full], score[last])  # items are in order, the k-th score is the last
    part = np.full(len(item), TaskContext.get().partitionId() % SPREAD)
    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, pa.int64(), mask=null), pa.array(score), pa.array(part, pa.int32())], schema=schema_of("item long,doc_id long,score long,part int"))


def _ranked(rows: DataFrame, key: str, k: int, order: list) -> DataFrame:
    """The first k rows of each key with their `rank`; parts of the tasks first, so that no key gathers a row of every task at once."""
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))).where(F.col("_r") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k).drop("_r", "part")


def search_block(docs: DataFrame, items: list[list[str]], k: int) -> DataFrame:
    """item (its place in `items`), rank, doc_id and score. docs: doc_id, text; items: their words."""
    sc = docs.sparkSession.sparkContext
    block = block_of(items)
    shared = sc.broadcast(block)
    table = kept_table(docs.mapInArrow(lambda b: _postings(shared, b), POSTINGS))
    n_terms = len(block.hashes)
    sums = table.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    n_docs, n_words = int(sums["d"] or 0), int(sums["w"] or 0)
    packs = table.select("ids", "valid", "n", "ptr", "terms", "tfs")
    df, most, kth = (np.zeros(n_terms, np.int64) for _ in range(3))
    for r in packs.mapInArrow(lambda b: _frequencies(n_terms, b), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    # doubles, as the weight is defined; the quotient and the logarithm are those of any 64-bit library
    w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    weights = Weights(w, n_docs, n_words)
    shared_weights = sc.broadcast(weights)
    best = _ranked(packs.mapInArrow(lambda b: _best_impacts(shared_weights, k, b), "term long, impact long, part int"), "term", k, [F.desc("impact")])
    for r in best.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("kth"), F.count("*").alias("n")).collect():
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"] if r["n"] == k else 0
    shared_plan = sc.broadcast(plan_of(block, weights, most, kth))
    found = packs.mapInArrow(lambda b: _search(shared_plan, k, b), "item long, doc_id long, score long, part int")
    return _ranked(found, "item", k, [F.desc("score"), F.asc_nulls_last("doc_id")])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 1 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: each item's k documents of highest score above 0, equal scores by ascending doc_id.

    Every row of `docs` is a document, rows that share an id or have none among them (a null id comes last in ties).
    Repeated rows of `items` are one item; texts that differ under one item_id are items of their own, each with ranks
    from 1. Items or documents without a term, null texts among them, give no rows. Items go through in blocks of
    `block_bytes` of text, or of one longer item, and each block reads the documents once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), lower_ascii(F.col(item_text)).alias("text")).where(F.length("text") > 0).distinct()
    size = F.octet_length("text").cast("long")
    n = max(1, -(-int(asked.agg(F.sum(size)).first()[0] or 0) // block_bytes))
    while True:
        dealt = asked.withColumn("_block", F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(n)))
        sizes = dealt.groupBy("_block").agg(F.sum(size).alias("s"), F.count("*").alias("n")).orderBy("_block").collect()  # a row for each block
        if all(r["s"] <= block_bytes or r["n"] == 1 for r in sizes):
            break
        n *= 2
    out = []
    for r in sizes:
        mine = dealt.where(F.col("_block") == r["_block"]).select("item_id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words")).collect()  # bounded by the block
        names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(mine)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        out.append(search_block(rows, [x["words"] for x in mine], k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    none = spark.createDataFrame([], f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else none
