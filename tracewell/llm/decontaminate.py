"""Benchmark decontamination with suffix arrays over the training words.

Each task reads its documents shard by shard, a shard being a million words or one text. Of a shard it builds the suffix
array over word hashes, leaving out suffixes whose first words open no test suffix, since no search can end there.
Every test suffix is then binary-searched; the suffixes found share a window with it, and each such place is extended
to the longest verbatim match. The documents never leave their tasks: there is no shuffle.

The test set is searched in blocks of at most `block_bytes`, so what a task holds of it is bounded at any size.

Words are runs of digits, letters a-z (after lower-casing A-Z) and bytes from 0x80 on; two words are equal if their
64-bit hashes are. A window is `window` consecutive words of an item; an item of fewer words is one window. Defined
results: null or empty texts, and items without words, match nothing; items with a null id are left out; items that
share an id count once, and repeated items are merged before they are sent; a text of any length is one shard and is
never cut; repeated documents are judged alike; extra columns ride along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .kernels import ALNUM, LOWER, chunks, grams, row_ids, word_hashes
from .support import cut

SHARD_WORDS = 1 << 20
MATCH = "array<struct<item_id:long,doc_start:int,item_start:int,length:int>>"


@dataclass
class TestSet:
    """Words of all items end to end; for each suffix that a window opens: its first word, its item's end, its window's length."""

    words: np.ndarray
    item: np.ndarray  # id of each suffix's item
    at: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    need: np.ndarray
    seeds: np.ndarray
    seed_words: int
    depth: int


def build_test_set(items: pa.RecordBatch, window: int) -> TestSet | None:
    parts, base = [], 0
    for batch, buf, off in chunks(iter([items])):
        words, _, _, ptr = word_hashes(LOWER[buf], off, ALNUM)
        parts.append((words, ptr[:-1] + base, ptr[1:] + base, row_ids(batch, "item_id")))
        base += len(words)
    if not base:
        return None
    words, begin, end, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    need = np.minimum(end - begin, window)
    count = np.where(need > 0, end - begin - need + 1, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    seed_words = int(min(3, need[need > 0].min()))
    seeds, places = grams(words, np.append(begin, base), seed_words)
    return TestSet(words, ids[which].astype(np.int64), at, begin[which], end[which], need[which], np.unique(seeds[np.isin(places, at)]), seed_words, int((end - begin).max()))


def suffix_array(words: np.ndarray, stop: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at` in the order of the word sequences that start there, up to `depth` words; `stop`: each place's text end."""
    order = np.argsort(words[at], kind="stable")
    at, stop = at[order], stop[order]
    group = np.cumsum(np.r_[True, words[at][1:] != words[at][:-1]]) if len(at) else np.zeros(0, np.int64)
    live = np.arange(len(at))
    for k in range(1, depth):
        size = np.bincount(group[live]) if len(live) else np.zeros(1, int)
        live = live[size[group[live]] > 1]
        if not len(live):
            break
        place = at[live] + k
        there = place < stop[live]
        key = np.where(there, words[np.minimum(place, len(words) - 1)], np.uint64(0))
        by = np.lexsort((key, there, group[live]))
        at[live], stop[live], key, there, old = at[live][by], stop[live][by], key[by], there[by], group[live]
        new = np.r_[False, (key[1:] != key[:-1]) | (there[1:] != there[:-1])]
        new &= np.r_[False, old[1:] == old[:-1]]
        # places in `live` stay in group order, so a running count makes fresh, ordered group numbers among them
        group[live] = np.cumsum(new | np.r_[True, old[1:] != old[:-1]])
        live = live[there]
    return at


def search(words: np.ndarray, stop_of: np.ndarray, suffixes: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 index, in the suffix array, of the suffixes that start with each test suffix's window."""

    def less(mid: np.ndarray, upper: bool) -> np.ndarray:
        """Whether the suffix at `mid` sorts before the test window (upper: before or with it as prefix)."""
        place, sign = suffixes[mid], np.zeros(len(mid), np.int8)
        stop = stop_of[mid]
        for k in range(int(test.need.max())):
            open_ = np.flatnonzero((sign == 0) & (k < test.need))
            if not len(open_):
                break
            p = place[open_] + k
            over = p >= stop[open_]
            a, b = words[np.minimum(p, len(words) - 1)], test.words[test.at[open_] + k]
            sign[open_] = np.where(over, -1, np.where(a < b, -1, np.where(a > b, 1, 0)))
        return sign <= 0 if upper else sign < 0

    found = []
    for upper in (False, True):
        low, high = np.zeros(len(test.at), np.int64), np.full(len(test.at), len(suffixes))
        while (low < high).any():
            mid = np.minimum((low + high) >> 1, len(suffixes) - 1)
            go, moving = less(mid, upper), low < high
            low, high = np.where(moving & go, mid + 1, low), np.where(moving & ~go, mid, high)
        found.append(low)
    return found[0], found[1]


def matches(words: np.ndarray, ptr: np.ndarray, test: TestSet) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches in a shard: document, item id, word in the document, word in the item, length."""
    none = (np.zeros(0, np.int64),) * 5
    heads, at = grams(words, ptr, test.seed_words)
    table = np.zeros(1 << 20, bool)
    table[(test.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    maybe = table[(heads & np.uint64((1 << 20) - 1)).astype(np.int64)]
    heads, at = heads[maybe], at[maybe]
    at = at[np.isin(heads, test.seeds)]
    if not len(at):
        return none
    doc_of = lambda p: np.searchsorted(ptr, p, "right") - 1
    suffixes = suffix_array(words, ptr[doc_of(at) + 1], at.copy(), test.depth)
    low, high = search(words, ptr[doc_of(suffixes) + 1], suffixes, test)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    place = suffixes[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)]
    doc = doc_of(place)
    t_at = test.at[which]
    first = (t_at > test.begin[which]) & (place > ptr[doc])
    left = ~(first & (words[place - first] == test.words[t_at - first]))  # else the match began earlier
    which, place, doc, t_at = which[left], place[left], doc[left], t_at[left]
    length = test.need[which].astype(np.int64)
    most = np.minimum(ptr[doc + 1] - place, test.end[which] - t_at)
    live = np.flatnonzero(length < most)
    while len(live):
        same = words[place[live] + length[live]] == test.words[t_at[live] + length[live]]
        live = live[same]
        length[live] += 1
        live = live[length[live] < most[live]]
    return doc, test.item[which], place - ptr[doc], t_at - test.begin[which], length


def _with_matches(batch: pa.RecordBatch, n_words: np.ndarray, found: tuple[np.ndarray, ...], schema: pa.Schema) -> pa.RecordBatch:
    doc, item, start, item_start, length = found
    order = np.lexsort((item_start, item, start, doc))
    offsets = np.searchsorted(doc[order], np.arange(len(n_words) + 1)).astype(np.int32)
    kind = schema.field("matches").type
    cols = [pa.array(item[order]), pa.array(start[order].astype(np.int32)), pa.array(item_start[order].astype(np.int32)), pa.array(length[order].astype(np.int32))]
    struct = pa.StructArray.from_arrays(cols, fields=[kind.value_type.field(i) for i in range(4)])
    lists = pa.ListArray.from_arrays(pa.array(offsets), struct).cast(kind)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), lists], schema=schema)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """`doc` (all columns of docs, as a struct), n_words and `matches`, the longest verbatim matches in word positions."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    done = None
    for b in range(blocks):  # one pass for each bounded block of the test set
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        test = build_test_set(part.toArrow().combine_chunks().to_batches(max_chunksize=1 << 40)[0], window) if part.limit(1).count() else None
        shared = spark.sparkContext.broadcast(test)
        fields = [rows.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("matches", T._parse_datatype_string(MATCH))]
        out = T.StructType(fields)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, schema=to_arrow_schema(out)) -> Iterator[pa.RecordBatch]:
            test, held, size = shared.value, [], 0

            def flush():
                words = np.concatenate([h[1] for h in held])
                n = np.concatenate([h[2] for h in held])
                ptr = np.concatenate([[0], np.cumsum(n)])
                found = matches(words, ptr, test) if test is not None else (np.zeros(0, np.int64),) * 5
                low = 0
                for batch, _, mine in held:
                    own = (found[0] >= low) & (found[0] < low + len(mine))
                    yield _with_matches(batch, mine, (found[0][own] - low, *(x[own] for x in found[1:])), schema)
                    low += len(mine)
                held.clear()

            for piece in batches:
                flat = pa.RecordBatch.from_arrays([piece.column(0), pa.compute.struct_field(piece.column(0), text)], names=["doc", "text"])
                for batch, buf, off in chunks(iter([flat])):
                    words, _, _, ptr = word_hashes(LOWER[buf], off, ALNUM)
                    held.append((batch, words, np.diff(ptr)))
                    size += len(words)
                    if size >= SHARD_WORDS:
                        yield from flush()
                        size = 0
            if held:
                yield from flush()

        found = rows.mapInArrow(scan, out)
        if blocks == 1:
            return found
        key = cut_rows(found)
        done = cut(key if done is None else _merged(done, key))
    return done.select("doc", "n_words", "matches")


def cut_rows(found: DataFrame) -> DataFrame:
    """Rows of one pass with a key: equal documents have equal keys, and equal results."""
    return found.select("doc", "n_words", "matches", F.xxhash64(F.to_json("doc")).alias("_key"))


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.groupBy("_key").agg(F.first("matches").alias("_more"))
    both = a.join(other, "_key", "left")
    return both.select("doc", "n_words", F.concat("matches", F.coalesce("_more", F.expr(f"cast(array() as {MATCH})"))).alias("matches"), "_key")


def hit_words(matches_col: str = "matches"):
    """Number of distinct words inside the spans of a row's matches."""
    spans = F.array_sort(F.transform(matches_col, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    grow = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], s["b"]).alias("to"))
    return F.aggregate(spans, start, grow, lambda acc: acc["n"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no window of any item occurs."""
    return benchmark_matches(docs, benchmark, window).where(F.size("matches") == 0).select("doc.*")
