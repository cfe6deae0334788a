"""Suffix-array deduplication: common-prefix intervals of an enhanced suffix array, over sharded candidate text.

A string of `span` bytes belongs to the shard of the least k-gram hash inside it, so equal strings meet in one shard
wherever they stand. Consecutive windows of a document with the same least hash form a segment. Three passes:

1. Each block of documents announces the least hashes of its segments, as sorted deltas; a shard answers with one bit
   for each: whether another document announced the same hash.
2. Blocks send the text of segments so marked, once for equal segments of a block, with the least doc_id they have.
   A shard builds the suffix array of the segments that share a hash and are not all equal, and its common-prefix
   array; a stack scan gives the interval tree from depth `span` down. An interval whose occurrences are preceded by
   different bytes (or begin a segment) is left-maximal; as an interval it is right-maximal, and holds all occurrences.
   The least doc_id of such a maximal repeat goes to every window it covers.
3. Blocks get back, for each segment, the least doc_id over runs of its windows, and cut what a smaller document has.

A shard's suffixes are ordered by their first DEPTH bytes, or to the end of their segment where that comes first. So a
repeat longer than DEPTH, as in periodic text, comes as the overlapping groups of DEPTH bytes at each of its suffixes,
whatever byte stands before them, and the removal joins them again; no occurrence is lost by that. Text crosses the network as compressed blocks; nothing is
collected, and a line that every document has is one segment per block in one shard.

Defined results: null and empty texts have no bytes; texts shorter than `span` lose nothing; a null doc_id is larger
than any other and no smaller than another null; rows that share a doc_id are not smaller than each other; repeated
rows keep their copies' bytes if none has a smaller doc_id; an empty table gives no rows. Other columns ride along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .kernels import INV, MULT, batch_of, chunks, mix, packed, powers, prefix, runs, span_hash, table_of, unpacked
from .support import cut, shards_for

SPAN, GRAM = 50, 24
SLICE = 1 << 18  #: bytes whose arrays fit a cache
DEPTH = 88  #: bytes to which suffixes are ordered
LAST = (1 << 63) - 1  #: stands for a null doc_id
BLOCKS = "block long, head binary, body binary"
CALLS = "shard int, block long, first long, steps binary"
MARKS = "block long, shard int, bits binary"
PIECES = "shard int, block long, anchors binary, sizes binary, least binary, body binary"
VERDICTS = "block long, shard int, counts binary, widths binary, least binary"


# --- blocks of documents -----------------------------------------------------------------------------------------


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: column `rest` as an Arrow stream, the texts' offsets and compressed bytes."""
    press = zstandard.ZstdCompressor(level=1)
    for number, (batch, buf, off) in enumerate(chunks(batches), TaskContext.get().partitionId() << 32):
        rest = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off))], names=["rest", "n_bytes"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as out:
            out.write_batch(rest)
        yield batch_of([(number, sink.getvalue().to_pybytes(), press.compress(buf.tobytes()))], BLOCKS)


class Block:
    """A block of documents again, and its segments: start, windows, least hash and document of each."""

    def __init__(self, head: bytes, body: bytes, id_name: str, span: int, k: int):
        batch = pa.ipc.open_stream(head).read_next_batch()
        self.rest = batch.column(0)
        self.off = np.concatenate([[0], np.cumsum(batch.column(1).to_numpy())])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        ids = pc.struct_field(self.rest, id_name).cast(pa.int64())
        self.ids = ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.start, self.windows, self.anchor, self.doc = segments(self.buf, self.off, span, k)
        self.span = span

    def calls(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (least hash, document) pairs in order, as hashes; and for each segment its pair's number."""
        order = np.lexsort((self.doc, self.anchor))
        a, d = self.anchor[order], self.doc[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        pair = np.empty(len(a), np.int64)
        pair[order] = np.cumsum(new) - 1
        return a[new], pair

    def marked(self, marks: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments whose hash other documents have too; distinct ones in order of hash: for each of the marked its
        distinct number, and of the distinct ones a segment and the least doc_id."""
        calls, pair = self.calls()
        ends = np.searchsorted(shard_of(calls, n), np.arange(n + 1))
        flag = np.zeros(len(calls), bool)
        for s, bits in zip(marks["shard"].to_pylist(), marks["bits"].to_pylist(), strict=True):
            flag[ends[s] : ends[s + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=ends[s + 1] - ends[s])
        some = np.flatnonzero(flag[pair])
        pre = prefix(self.buf)
        content = span_hash(pre, self.start[some], self.start[some] + self.windows[some] + (self.span - 1))
        order = np.lexsort((content, self.anchor[some]))
        some, content = some[order], content[order]
        new = np.ones(len(some), bool)
        new[1:] = (content[1:] != content[:-1]) | (self.anchor[some][1:] != self.anchor[some][:-1])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.doc[some]], at) if len(at) else np.zeros(0, np.int64)
        return some, np.cumsum(new) - 1, some[at], least


def segments(buf: np.ndarray, off: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of `span` bytes, inside a document, that share their least k-gram hash."""
    parts, w, lo, n_docs = [], span - k + 1, 0, len(off) - 1
    while lo < n_docs:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        sub, own = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        n = len(sub)
        if n >= span:
            pre = prefix(sub)
            least = (pre[k:] - pre[:-k]) * powers(INV, n + 1)[: n - k + 1]
            least *= MULT
            least ^= least >> np.uint64(32)
            size = 1
            while 2 * size <= w:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < w:
                least = np.minimum(least[: size - w], least[w - size :])
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            begins = own[:-1]
            new[begins[begins < len(new)]] = True
            start = np.flatnonzero(new)
            doc = np.searchsorted(own, start, "right") - 1
            end = np.minimum(np.append(start[1:], len(least)), (own[1:] - span + 1)[doc])
            ok = end > start
            start, doc = start[ok], doc[ok]
            parts.append((start + off[lo], end[ok] - start, mix(least[start]), doc + lo))
        lo = hi
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """Shards in order of hash."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _blocks(table_or_batch, id_name: str, span: int, k: int) -> Iterator[tuple[int, Block]]:
    for number, head, body in zip(*(table_or_batch.column(c).to_pylist() for c in ("block", "head", "body")), strict=True):
        yield number, Block(head, body, id_name, span, k)


# --- first pass: hashes that two documents share -------------------------------------------------------------------


def _announce(n: int, id_name: str, span: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop = np.uint64(max(0, 24 - n.bit_length()))  # low bits that a shard of any size can spare: a clash only costs time
    for batch in batches:
        for number, block in _blocks(batch, id_name, span, k):
            calls, _ = block.calls()
            ends = np.searchsorted(shard_of(calls, n), np.arange(n + 1))
            calls >>= drop
            yield batch_of([(s, number, int(calls[a]), packed(np.diff(calls[a:b]))) for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b], CALLS)


def _shared(table: pa.Table) -> pa.Table:
    rows = list(zip(*(table[c].to_pylist() for c in ("block", "shard", "first", "steps")), strict=True))
    values = [np.cumsum(np.concatenate([[first], unpacked(steps)]).astype(np.uint64), dtype=np.uint64) for _, _, first, steps in rows]
    every = np.sort(np.concatenate(values))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for (block, shard, _, _), v in zip(rows, values, strict=True):
        at = np.minimum(np.searchsorted(twice, v), max(len(twice) - 1, 0))
        hit = twice[at] == v if len(twice) else np.zeros(len(v), bool)
        if hit.any():
            out.append((block, shard, np.packbits(hit).tobytes()))
    return table_of(out, MARKS)


# --- second pass: suffix arrays of shared segments ----------------------------------------------------------------


def _send(n: int, id_name: str, span: int, k: int, left: pa.Table, marks: pa.Table) -> pa.Table:
    press, out = zstandard.ZstdCompressor(level=1), []
    for number, block in _blocks(left, id_name, span, k):
        _, _, one, least = block.marked(marks, n)
        anchors, sizes = block.anchor[one], block.windows[one] + (span - 1)
        ends = np.searchsorted(shard_of(anchors, n), np.arange(n + 1))
        for s in range(n):
            a, b = ends[s], ends[s + 1]
            if a < b:
                body = b"".join([block.buf[x : x + y].tobytes() for x, y in zip(block.start[one[a:b]].tolist(), sizes[a:b].tolist(), strict=True)])
                out.append((s, number, anchors[a:b].tobytes(), packed(sizes[a:b]), packed(least[a:b]) if not len(least) or least[a:b].min() >= 0 else b"q" + least[a:b].tobytes(), press.compress(body)))
    return table_of(out, PIECES)


def lcp_intervals(lcp: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The common-prefix interval tree by a stack scan: depth, first and last suffix of every interval.

    lcp[i] is the common prefix of suffixes i - 1 and i, or 0 where it is too short to count.
    """
    depth, first, last, stack = [], [], [], []
    for i, value in enumerate([*lcp[1:], 0], 1):
        left = i - 1
        while stack and stack[-1][0] > value:
            top, left = stack.pop()
            depth.append(top)
            first.append(left)
            last.append(i - 1)
        if value and (not stack or stack[-1][0] < value):
            stack.append((value, left))
    return depth, first, last


def enhanced_suffix_array(body: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at`, each of `room` bytes, up to DEPTH bytes; and their common prefixes with the one before.

    The room is a last byte of the key: of suffixes that differ by zero bytes at their ends only, the shorter comes first.
    """
    rows = np.lib.stride_tricks.sliding_window_view(np.append(body, np.zeros(DEPTH + 1, np.uint8)), DEPTH + 1)[at]
    rows[np.arange(DEPTH + 1) >= room[:, None]] = 0
    rows[:, DEPTH] = np.minimum(room, DEPTH)
    order = np.argsort(rows.view(f"V{DEPTH + 1}").ravel())
    rows, room = rows[order, :DEPTH], np.minimum(room[order], DEPTH)
    lcp = np.zeros(len(at), np.int64)
    differ = rows[1:] != rows[:-1]
    where = differ.argmax(axis=1)
    where[~differ[np.arange(len(where)), where]] = DEPTH
    lcp[1:] = np.minimum(where, np.minimum(room[1:], room[:-1]))
    return order, lcp


def maximal_repeats(body: np.ndarray, at: np.ndarray, room: np.ndarray, before: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left- and right-maximal repeats of at least `span` bytes, and all of DEPTH bytes: lengths, bounds into the suffixes, and the suffixes, group by group.

    before: the byte before each suffix, or -1 where its segment begins, which counts as different from any.
    """
    order, lcp = enhanced_suffix_array(body, at, room)
    lcp[lcp < span] = 0
    inside = lcp > 0
    inside[:-1] |= inside[1:].copy()
    order, lcp = order[inside], lcp[inside]
    depth, first, last = (np.array(x, np.int64) for x in lcp_intervals(lcp.tolist()))
    if not len(depth):
        return depth, np.zeros(1, np.int64), depth
    ends = np.stack([first, last + 1], axis=1).ravel()
    b = np.append(before[order], 0)  # so that an end may be the array's
    low, high = np.minimum.reduceat(b, ends)[::2], np.maximum.reduceat(b, ends)[::2]
    diverse = (low != high) | (low < 0) | (depth >= DEPTH)  # beyond DEPTH the order does not tell how far they go on
    depth, first, last = depth[diverse], first[diverse], last[diverse]
    count = last - first + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    return depth, bounds, order[np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])]


def least_by_window(body: np.ndarray, start: np.ndarray, windows: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """For every window of the segments the least doc_id of any segment that has the window's bytes."""
    n = int(windows.sum())
    seg = np.repeat(np.arange(len(start)), windows)
    first = np.cumsum(windows) - windows
    inner = np.arange(n) - first[seg]
    at, room = start[seg] + inner, windows[seg] + (span - 1) - inner
    before = np.where(inner > 0, body[np.maximum(at - 1, 0)].astype(np.int64), -1)
    out = least[seg].copy()
    depth, bounds, member = maximal_repeats(body, at, room, before, span)
    if not len(depth):
        return out
    low = np.repeat(np.minimum.reduceat(out[member], bounds[:-1]), np.diff(bounds))
    over = np.repeat(depth, np.diff(bounds)) - span
    for t in range(int(over.max()) + 1):
        reach = over >= t
        np.minimum.at(out, member[reach] + t, low[reach])
    return out


def _judge(span: int, batch_windows: int, table: pa.Table) -> pa.Table:
    rows = list(zip(*(table[c].to_pylist() for c in ("block", "shard", "anchors", "sizes", "least", "body")), strict=True))
    unpress = zstandard.ZstdDecompressor()
    anchor = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
    sizes = [unpacked(r[3]).astype(np.int64) for r in rows]
    ptr = np.cumsum([0, *map(len, sizes)])
    size = np.concatenate(sizes)
    least = np.concatenate([unpacked(r[4]).astype(np.int64) for r in rows])
    body = np.frombuffer(b"".join([unpress.decompress(r[5]) for r in rows]), np.uint8)
    start = np.cumsum(size) - size
    content = np.concatenate([span_hash(prefix(body[start[a] : start[b - 1] + size[b - 1]]), start[a:b] - start[a], start[a:b] - start[a] + size[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)])
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    one, low = order[at], np.minimum.reduceat(least[order], at)
    group = np.cumsum(np.r_[True, a[at][1:] != a[at][:-1]]) - 1
    windows = size[one] - (span - 1)
    mixed = np.flatnonzero((np.bincount(group) > 1)[group])  # segments that share a hash, yet are not all equal
    result = {}
    edge = np.r_[0, np.flatnonzero(group[mixed][1:] != group[mixed][:-1]) + 1, len(mixed)]  # hashes stay together
    total = np.r_[0, np.cumsum(windows[mixed])][edge]
    lo = 0
    while lo < len(edge) - 1 and len(mixed):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + batch_windows, "right")) - 1)
        part = mixed[edge[lo] : edge[hi]]
        mine = np.concatenate([body[x : x + y] for x, y in zip(start[one[part]].tolist(), size[one[part]].tolist(), strict=True)])
        begin = np.cumsum(size[one[part]]) - size[one[part]]
        got = least_by_window(mine, begin, windows[part], low[part], span)
        seg = np.repeat(np.arange(len(part)), windows[part])
        turn = np.flatnonzero(np.r_[True, (got[1:] != got[:-1]) | (seg[1:] != seg[:-1])])
        result[lo] = (part, seg[turn], np.diff(np.append(turn, len(got))), got[turn])
        lo = hi
    # runs of windows with one least doc_id, of all distinct segments in order
    plain = np.ones(len(one), bool)
    plain[mixed] = False
    plain = np.flatnonzero(plain)
    of = np.concatenate([plain, *[r[0][r[1]] for r in result.values()]])
    width = np.concatenate([windows[plain], *[r[2] for r in result.values()]])
    value = np.concatenate([low[plain], *[r[3] for r in result.values()]])
    order = np.argsort(of, kind="stable")
    width, value, per = width[order], value[order], np.bincount(of, minlength=len(one))
    first = np.cumsum(per) - per
    out = []
    for r, x, y in zip(rows, ptr[:-1], ptr[1:], strict=True):
        mine = number[x:y]
        index = np.repeat(first[mine] - (np.cumsum(per[mine]) - per[mine]), per[mine]) + np.arange(per[mine].sum())
        out.append((r[0], r[1], packed(per[mine]), packed(width[index]), value[index].tobytes()))
    return table_of(out, VERDICTS)


# --- third pass: cutting -------------------------------------------------------------------------------------------


def _whole_characters(gone: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of the bytes to remove those whose whole character is to be removed."""
    begins = (buf & 0xC0) != 0x80
    begins[off[:-1][off[:-1] < len(buf)]] = True
    at = np.flatnonzero(begins)
    return np.repeat(np.logical_and.reduceat(gone, at), np.diff(np.append(at, len(buf)))) if len(at) else gone


def _cut_repeats(n: int, id_name: str, span: int, k: int, characters: bool, schema: pa.Schema, left: pa.Table, marks: pa.Table, verdicts: pa.Table) -> pa.Table:
    parts = []
    for number, block in _blocks(left, id_name, span, k):
        some, distinct, one, _ = block.marked(marks, n)
        given = {s: (unpacked(c).astype(np.int64), unpacked(w).astype(np.int64), np.frombuffer(v, np.int64)) for s, c, w, v in zip(*(verdicts[c].to_pylist() for c in ("shard", "counts", "widths", "least")), strict=True)}
        ordered = [given[s] for s in sorted(given)]
        per, width, value = (np.concatenate([o[i] for o in ordered]) if ordered else np.zeros(0, np.int64) for i in range(3))
        assert len(per) == len(one), "a block's segments changed between passes"
        begin = np.cumsum(width) - width
        first = np.cumsum(per) - per
        base = np.repeat(begin[first] if len(first) else first, per)
        inner = begin - base  # window of its segment at which each run begins
        count = per[distinct]
        which = np.repeat(np.arange(len(some)), count)
        run = np.repeat(first[distinct] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        cut_it = value[run] < block.ids[block.doc[some[which]]]
        which, run = which[cut_it], run[cut_it]
        x = block.start[some[which]] + inner[run]
        steps = np.bincount(x, minlength=len(block.buf) + 1) - np.bincount(x + width[run] + (span - 1), minlength=len(block.buf) + 1)
        gone = np.cumsum(steps)[:-1] > 0
        if characters:
            gone = _whole_characters(gone, block.buf, block.off)
        _, _, ptr = runs(gone, block.off)
        kept = np.concatenate([[0], np.cumsum(~gone)])[block.off]
        n_bytes = np.diff(block.off)
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_bytes), [None, pa.py_buffer(kept.astype(np.int64).tobytes()), pa.py_buffer(block.buf[~gone].tobytes())])
        parts.append(pa.Table.from_arrays([block.rest.cast(schema.field(0).type), pa.array(n_bytes), pa.array(n_bytes - np.diff(kept)), pa.array(np.diff(ptr)), body.cast(pa.binary())], schema=schema))
    return pa.concat_tables(parts) if parts else schema.empty_table()


def remove_repeats(docs: DataFrame, span: int = SPAN, k: int = GRAM, doc_id: str = "doc_id", text: str = "text", batch_windows: int = 200_000, characters: bool = False) -> DataFrame:
    """`rest` (every other column, as a struct), n_bytes, n_removed, n_spans and `kept`, the remaining bytes.

    characters: a character that lies only partly in repeats stays, so that what remains is text.
    """
    n = shards_for(docs, text, 256 << 20)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest")
    blocks = cut(docs.select(rest, F.col(text).alias("text")).mapInArrow(lambda it: _to_blocks(it), BLOCKS))
    calls = blocks.mapInArrow(partial(_announce, n, doc_id, span, k), CALLS)
    marks = cut(calls.groupBy("shard").applyInArrow(lambda t: _shared(t), MARKS))
    both = lambda other: blocks.groupBy("block").cogroup(other.groupBy("block"))
    pieces = both(marks).applyInArrow(lambda a, b: _send(n, doc_id, span, k, a, b), PIECES)
    verdicts = pieces.groupBy("shard").applyInArrow(lambda t: _judge(span, batch_windows, t), VERDICTS)
    replies = verdicts.selectExpr("block", "shard", "counts", "widths", "least", "cast(null as binary) as bits").unionByName(marks.selectExpr("block", "shard", "cast(null as binary) as counts", "cast(null as binary) as widths", "cast(null as binary) as least", "bits"))
    out = T.StructType([T.StructField("rest", docs.select(rest).schema["rest"].dataType), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept", T.BinaryType())])
    schema = to_arrow_schema(out)

    def finish(a, b):
        said = b.filter(pc.is_valid(b["counts"]))
        return _cut_repeats(n, doc_id, span, k, characters, schema, a, b.filter(pc.is_valid(b["bits"])), said)

    return both(replies).applyInArrow(finish, out)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeats, in their own columns; `n_chars`, if there is one, is counted again.

    Cuts are shortened to whole characters. A document of which nothing is left is dropped.
    """
    found = remove_repeats(docs, doc_id=doc_id, text=text, characters=True)
    rows = found.where("n_removed = 0 or n_removed < n_bytes").select("rest.*", F.col("kept").cast("string").alias(text))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
