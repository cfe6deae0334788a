"""Array kernels on Arrow batches of texts; nothing here knows Spark.

All work on the bytes of many texts at once: `buf` is a uint8 array with the texts end to end, `off` the int64
offsets at which they start, with the total as its last value. No kernel ever looks across a text's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
INV = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES  # words [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)  # of lower-cased bytes: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most `limit` bytes of text (or one text): the slice, its bytes, its offsets."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        if col.null_count:
            col = col.fill_null(b"")
        n = len(col)
        if not n:
            continue
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and off[-1] else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i for i < n at least, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:  # a very long text's powers are not kept
            _powers[int(base)] = have
    return have


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; with `span_hash` they give the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf) + 1)[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((pre[end] - pre[start]) * powers(INV, len(pre))[start] + (end - start).astype(np.uint64) * MULT)


def runs(flags: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of set flags inside texts: starts, ends, and for each text the index of its first run (one more at the end)."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | cut[1:n]
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | cut[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def owner(ptr: np.ndarray) -> np.ndarray:
    """The text of each run or item, from the pointers to the first of each text."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def word_hashes(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (runs of bytes in `table`), and the pointers to each text's first word."""
    start, end, ptr = runs(table[buf], off)
    return span_hash(prefix(buf), start, end), start, end, ptr


def grams(words: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words for each position that has n words left in its text, and those positions."""
    left = np.repeat(ptr[1:], np.diff(ptr)) - np.arange(len(words))
    at = np.flatnonzero(left >= n)
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = (h + words[at + i]) * MULT
        h ^= h >> np.uint64(29)
    return mix(h), at


def row_ids(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types, as tasks need it, who have no session."""
    return pa.schema([(n, ARROW_TYPES[t]) for n, t in (f.split() for f in ddl.split(","))])


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = schema_of(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def table_of(rows: list[tuple], ddl: str) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows, ddl)])


def packed(x: np.ndarray) -> bytes:
    """An array of natural numbers in the narrowest unsigned type that holds it, after that type's letter."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in "BHIQ" if top < 1 << (8 * np.dtype(k).itemsize))
    return kind.encode() + x.astype(kind).tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, x[:1].decode(), offset=1)
