"""Token counts without token ids: pieces once per distinct pre-token, joined to per-document frequencies.

A pre-token here is a run of white space with the run of other characters after it. The tokenizer's own
pre-tokenization never joins characters across the end of such a unit, so its tokens are those of its units, whatever
its pattern does inside them; where a boundary is in doubt (next to characters that may be white space outside ASCII)
two units stay one, which is always right.

A first pass cuts the texts into units by array operations and deals, per shard of the hash space, the distinct unit
strings of a block of documents and its (document, unit, frequency) triples as packed arrays. Each shard counts every
distinct unit once and returns a sum per document; the sums of all shards are added up. A unit that a sixteenth of a
block's documents have goes to the block's own shard instead of its hash's, so a unit that is everywhere is counted
once a shard and its triples are spread over all of them.

Defined results: null and empty texts have 0 tokens; a text of any length is counted whole; repeated rows are counted each; an empty table gives no rows;
the result has its own columns only.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from functools import cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SPACES, batch_of, chunks, owner, packed, prefix, span_hash, table_of, unpacked
from .support import shards_for

DEALT = "shard int, block long, meta binary, docs binary, freqs binary, counts binary, sizes binary, strings binary"
SUMS = "block long, meta binary, docs binary, sums binary"
BLOCK_BYTES = 2 << 20


def unit_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where units begin: at texts' starts, and at white space that follows a character that surely is none."""
    space = SPACES[buf]
    sure = ~space & ((buf >= 0x21) & (buf < 0x7F))
    # of characters outside ASCII only two-byte ones from U+00C0 on are surely no white space
    sure[1:] |= (buf[1:] >= 0x80) & (buf[1:] < 0xC0) & (buf[:-1] >= 0xC3) & (buf[:-1] < 0xE0)
    begins = np.zeros(len(buf) + 1, bool)
    begins[1:-1] = space[1:] & sure[:-1]
    begins[off] = True
    begins[-1] = False
    return np.flatnonzero(begins)


def _first(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def count_units(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, unit hash, frequency) triples, and a place (start, end) of each distinct unit, in order of hash."""
    start = unit_starts(buf, off)
    end = np.append(start[1:], len(buf))
    doc = owner(np.searchsorted(start, off))
    h = span_hash(prefix(buf), start, end)
    order = np.lexsort((doc, h))
    h, doc, start, end = h[order], doc[order], start[order], end[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    freq = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    one = _first(h)
    return doc.astype(np.int32), h, freq.astype(np.int32), one, start[at][one], end[at][one]


def _deal(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and shard: documents and frequencies by unit, and the distinct units themselves."""
    limits = np.array([(s << 64) // n for s in range(1, n)], np.uint64)
    press = zstandard.ZstdCompressor(level=1)
    for block, (batch, buf, off) in enumerate(chunks(batches, limit=BLOCK_BYTES), TaskContext.get().partitionId() << 32):
        own = ((block >> 32) * 7919 + block % (1 << 32)) % n  # the block's own shard
        doc, h, freq, one, start, end = count_units(buf, off)
        counts = np.diff(np.append(one, len(h))).astype(np.int32)
        home = np.where(counts * 16 > max(len(off) - 1, 32), own, np.searchsorted(limits, h[one], "right"))
        order = np.argsort(home, kind="stable")
        doc, freq = (x[np.argsort(np.repeat(home, counts), kind="stable")] for x in (doc, freq))
        counts, start, end, units = counts[order], start[order], end[order], np.searchsorted(home[order], np.arange(n + 1))
        rows = np.append(0, np.cumsum(counts))[units]
        ids = batch.column(0)
        meta = pickle.dumps((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), np.diff(off)))
        out: list[tuple] = []
        for s in range(n):
            a, b, ua, ub = rows[s], rows[s + 1], units[s], units[s + 1]
            if a == b and s != own:
                continue
            docs = doc[a:b].astype(np.uint16 if len(off) <= 65536 else np.int32)
            texts = b"".join([buf[x:y].tobytes() for x, y in zip(start[ua:ub].tolist(), end[ua:ub].tolist(), strict=True)])
            out.append((s, block, meta if s == own else None, *map(packed, (docs, freq[a:b], counts[ua:ub], end[ua:ub] - start[ua:ub])), press.compress(texts)))
        yield batch_of(out, DEALT)


def _count_shard(tokenizer_file: str, table: pa.Table) -> pa.Table:
    """Counts every distinct unit of a shard once; returns the sums of its documents, block by block."""
    unpress = zstandard.ZstdDecompressor()
    sizes = [unpacked(x).astype(np.int64) for x in table["sizes"].to_pylist()]
    bodies = [unpress.decompress(x) for x in table["strings"].to_pylist()]
    hashes = [span_hash(prefix(np.frombuffer(t, np.uint8)), np.cumsum(n) - n, np.cumsum(n)) for t, n in zip(bodies, sizes, strict=True)]
    known, where = np.unique(np.concatenate(hashes), return_index=True)
    sizes, texts = np.concatenate(sizes), b"".join(bodies)
    ends = np.cumsum(sizes)
    pieces = piece_counts(tokenizer_file, (texts[e - s : e].decode() for s, e in zip(sizes[where].tolist(), ends[where].tolist(), strict=True)), len(known))
    out = []
    for block, meta, docs, freqs, counts, own in zip(*(table[c].to_pylist() for c in ("block", "meta", "docs", "freqs", "counts")), hashes, strict=True):
        docs, freqs, counts = map(unpacked, (docs, freqs, counts))
        each = np.repeat(pieces[np.searchsorted(known, own)], counts) * freqs
        sums = np.bincount(docs, each, 1).astype(np.int64)
        some = np.flatnonzero(sums)
        out.append((block, meta, packed(some.astype(np.int32)), packed(sums[some])))
    return table_of(out, SUMS)


@cache
def load(tokenizer_file: str):
    """The tokenizer, once per worker; Spark's tasks are the only threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_counts(tokenizer_file: str, texts: Iterator[str], n: int) -> np.ndarray:
    """Number of tokens of each text; special strings are handled as the tokenizer's file says."""
    tokenizer = load(tokenizer_file)
    out = np.zeros(n, np.int64)
    for low in range(0, n, 4096):
        some = list(islice(texts, 4096))
        out[low : low + len(some)] = [len(e) for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    return out


def _total(table: pa.Table) -> pa.Table:
    """The documents of one block with the sums of all shards."""
    ids, valid, n_bytes = pickle.loads(next(m for m in table["meta"].to_pylist() if m is not None))
    total = np.zeros(len(ids), np.int64)
    for docs, sums in zip(table["docs"].to_pylist(), table["sums"].to_pylist(), strict=True):
        total[unpacked(docs)] += unpacked(sums)
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~valid), "n_bytes": n_bytes.astype(np.int64), "n_tokens": total})


def token_counts(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; `tokenizer_file`: a tokenizers JSON that workers can read."""
    n = shards_for(docs, text, 256 << 20)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.mapInArrow(partial(_deal, n), DEALT)
    sums = dealt.groupBy("shard").applyInArrow(lambda t: _count_shard(tokenizer_file, t), SUMS)
    total = sums.groupBy("block").applyInArrow(lambda t: _total(t), "doc_id long, n_bytes long, n_tokens long")
    return total.withColumn("over_limit", F.col("n_tokens") > limit)
