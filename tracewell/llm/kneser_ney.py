"""Interpolated modified Kneser-Ney bigram models: counted in Spark, kept as sorted hash arrays, scored by workers.

    p(w | u) = max(c(u, w) - D(c), 0) / T(u) + g(u) p(w)        g(u) = (D1 n1 + D2 n2 + D3 n3)(u) / T(u)
    p(w)     = max(a(w) - D(a), 0) / A + g / (V + 1)            a(w): distinct words before w; A: all of them

with three discounts for each order from its counts of counts. Each text is its words and one end, which counts as a
token; before its first token stands a beginning that does not. A word that training has not seen has the uniform
share, g / (V + 1).

Counting: tasks sum the bigrams of blocks of text and deal them as packed arrays. A first word has a thirty-second of
the shards for its bigrams (one at least), which the pair's hash chooses from, so no word fills a shard however many
there are. A shard sums them, writes its bigrams as two sorted arrays (hash, count), and deals the totals of first
words, and how many distinct words stand before each second word, by the word's hash; that shard adds them up and
writes the word arrays. A frequent word is one entry per block, whatever its count. Workers map the arrays into memory
and look tokens up in order of hash, so that they read a file once per block of documents, and only the parts they
need; they keep at most `OPEN_FILES` maps, or `OPEN_BYTES` where the folder can only be read.

Texts of any length are one text; counts have 64 bits where 32 do not hold them.

Words count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, MULT, NOT_SPACE, batch_of, chunks, mix, packed, table_of, unpacked, word_hashes
from .support import shared_dir, shards_for

END, BEGIN = np.uint64(0xE4D0E4D0E4D0E4D0), np.uint64(0xBE61BE61BE61BE61)
BLOCK_TOKENS = 1 << 20
SLICE = 1 << 18
OPEN_FILES, OPEN_BYTES = 2048, 256 << 20
PAIRS = "shard int, first binary, sizes binary, second binary, counts binary"
WORDS = "shard int, kind int, words binary, values binary, stats binary"
DONE = "shard int, counted boolean, stats binary"


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def pair_shard(u: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The shard of a bigram with first word u and hash h."""
    spread = max(1, n // 32)
    return (shard_of(u, n) + (h % np.uint64(spread)).astype(np.int64) * (n // spread)) % n


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(u * MULT + mix(w))


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of each text, its end included, and the pointers to each text's first token."""
    words, ptrs, base, lo = [], [np.zeros(1, np.int64)], 0, 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        h, _, _, ptr = word_hashes(LOWER[buf[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], NOT_SPACE)
        words.append(np.insert(h, ptr[1:], END))
        ptrs.append(ptr[1:] + np.arange(1, len(ptr)) + base)
        base += len(words[-1])
        lo = hi
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.concatenate(ptrs)


def histories(t: np.ndarray, ptr: np.ndarray, begin: np.ndarray | np.uint64 = BEGIN) -> np.ndarray:
    """The token before each token; at a text's start, the beginning."""
    u = np.empty_like(t)
    u[1:] = t[:-1]
    u[ptr[:-1]] = begin
    return u


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sum_pairs(u: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of (u, w) and their summed counts."""
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    at = _starts(u, w)
    if c is None:
        return u[at], w[at], np.diff(np.append(at, len(u)))
    return u[at], w[at], np.add.reduceat(c[order], at) if len(at) else np.zeros(0, np.int64)


def deal_pairs(u: np.ndarray, w: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of PAIRS for a block's bigrams."""
    u, w, c = sum_pairs(u, w)
    shard = pair_shard(u, pair_hash(u, w), n)
    order = np.argsort(shard, kind="stable")
    u, w, c = u[order], w[order], c[order]
    ends = np.searchsorted(shard[order], np.arange(n + 1))
    for s in range(n):
        a, b = ends[s], ends[s + 1]
        if a < b:
            at = _starts(u[a:b])
            yield s, u[a:b][at].tobytes(), packed(np.diff(np.append(at, b - a))), w[a:b].tobytes(), packed(c[a:b])


# --- arrays in the shared folder -----------------------------------------------------------------------------------


def put(uri: str, array: np.ndarray) -> None:
    """Writes an array; a file appears whole or not at all, and a task that runs again writes the same."""
    fs, path = pa.fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{os.path.abspath(uri)}")
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(part, path)


def get(uri: str, kind) -> np.ndarray:
    """Maps an array into memory where the shared folder is a mounted one, else reads it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return np.memmap(parts.path, kind, "r") if os.path.getsize(parts.path) else np.zeros(0, kind)
    fs, path = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


# --- counting ------------------------------------------------------------------------------------------------------


def _merge(n: int, folder: str, table: pa.Table) -> pa.Table:
    """Sums a shard's bigrams, writes them, and deals out what words need of them."""
    us, ws, cs = [], [], []
    for first, sizes, second, counts in zip(*(table[c].to_pylist() for c in ("first", "sizes", "second", "counts")), strict=True):
        us.append(np.repeat(np.frombuffer(first, np.uint64), unpacked(sizes)))
        ws.append(np.frombuffer(second, np.uint64))
        cs.append(unpacked(counts).astype(np.int64))
    u, w, c = sum_pairs(np.concatenate(us), np.concatenate(ws), np.concatenate(cs))
    shard = int(table["shard"][0].as_py())
    h = pair_hash(u, w)
    order = np.argsort(h)
    put(f"{folder}/pair-{shard}.keys", h[order])
    put(f"{folder}/pair-{shard}.counts", c[order].astype(np.uint32 if c.max() < 1 << 32 else np.uint64))
    at = _starts(u)
    own = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c > 2)], axis=1)
    stats = np.array([(c == k).sum() for k in (1, 2, 3, 4)] + [len(c)], np.int64)
    home = shard_of(u[at], n)
    edge = np.searchsorted(home, np.arange(n + 1))  # u is in order, and so are its shards
    rows = [(s, 0, u[at][a:b].tobytes(), own[a:b].tobytes(), None) for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < b and s != shard]
    rows.append((shard, 0, u[at][edge[shard] : edge[shard + 1]].tobytes(), own[edge[shard] : edge[shard + 1]].tobytes(), stats.tobytes()))
    seen, before = np.unique(w, return_counts=True)
    ends = np.searchsorted(shard_of(seen, n), np.arange(n + 1))
    for s, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a < b:
            rows.append((s, 1, seen[a:b].tobytes(), packed(before[a:b]), None))
    return table_of(rows, WORDS)


def _words(folder: str, table: pa.Table) -> pa.Table:
    """Writes a shard's words: hash, then T, n1, n2, n3 as a history and the distinct words before it."""
    keys, values, pairs, counted = [], [], np.zeros(5, np.int64), False
    for kind, words, given, stats in zip(*(table[c].to_pylist() for c in ("kind", "words", "values", "stats")), strict=True):
        w = np.frombuffer(words, np.uint64)
        v = np.zeros((len(w), 5), np.int64)
        if kind == 0:
            v[:, :4] = np.frombuffer(given, np.int64).reshape(-1, 4)
            if stats is not None:
                pairs, counted = np.frombuffer(stats, np.int64), True
        else:
            v[:, 4] = unpacked(given)
        keys.append(w)
        values.append(v)
    key, value = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key, at = key[order], _starts(key[order])
    value = np.add.reduceat(value[order], at, axis=0) if len(at) else value
    shard, a = int(table["shard"][0].as_py()), value[:, 4]
    put(f"{folder}/word-{shard}.keys", key[at])
    for k in range(5):
        put(f"{folder}/word-{shard}.{k}", value[:, k])
    is_begin = key[at] == BEGIN
    total = [int(value[~is_begin, 0].sum()), int(value[is_begin, 0].sum()), int((a > 0).sum()), int(a.sum())] + [int((a == k).sum()) for k in (1, 2, 3, 4)]
    return table_of([(shard, counted, np.array(total + pairs.tolist(), np.int64).tobytes())], DONE)


@dataclass
class Model:
    """Where the arrays are, and what all shards sum up to."""

    folder: str
    shards: int
    have: dict  #: by kind of array the shards that there are
    n_tokens: int
    n_words: int
    n_before: int
    d_pair: tuple
    d_word: tuple
    spread: float  #: mass that discounting the words leaves to all words alike
    ends: int
    opened: dict = field(default_factory=dict)

    def array(self, name: str, kind) -> np.ndarray:
        """An array of a shard; those used last are let go when too many are held."""
        uri = f"{self.folder}/{name}"
        found = self.opened.pop(uri, None)
        if found is None:
            found = get(uri, np.uint8)
            while self.opened and (len(self.opened) >= OPEN_FILES or sum(x.nbytes for x in self.opened.values() if not isinstance(x, np.memmap)) > OPEN_BYTES):
                del self.opened[next(iter(self.opened))]
        self.opened[uri] = found
        return found.view(kind)

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def find(self, kind: str, shard: np.ndarray, h: np.ndarray, columns: list[tuple[str, type]]) -> list[np.ndarray]:
        """Values of each column at the hashes `h`, 0 where absent; every shard's array is gone through in order."""
        out = [np.zeros(len(h), np.int64) for _ in columns]
        order = np.lexsort((h, shard))
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            if s not in self.have[kind]:
                continue
            mine = order[edges[s] : edges[s + 1]]
            keys = self.array(f"{kind}-{s}.keys", np.uint64)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[mine]), len(keys) - 1)
            hit = keys[at] == h[mine]
            mine, at = mine[hit], at[hit]
            for o, (name, type_) in zip(out, columns, strict=True):
                if type_ is None:  # the narrower of two widths that holds a shard's counts
                    type_ = np.uint32 if self.array(f"{kind}-{s}.{name}", np.uint8).nbytes == 4 * len(keys) else np.uint64
                o[mine] = self.array(f"{kind}-{s}.{name}", type_)[at]
        return out


def discount(c: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def discounts(counts_of_counts: np.ndarray) -> tuple:
    """The three modified Kneser-Ney discounts; fixed ones where the data are too few to give any."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts)
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= x <= k for k, x in enumerate(d, 1)):
            return d
    return 0.5, 1.0, 1.5


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts a model over all rows of docs and writes its arrays to the shared folder."""
    n = shards_for(docs, text, 128 << 20)
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/lm-{uuid.uuid4().hex}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, ws, held = [], [], 0
        for _, buf, off in chunks(batches, text):
            t, ptr = tokens(buf, off)
            us.append(histories(t, ptr))
            ws.append(t)
            held += len(t)
            if held >= BLOCK_TOKENS:
                yield batch_of(list(deal_pairs(np.concatenate(us), np.concatenate(ws), n)), PAIRS)
                us, ws, held = [], [], 0
        if held:
            yield batch_of(list(deal_pairs(np.concatenate(us), np.concatenate(ws), n)), PAIRS)

    pairs = docs.select(F.col(text).alias(text)).mapInArrow(count, PAIRS)
    parts = pairs.groupBy("shard").applyInArrow(lambda t: _merge(n, folder, t), WORDS)
    done = parts.groupBy("shard").applyInArrow(lambda t: _words(folder, t), DONE).collect()  # one row a shard
    return model_of(folder, n, done)


def model_of(folder: str, n: int, done: list) -> Model:
    """The model whose n shards are in the folder, from the rows of DONE."""
    stats = np.sum([np.frombuffer(r["stats"], np.int64) for r in done] or [np.zeros(13, np.int64)], axis=0)
    words, ends, seen, before = stats[:4].tolist()
    d_word = discounts(stats[4:8])
    many = seen - stats[4] - stats[5]
    left = float(d_word[0] * stats[4] + d_word[1] * stats[5] + d_word[2] * many) / before if before else 1.0
    return Model(folder, n, {"word": {r["shard"] for r in done}, "pair": {r["shard"] for r in done if r["counted"]}}, words + ends, seen, before, discounts(stats[8:12]), d_word, left, ends)


# --- scoring -------------------------------------------------------------------------------------------------------


def word_stats(model: Model, w: np.ndarray, columns: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the word arrays for the distinct words of `w`, and each one's place among those."""
    one, where = np.unique(w, return_inverse=True)
    return model.find("word", shard_of(one, model.shards), one, [(str(k), np.int64) for k in columns]), where


def token_scores(model: Model, t: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 p of every token given the one before it; and every token's training count."""
    u = histories(t, ptr)
    one, where = np.unique(np.concatenate([t, u]), return_inverse=True)
    total, n1, n2, n3, before = model.find("word", shard_of(one, model.shards), one, [(str(k), np.int64) for k in range(5)])
    seen = total.copy()
    seen[one == END] = model.ends
    a_mass = max(model.n_before, 1)
    p_word = np.maximum(before - discount(before, model.d_word), 0) / a_mass + model.spread / (model.n_words + 1)
    d = model.d_pair
    left = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
    wt, wu = where[: len(t)], where[len(t) :]
    h = pair_hash(t[:0], t[:0]) if not len(t) else pair_hash(u, t)
    (c,) = model.find("pair", pair_shard(u, h, model.shards), h, [("counts", None)])
    p = np.maximum(c - discount(c, d), 0) / np.maximum(total[wu], 1) + left[wu] * p_word[wt]
    return np.log10(p), seen[wt]


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score (add-one unigrams) and score (the model's log10 probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, buf, off in chunks(batches):
            t, ptr = tokens(buf, off)
            logp, seen = token_scores(model, t, ptr)
            base = np.log10((seen + 1) / (model.n_tokens + model.n_words + 1))
            sums = [np.add.reduceat(x, ptr[:-1]) for x in ((seen > 0).astype(np.int64), base, logp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ptr)), *map(pa.array, sums)], names=[f.split()[0] for f in SCORES.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCORES)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))
