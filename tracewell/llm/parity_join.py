"""Jaccard join of word shingles by parity sketches, with components of the linked documents.

A text's distinct shingles each toggle one bit of a sketch; two sketches differ in at most as many bits as the sets
have shingles apart. The sketch is cut into more blocks than a linked pair may have differences, so that some block
of both is equal: texts are joined on block fingerprints, per band of set sizes. Of a text's blocks only the heaviest
are used (see `block_keys`), which loses no pair and spares the blocks of one or two shingles that many texts share.

Equal sets are one node from the start, so copies are never paired with each other. Buckets give a star of candidate
edges; its components, the candidate clusters, are closed under linking. The sets of a cluster meet in one task, or,
beyond `tile_sets` members or `tile_shingles` shingles, in one task for each pair of tiles. There, Hamming distances of
parity sketches rule pairs out, the others are compared exactly, and pairs that links already join are skipped. What
leaves a task is a spanning forest, so no group's pairs are ever emitted.

One block in common is little, so with more texts chance chains ever more of them into one cluster, whose tiles would grow
with its square. The sets of clusters of several tiles are therefore looked up again with their sketches (about a bit for
each shingle) beside their keys: only pairs of a bucket that the sketches do not rule out are edges then, and a linked
pair is always one. What is left of such a cluster is tiled.

Shingles count as equal if their 64-bit hashes are. Defined results: a null or empty text has 0 shingles and is its
own component; fewer words than a shingle has make one shingle; repeated rows are linked like copies; a null doc_id is linked
but never names a component of others, and its component is null if no other row is in it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import LOWER, MULT, NOT_SPACE, batch_of, chunks, grams, mix, owner, packed, row_ids, schema_of, table_of, unpacked, word_hashes
from .support import cut, shards_for


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, end to end, and the pointers to each text's first.

    A text of fewer than n words, but not none, has its whole sequence of words as its only shingle.
    """
    words, _, _, ptr = word_hashes(LOWER[buf], off, NOT_SPACE)
    h, at = grams(words, ptr, n)
    doc = owner(ptr)[at]
    count = np.diff(ptr)
    few = np.flatnonzero((count > 0) & (count < n))
    for k in range(1, n):  # whole sequences of k words
        own = few[count[few] == k]
        if len(own):
            whole, _ = grams(words[(ptr[own][:, None] + np.arange(k)).ravel()], np.arange(len(own) + 1) * k, k)
            h, doc = np.append(h, mix(whole ^ np.uint64(k))), np.append(doc, own)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(off)))


class Bands:
    """Size bands: band k serves every pair whose smaller set has low[k] to low[k + 1] - 1 shingles.

    Sets that reach `percent` have at most least * (100 - percent) / percent shingles outside their intersection,
    `least` being the smaller one's size; so with more blocks than that, some block of both is the same.
    """

    def __init__(self, percent: int, ratio: float = 1.3, top: int = 1 << 40):
        weight = 0.865 * percent / (100 - percent)  # mean shingles of a block
        first = -(-percent // (100 - percent))  # smaller sets are linked only if equal
        low = [first]
        while low[-1] < top:
            low.append(max(low[-1] + 1, int(low[-1] * ratio)))
        self.low = np.array(low, np.int64)
        most = self.low[1:] - 1
        self.high = most * 100 // percent
        self.changes = most * (100 - percent) // percent
        self.blocks = np.maximum(self.changes + 1, ((self.low[:-1] + self.high) / 2 / weight).astype(np.int64))


def block_keys(h: np.ndarray, ptr: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of the blocks by which each text is looked up: in every band it may have partners in, its
    changes + 1 heaviest blocks. Of two sets' common blocks the heaviest is among those of both."""
    return banded_keys(h, ptr, bands)[:2]


def banded_keys(h: np.ndarray, ptr: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block keys, their texts and their bands."""
    size = np.diff(ptr)
    own = np.searchsorted(bands.low, size, "right") - 1
    keys, docs, of = [], [], []
    for back in range(len(bands.low)):  # until no set is small enough
        band = own - back
        member = np.flatnonzero((band >= 0) & (size <= bands.high[np.maximum(band, 0)]))
        if not len(member):
            if back:
                break
            continue
        band = band[member]
        m = bands.blocks[band]
        start = np.concatenate([[0], np.cumsum(m)])
        n = size[member]
        at = np.repeat(ptr[member] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        bits = mix(h[at] + np.repeat(band.astype(np.uint64) * MULT, n))
        block = ((bits >> np.uint64(32)) * np.repeat(m, n).astype(np.uint64)) >> np.uint64(32)
        seg = np.repeat(start[:-1], n) + block.astype(np.int64)
        parity = np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(parity, seg, bits)
        weight = np.bincount(seg, minlength=start[-1])
        doc = np.repeat(np.arange(len(member)), m)
        number = np.arange(start[-1]) - start[doc]
        parity = mix(parity + mix(number.astype(np.uint64) * MULT + band[doc].astype(np.uint64)))
        order = np.lexsort((parity, -weight, doc))
        rank = np.arange(len(order)) - start[doc]  # doc is sorted, so ranks run from 0 in each
        take = rank <= bands.changes[band][doc]
        keys.append(parity[order][take])
        docs.append(member[doc[take]])
        of.append(band[doc[take]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(of)


KEYS = "shard int, keys binary, texts binary, sids binary, members binary"
FOUND = "kind int, x long, y long, n long"
SETS = "sid long, doc long, hashes binary"


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_ids(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """One value for each distinct set: equal sets have equal ids."""
    n = np.diff(ptr)
    doc = owner(ptr)
    both = np.zeros(len(n), np.uint64)
    np.bitwise_xor.at(both, doc, mix(h * MULT))
    total = np.zeros(len(n), np.uint64)
    np.add.at(total, doc, mix(h ^ MULT))
    return mix(both ^ mix(total + n.astype(np.uint64) * MULT))


def _sign(n_shards: int, percent: int, n_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of texts and shard: the block keys that fall there, and by whom they are used."""
    bands = Bands(percent)
    limits = np.array([(s << 64) // n_shards for s in range(1, n_shards)], np.uint64)
    for number, (batch, buf, off) in enumerate(chunks(batches, limit=4 << 20), TaskContext.get().partitionId()):
        h, ptr = shingle_sets(buf, off, n_words)
        size, sid = np.diff(ptr), set_ids(h, ptr)
        ids = batch.column(0)
        members = pickle.dumps((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False), signed(sid), size))
        one = np.sort(np.unique(sid, return_index=True)[1])  # of equal sets, the first looks for partners
        kept = np.repeat(ptr[one], size[one]) + np.arange(size[one].sum()) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
        keys, text = block_keys(h[kept], np.concatenate([[0], np.cumsum(size[one])]), bands)
        order = np.argsort(keys)
        keys, text = keys[order], text[order]
        rows = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
        out = []
        for s in range(n_shards):
            a, b = rows[s], rows[s + 1]
            if a < b or s == number % n_shards:
                used, text_no = np.unique(text[a:b], return_inverse=True)
                out.append((s, packed(keys[a:b]), packed(text_no), packed(sid[one][used]), members if s == number % n_shards else None))
        yield batch_of(out, KEYS)


def _look_up(table: pa.Table) -> pa.Table:
    """Of a shard: an edge from each bucket's least set to its others (kind 0), and the members carried along (kind 1)."""
    keys = np.concatenate([unpacked(x).astype(np.uint64) for x in table["keys"].to_pylist()])
    sids = np.concatenate([unpacked(s)[unpacked(t)].astype(np.uint64) for s, t in zip(table["sids"].to_pylist(), table["texts"].to_pylist(), strict=True)])
    order = np.argsort(keys, kind="stable")
    keys, sids = keys[order], sids[order]
    shared = np.zeros(len(keys), bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:].copy()
    keys, sids = keys[shared], sids[shared]
    order = np.lexsort((sids, keys))
    keys, sids = keys[order], sids[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    least = np.repeat(sids[start], np.diff(np.append(start, len(keys))))
    pairs = np.stack([least, sids], axis=1)[least != sids]
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    parts = [(np.zeros(len(pairs), np.int32), pa.array(signed(pairs[:, 0])), signed(pairs[:, 1]), np.zeros(len(pairs), np.int64))]
    for m in table["members"].to_pylist():
        if m is not None:
            ids, valid, sid, size = pickle.loads(m)
            parts.append((np.ones(len(ids), np.int32), pa.array(ids.astype(np.int64), mask=~valid), sid, size.astype(np.int64)))
    schema = schema_of(FOUND)
    return pa.concat_tables([pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(p, schema, strict=True)], schema=schema) for p in parts])


def _some_sets(bits: bytes, n_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the documents whose id is in the bit table."""
    table = np.frombuffer(bits, np.uint8)
    for batch in batches:
        slot = mix(row_ids(batch, "doc").astype(np.int64).view(np.uint64)) & np.uint64(len(table) * 8 - 1)
        hit = (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
        some = batch.filter(pa.array(hit.astype(bool)))
        for piece, buf, off in chunks(iter([some])):
            h, ptr = shingle_sets(buf, off, n_words)
            yield batch_of([(int(s), int(d), h[a:b].tobytes()) for s, d, a, b in zip(signed(set_ids(h, ptr)), row_ids(piece, "doc"), ptr[:-1], ptr[1:], strict=True)], SETS)


def links(sets: list[np.ndarray], tile: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that reach `percent`, over all pairs (of different tiles, if there are two).

    The Hamming distance of two parity sketches is at most the sets' symmetric difference; only pairs that it does not
    rule out, and that no chain of links joins yet, are compared exactly.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    bits = 1 << max(10, int(4 * size.max() - 1).bit_length())
    bits = min(bits, 1 << 16)
    sketch = np.zeros((m, bits // 64), np.uint64)
    for i, s in enumerate(sets):
        x = mix(s + MULT) & np.uint64(bits - 1)
        np.bitwise_xor.at(sketch[i], (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    label = np.arange(m)
    two = tile.min() != tile.max()
    forest = []
    for i in range(m - 1):
        later = np.arange(i + 1, m)
        later = later[label[later] != label[i]]
        if two:
            later = later[tile[later] != tile[i]]
        a, b = np.minimum(size[i], size[later]), np.maximum(size[i], size[later])
        later = later[100 * a >= percent * b]
        if not len(later):
            continue
        apart = np.concatenate([np.bitwise_count(sketch[p] ^ sketch[i]).sum(axis=1, dtype=np.int64) for p in np.array_split(later, 1 + len(later) * bits // (1 << 26))])
        for j in later[apart * (100 + percent) <= (100 - percent) * (size[i] + size[later])].tolist():
            if label[j] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (size[i] + size[j] - common):
                forest.append((i, j))
                label[label == label[j]] = label[i]
    return forest


SIGNED = "shard int, keys binary, texts binary, sids binary, sizes binary, sketches binary"
PIECE = 1 << 20  #: shingles that are signed at once
SHARD_BYTES = 64 << 20  #: of the keys of a band's sets, ten bytes a shingle, in one shard


def widths(size: np.ndarray) -> np.ndarray:
    """Words of 64 bits of a set's own sketch: a power of two with a bit for each shingle, 1024 words at most."""
    return 1 << np.ceil(np.log2(np.clip(size, 64, 1 << 16) / 64)).astype(np.int64)


def sketches(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The parity sketches of sets, end to end, each of its own width."""
    n = np.diff(ptr)
    words = widths(n)
    flat = np.zeros(words.sum(), np.uint64)
    x = mix(h + MULT) & np.repeat(words * 64 - 1, n).astype(np.uint64)
    np.bitwise_xor.at(flat, np.repeat(np.cumsum(words) - words, n) + (x >> np.uint64(6)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return flat


def _sign_sets(parts: list[int], percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each piece of sets and shard: the block keys that fall there, and size and sketch of the sets that use them.

    A band's keys have `parts` shards of their own, so a sketch goes to those of the set's few bands only.
    """
    bands, first = Bands(percent), np.concatenate([[0], np.cumsum(parts)])
    for batch in batches:
        sids = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        bodies = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
        ends = np.cumsum([len(x) for x in bodies])
        lo = 0
        while lo < len(bodies):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PIECE, "right")))
            h, size = np.concatenate(bodies[lo:hi]), np.array([len(x) for x in bodies[lo:hi]], np.int64)
            ptr = np.concatenate([[0], np.cumsum(size)])
            keys, text, band = banded_keys(h, ptr, bands)
            shard = first[band] + ((keys >> np.uint64(32)) * np.array(parts, np.uint64)[band] >> np.uint64(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keys, text = keys[order], text[order]
            rows = np.searchsorted(shard[order], np.arange(first[-1] + 1))
            flat, words, out = sketches(h, ptr), widths(size), []
            start = np.cumsum(words) - words
            for s in range(first[-1]):
                if rows[s] < rows[s + 1]:
                    used, text_no = np.unique(text[rows[s] : rows[s + 1]], return_inverse=True)
                    at = np.repeat(start[used] - (np.cumsum(words[used]) - words[used]), words[used]) + np.arange(words[used].sum())
                    out.append((s, packed(keys[rows[s] : rows[s + 1]]), packed(text_no), packed(sids[lo:hi][used]), packed(size[used]), flat[at].tobytes()))
            yield batch_of(out, SIGNED)
            lo = hi


class Sketched:
    """Sets by number, each with its size and sketch, and the groups that pairs not ruled out have made so far."""

    def __init__(self, size: np.ndarray, flat: np.ndarray, start: np.ndarray, percent: int):
        self.size, self.flat, self.start, self.percent = size, flat, start, percent
        self.words = widths(size)
        self.label = np.arange(len(size))

    def folded(self, i: np.ndarray, w: int) -> np.ndarray:
        """Sketches in w words, no more than their own: the words that fall together are added."""
        out, own = np.empty((len(i), w), np.uint64), self.words[i]
        for k in np.unique(own):
            at = np.flatnonzero(own == k)
            out[at] = np.bitwise_xor.reduce(self.flat[self.start[i[at]][:, None] + np.arange(k)].reshape(len(at), k // w, w), axis=1)
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs neither sizes nor sketches rule out."""
        sa, sb = self.size[a], self.size[b]
        found = 100 * np.minimum(sa, sb) >= self.percent * np.maximum(sa, sb)
        left = np.flatnonzero(found)
        width = np.minimum(self.words[a[left]], self.words[b[left]])
        for w in np.unique(width).tolist():
            of = left[width == w]
            for own in np.array_split(of, 1 + len(of) * w // (1 << 20)):
                apart = np.bitwise_count(self.folded(a[own], w) ^ self.folded(b[own], w)).sum(axis=1, dtype=np.int64)
                found[own] = apart * (100 + self.percent) <= (100 - self.percent) * (sa[own] + sb[own])
        return found

    def roots(self, i: np.ndarray) -> np.ndarray:
        at = self.label[i]
        while len(at) and (at != self.label[at]).any():
            at = self.label[at]
        return at

    def flatten(self) -> None:
        while (self.label != self.label[self.label]).any():
            self.label = self.label[self.label]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return
            np.minimum.at(self.label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            self.flatten()

    def buckets(self, sets: np.ndarray, start: np.ndarray, few: int = 16) -> None:
        """Joins all near pairs of each bucket; sets: members, bucket by bucket, from `start` (with the end)."""
        first = np.repeat(sets[start[:-1]], np.diff(start))
        pairs = np.unique(np.stack([first, sets], axis=1)[first != sets], axis=0)
        pairs = pairs[self.near(pairs[:, 0], pairs[:, 1])]
        self.join(pairs[:, 0], pairs[:, 1])
        label, n = self.label[sets], np.diff(start)
        left = np.flatnonzero((n > 2) & (np.minimum.reduceat(label, start[:-1]) != np.maximum.reduceat(label, start[:-1])))
        if not len(left):
            return
        same = np.bitwise_xor.reduceat(mix((sets + 1).astype(np.uint64) * MULT), start[:-1])
        left = left[np.unique(same[left], return_index=True)[1]]  # many buckets have the same members
        for k in range(3, few + 1):
            own = left[n[left] == k]
            i, j = np.triu_indices(k, 1)
            for part in np.array_split(own, 1 + len(own) * len(i) // (1 << 20)):
                at = start[part][:, None]
                pairs = np.stack([sets[at + i].ravel(), sets[at + j].ravel()], axis=1)
                pairs = pairs[self.label[pairs[:, 0]] != self.label[pairs[:, 1]]]
                pairs = np.unique(pairs, axis=0)
                pairs = pairs[self.near(pairs[:, 0], pairs[:, 1])]
                self.join(pairs[:, 0], pairs[:, 1])
        for number, b in enumerate(left[n[left] > few].tolist()):
            self.large(sets[start[b] : start[b + 1]])
            if number % 64 == 63:
                self.flatten()
        self.flatten()

    def large(self, sets: np.ndarray) -> None:
        """All near pairs of one bucket, set by set, without those that are of one group already."""
        sets = sets[np.argsort(self.size[sets], kind="stable")]
        label = self.roots(sets)
        high = np.searchsorted(self.size[sets], self.size[sets] * 100 // self.percent, "right")
        for i in range(len(sets) - 1):
            later = np.arange(i + 1, high[i])
            later = later[label[later] != label[i]]
            if len(later):
                hit = np.unique(label[later[self.near(np.full(len(later), sets[i]), sets[later])]])
                if len(hit):
                    both = np.append(hit, label[i])
                    self.label[both] = both.min()
                    label[np.isin(label, both)] = both.min()


def _near_sets(percent: int, table: pa.Table) -> pa.Table:
    """Of a shard: an edge from each set to the least of its group, of pairs in a bucket that no sketch rules out."""
    sids = [unpacked(x).astype(np.uint64) for x in table["sids"].to_pylist()]
    size = np.concatenate([unpacked(x).astype(np.int64) for x in table["sizes"].to_pylist()])
    flat = np.concatenate([np.frombuffer(x, np.uint64) for x in table["sketches"].to_pylist()])
    before = np.cumsum([0, *map(len, sids)])[:-1]
    keys = np.concatenate([unpacked(x).astype(np.uint64) for x in table["keys"].to_pylist()])
    texts = np.concatenate([unpacked(x).astype(np.int64) + k for x, k in zip(table["texts"].to_pylist(), before, strict=True)])
    ids, one, number = np.unique(np.concatenate(sids), return_index=True, return_inverse=True)
    words = widths(size)
    known = Sketched(size[one], flat, (np.cumsum(words) - words)[one], percent)
    sets = number[texts]
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (sets[1:] == sets[:-1])
    keys, sets = keys[~again], sets[~again]
    shared = np.zeros(len(keys), bool)
    shared[1:] = keys[1:] == keys[:-1]
    shared[:-1] |= shared[1:].copy()
    keys, sets = keys[shared], sets[shared]
    if len(keys):
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        known.buckets(sets, start)
    other = np.flatnonzero(known.label != np.arange(len(ids)))
    return pa.table([pa.array(signed(ids[known.label[other]])), pa.array(signed(ids[other]))], schema=schema_of("a long, b long"))


def _verify(percent: int, table: pa.Table) -> pa.Table:
    ids = table["sid"].to_numpy()
    one = np.unique(ids, return_index=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].take(one).to_pylist()]
    found = links(sets, table["tile"].to_numpy()[one], percent)
    return table_of([(int(ids[one[i]]), int(ids[one[j]])) for i, j in found], "a long, b long")


def bodies_of(wanted: DataFrame, keyed: DataFrame, n_words: int, filter_bits: int) -> DataFrame:
    """sid, doc, hashes of the documents in `wanted`, and of some others; keyed: doc, text of all."""
    # a bit table of the documents whose sets are needed: its size is fixed, and a false hit only costs time
    bits = np.zeros(filter_bits // 8, np.uint8)

    @F.pandas_udf("long")
    def slots(x: pd.Series) -> pd.Series:
        return pd.Series((mix(x.to_numpy(np.int64).view(np.uint64)) & np.uint64(filter_bits - 1)).astype(np.int64))

    marks = wanted.select(slots("doc").alias("s")).groupBy((F.col("s") / 32).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 32 as int))")).alias("m"))
    for w, m in marks.toLocalIterator():
        bits[w * 4 : w * 4 + 4] = np.frombuffer(int(m).to_bytes(4, "little"), np.uint8)
    shared = keyed.sparkSession.sparkContext.broadcast(bits.tobytes())
    return keyed.mapInArrow(lambda it: _some_sets(shared.value, n_words, it), SETS)


def tiles_of(wanted: DataFrame, tile_sets: int, tile_shingles: int) -> DataFrame:
    return wanted.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / tile_sets), F.ceil(F.sum("n_shingles") / tile_shingles)).cast("int").alias("tiles"))


def narrowed(wanted: DataFrame, tiles: DataFrame, keyed: DataFrame, percent: int, n_words: int, filter_bits: int) -> DataFrame:
    """`wanted` with clusters of several tiles cut down to what sketches do not rule out in some bucket; no link is lost."""
    wide = tiles.where("tiles > 1").select("label")
    some = cut(wanted.join(wide, "label", "left_semi"))
    most = some.agg(F.max("n_shingles")).first()[0]
    if not most:
        return wanted
    bands = Bands(percent)
    of = [F.sum(F.when(F.col("n_shingles").between(low, high), F.col("n_shingles"))) for low, high in zip(bands.low[:-1].tolist(), bands.high.tolist(), strict=True) if low <= most]
    parts = [1 + (x or 0) * 10 // SHARD_BYTES for x in some.agg(*of).first()]
    bodies = bodies_of(some, keyed, n_words, filter_bits).join(some.select("sid", "doc"), ["sid", "doc"]).select("sid", "hashes")
    signs = bodies.mapInArrow(partial(_sign_sets, parts, percent), SIGNED)
    edges = signs.groupBy("shard").applyInArrow(lambda t: _near_sets(percent, t), "a long, b long")
    closer = components(edges).withColumnRenamed("node", "sid")
    return cut(wanted.join(wide, "label", "left_anti").unionByName(some.drop("label").join(closer, "sid")))


def jaccard_components(docs: DataFrame, percent: int = 85, n_words: int = 4, doc_id: str = "doc_id", text: str = "text", tile_sets: int = 2048, tile_shingles: int = 4 << 20, filter_bits: int = 1 << 24) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = shards_for(docs, text, 256 << 20)
    signs = rows.mapInArrow(partial(_sign, n, percent, n_words), KEYS)
    found = cut(signs.groupBy("shard").applyInArrow(lambda t: _look_up(t), FOUND))
    members = found.where("kind = 1").select(F.col("x").alias("doc_id"), F.col("y").alias("sid"), F.col("n").alias("n_shingles"))
    sets = members.where("n_shingles > 0").groupBy("sid").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("doc"), F.first("n_shingles").alias("n_shingles"))

    clusters = components(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("node", "sid")
    wanted = cut(clusters.join(sets, "sid"))
    keyed = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    wanted = narrowed(wanted, tiles_of(wanted, tile_sets, tile_shingles), keyed, percent, n_words, filter_bits)
    large = tiles_of(wanted, tile_sets, tile_shingles)
    tiled = wanted.join(large, "label").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    groups = bodies_of(wanted, keyed, n_words, filter_bits).join(tiled.select("sid", "doc", "label", "tile", "other"), ["sid", "doc"]).select("label", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "sid", "tile", "hashes")
    linked = groups.groupBy("label", "t1", "t2").applyInArrow(lambda t: _verify(percent, t), "a long, b long")
    joined = components(linked).withColumnRenamed("node", "sid")

    named = sets.join(joined, "sid", "left").select("sid", "doc", F.coalesce("label", "sid").alias("label"))
    least = named.groupBy("label").agg(F.min(F.when(F.col("doc") != NO_ID, F.col("doc"))).alias("component_id"))
    names = cut(named.join(least, "label").select("sid", "component_id"))
    full = members.where("n_shingles > 0").join(names, "sid").select("doc_id", "n_shingles", "component_id")
    return full.unionAll(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, percent: int, n_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of texts, the one with the least doc_id (null comes last), then the least hash of id and text.

    Rows are told apart by id and text, so different texts under one id, or none, are judged each by its own links.
    Of rows that are equal in both, one stays. Rows without text or words have no links and all stay.
    """
    row = F.xxhash64(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("~")), F.col(f"`{text}`"))
    rows = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    names = cut(jaccard_components(rows, percent, n_words, doc_id="row").where("n_shingles > 0").select(F.col("doc_id").alias("row"), F.col("component_id").alias("label")))
    several = names.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
    near = names.join(several, "label").groupBy("row", "label").agg(F.count("*").alias("n")).join(rows.select("row", "id").distinct(), "row")
    near = cut(near)
    first = near.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("f")).select("label", F.col("f.row").alias("first"))
    # a hash that two rows of different components share is no ground to drop either
    judged = near.join(first, "label").groupBy("row").agg(F.bool_and(F.col("row") != F.col("first")).alias("other"), F.max("n").alias("n"))
    judged = cut(judged.where("other or n > 1"))
    marked = docs.withColumn("_row", row)
    kept = marked.join(judged.select(F.col("row").alias("_row")), "_row", "left_anti")
    if judged.where("not other").limit(1).count():
        again = marked.join(judged.where("not other").select(F.col("row").alias("_row")), "_row", "left_semi")
        kept = kept.unionByName(again.dropDuplicates([doc_id, text]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


#: stands for a null doc_id while sets are looked up; larger than any id, so that it never names a component
NO_ID = (1 << 63) - 1
