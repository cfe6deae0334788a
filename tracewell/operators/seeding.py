"""Recursive seeds of two tiles of sequences, on arrays; nothing here knows Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MATCHES, PLACES = 1 << 19, 1 << 22  #: seeds, and places in gaps, that are held at once, unless one sequence has more


class Tile:
    """Sequences end to end: `letters`, the offsets `at` of each and one more, and their ids."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        self.ids = ids
        self.letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def words(letters: np.ndarray, k: int) -> np.ndarray:
    """A number for the k letters from each place from which k follow, the same for the same letters."""
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    _, one = np.unique(letters, return_inverse=True)
    base, code, top = int(one.max()) + 1, one[:n].astype(np.int64), int(one.max()) + 1
    for i in range(1, k):
        if top * base >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            top = int(code.max()) + 1
        code, top = code * base + one[i : i + n], top * base
    return np.unique(code, return_inverse=True)[1]


def codes(a: Tile, b: Tile, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of both tiles at each place; those that go beyond a sequence's end are not meant."""
    both = words(np.concatenate([a.letters, b.letters, np.zeros(k - 1, np.uint32)]), k)
    return both[: len(a.letters)], both[len(a.letters) : len(a.letters) + len(b.letters)]


def once(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Indices of what its owner has once, in order of owner and code."""
    order = np.lexsort((code, owner))
    o, c = owner[order], code[order]
    new = np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1]), True]
    return order[new[:-1] & new[1:]]


def ordered(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices, by group and x, of pairs that are in one strict order with all other distinct pairs of their group."""
    order = np.lexsort((y, x, group))
    g, x, y = group[order], x[order], y[order]
    if not len(g):
        return order
    first, last = np.r_[True, g[1:] != g[:-1]], np.r_[g[1:] != g[:-1], True]
    number, big = np.cumsum(first) - 1, int(y.max()) + 2
    low = np.maximum.accumulate(y + number * big) - number * big
    high = np.minimum.accumulate((y + number * big)[::-1])[::-1] - number * big
    keep = np.ones(len(g), bool)
    keep[1:] &= first[1:] | ((y[1:] > low[:-1]) & (x[1:] > x[:-1]))
    keep[:-1] &= last[:-1] | ((y[:-1] < high[1:]) & (x[:-1] < x[1:]))
    return order[keep]


def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... n times for each, and whose they are."""
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + start[own], own


def anchored(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, coded: dict, ks: list[int], limit: int) -> tuple[np.ndarray, ...]:
    """i, j, x, y of all anchors of the pairs (i, j) whose first seeds are at (x, y)."""
    pair = i * len(b.ids) + j
    keep = ordered(pair, x, y)
    pair, x, y = pair[keep], x[keep], y[keep]
    open_ = np.unique(pair)
    for k in ks[1:]:
        i, j = open_ // len(b.ids), open_ % len(b.ids)
        own = np.flatnonzero(np.isin(pair, open_))
        p, gx, gy = np.append(pair[own], open_), np.append(x[own], np.diff(a.at)[i]), np.append(y[own], np.diff(b.at)[j])
        order = np.lexsort((gx, p))  # an end is beyond every place
        p, x1, y1 = p[order], gx[order], gy[order]
        new = np.r_[True, p[1:] != p[:-1]]
        x0, y0 = (np.where(new, 0, np.r_[0, z[:-1]] + 1) for z in (x1, y1))
        wide = (x1 - x0) * (y1 - y0) > limit
        open_ = np.unique(p[wide])
        gap = np.flatnonzero(wide & (x1 - x0 >= k) & (y1 - y0 >= k))
        if not len(open_):
            break
        if not len(gap):
            continue
        (ca, cb), i, j = coded[k], p[gap] // len(b.ids), p[gap] % len(b.ids)
        found = []
        for code, start, n in ((ca, a.at[i] + x0[gap], x1[gap] - x0[gap] - k + 1), (cb, b.at[j] + y0[gap], y1[gap] - y0[gap] - k + 1)):
            place, of = spread(start, n)
            one = once(of, code[place])
            found.append((of[one], code[place[one]], place[one]))
        top = int(max(ca.max(), cb.max())) + 1
        _, at_a, at_b = np.intersect1d(found[0][0] * top + found[0][1], found[1][0] * top + found[1][1], assume_unique=True, return_indices=True)
        of = found[0][0][at_a]
        nx, ny = found[0][2][at_a] - a.at[i[of]], found[1][2][at_b] - b.at[j[of]]
        keep = ordered(of, nx, ny)
        pair, x, y = np.append(pair, p[gap][of[keep]]), np.append(x, nx[keep]), np.append(y, ny[keep])
    return pair // len(b.ids), pair % len(b.ids), x, y


def tile_pairs(a: Tile, b: Tile, ks: list[int], limit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """i, j, x, y of the anchors of two tiles, some sequences of `a` at a time."""
    coded, singles = {k: codes(a, b, k) for k in ks}, []
    for t, code in zip((a, b), coded[ks[0]], strict=True):
        place, of = spread(t.at[:-1], np.maximum(np.diff(t.at) - ks[0] + 1, 0))
        one = once(of, code[place])
        singles.append((of[one], code[place[one]], place[one] - t.at[of[one]]))
    (ia, wa, xa), (jb, wb, yb) = singles
    order = np.argsort(wb, kind="stable")
    jb, wb, yb = jb[order], wb[order], yb[order]
    lo = np.searchsorted(wb, wa)
    n = np.searchsorted(wb, wa, "right") - lo
    matches = np.bincount(ia, n, minlength=len(a.ids)).astype(np.int64)  # of each sequence
    places = np.minimum(matches, len(b.ids)) * (np.diff(a.at) + -(-len(b.letters) // max(1, len(b.ids))))
    cost = np.cumsum(np.maximum(matches / MATCHES, places / PLACES))
    first = 0
    while first < len(a.ids):
        last = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + 1, "right")))
        own = slice(*np.searchsorted(ia, [first, last]))
        at, of = spread(lo[own], n[own])
        if len(at):
            yield anchored(a, b, ia[own][of], jb[at], xa[own][of], yb[at], coded, ks, limit)
        first = last


def seeded(batches: Iterator[pa.RecordBatch], ks: list[int], limit: int) -> Iterator[pa.RecordBatch]:
    """id_a, id_b, x, y of the anchors of each row's tiles; a, b: arrays of id and sequence."""
    for batch in batches:
        for row in range(batch.num_rows):
            a, b = (Tile(s.field("id").to_numpy(zero_copy_only=False).astype(np.int64), s.field("sequence").to_pylist()) for s in (batch.column(c)[row].values for c in (0, 1)))
            for i, j, x, y in tile_pairs(a, b, ks, limit):
                yield pa.RecordBatch.from_arrays([pa.array(z.astype(np.int64)) for z in (a.ids[i], b.ids[j], x, y)], names=["id_a", "id_b", "x", "y"])
