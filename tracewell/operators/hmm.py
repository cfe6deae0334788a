"""Posterior alignment of event series to k-mer sequences by a banded three-state pair HMM, and its training.

States: match (k-mer and event), skip (a k-mer without event), extra (a further event of the same k-mer). Extra cannot
follow skip. A place may stand for several concrete k-mers, its paths; a path goes on only to k-mers that overlap. A
k-mer without a level keeps its place, and only a skip can pass it.

One row of the input is one block of a read (see `blocks`), so Spark spreads the blocks and nothing is shuffled here. A
task takes blocks of like length together, as one array per anti-diagonal, straight from Arrow's arrays. Blocks of up to
MARK_EVERY diagonals go through `Scaled`, on probabilities with a factor for each diagonal; those whose lost mass cannot
be bounded below LOSS, and longer ones, go through `Batch`, on logs. Of a long block that holds a window of diagonals and
two at the start of each window before, from which the walk back makes the rest again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.splines import cubic

MATCH, SKIP, EXTRA = 0, 1, 2
SKIP_EMISSION = math.log(0.1)
EXTRA_WIDTH = 1.75  #: of the level's standard deviation for extra events
# Default probabilities from state (row) to state (column); an extra event after a skip, or a skip after an extra, is ruled out.
TRANSITIONS = np.array([
    [0.79015888282447311, 0.19652425498269727, 0.013316862192829682],
    [0.80347574501730273, 0.19652425498269727, 0.0],
    [0.98668313780708949, 0.0, 0.013316862192910478],
])
MAX_KMERS = 46_656  #: of the largest model, which bounds what is broadcast
MAX_KNOTS = 1 << 24  #: values of all k-mers' tabulated densities together, for the same reason
MARK_EVERY = 1000  #: diagonals whose forward values are held together
HELD = 4 << 20  #: cells of a window that a batch of blocks holds at once, or one block's window
TINY, LOSS = -300 * math.log(10), -12 * math.log(10)  #: logs of what a product can lose unseen, and of the share of a block's mass that may be lost
BLOCK = "read_id long, block long, x0 long, y0 long, kmers array<array<string>>, events array<double>, anchors array<struct<x:int,y:int>>, ragged_left boolean, ragged_right boolean"


def gaussian(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = (x - mu) / sd
    return -0.9189385332046727 - np.log(sd) - 0.5 * z * z


@dataclass
class Gaussian:
    """Emissions by a level and its standard deviation for each k-mer. kmers: k-mer -> row of the arrays."""

    kmers: dict[str, int]
    level: np.ndarray
    sd: np.ndarray

    def match(self, kmer: np.ndarray, event: np.ndarray) -> np.ndarray:
        return gaussian(event, self.level[kmer], self.sd[kmer])

    def extra(self, kmer: np.ndarray, event: np.ndarray) -> np.ndarray:
        return gaussian(event, self.level[kmer], self.sd[kmer] * EXTRA_WIDTH)

    def densities(self, kmer: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a match and of an extra event, not as logs."""
        narrow = (1 / self.sd)[kmer]
        q = (event - self.level[kmer]) * narrow
        q *= q
        top = narrow * 0.3989422804014327
        return np.exp(-0.5 * q) * top, np.exp((-0.5 / EXTRA_WIDTH**2) * q) * (top / EXTRA_WIDTH)


@dataclass
class Tabulated:
    """Emissions by densities on an evenly spaced grid, as cubic splines; a match and an extra event have the same.

    scale and shift undo the calibration of events, and a density of 0 counts as the least positive number.
    """

    kmers: dict[str, int]
    low: float
    step: float
    pdf: np.ndarray  # [k-mer, knot]
    slope: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def match(self, kmer: np.ndarray, event: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(cubic((event - self.shift) / self.scale, self.low, self.step, self.pdf, self.slope, kmer) / self.scale, 5e-324))

    extra = match

    def densities(self, kmer: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one = np.exp(self.match(kmer, event))
        return one, one


def band(nx: int, ny: int, anchors: list[tuple[int, int]], width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each anti-diagonal x + y the least and greatest x: cells up to width / 2 from the line through the anchors, in integers."""
    d = np.arange(nx + ny + 1)
    low, high = np.maximum(0, d - ny), np.minimum(nx, d)
    if width is not None:
        px, py = np.array([(0, 0), *sorted(anchors), (nx, ny)], np.int64).T
        at = px + py
        k = np.clip(np.searchsorted(at, d, "right") - 1, 0, max(len(at) - 2, 0))
        den = np.maximum(at[k + 1] - at[k], 1)
        centre = 2 * (px[k] * den + (d - at[k]) * (px[k + 1] - px[k]))  # twice the line's x, times den
        low, high = np.maximum(low, -((width * den - centre) // (2 * den))), np.minimum(high, (centre + width * den) // (2 * den))
    return low, np.maximum(high, low)


def lse(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp(x) along an axis; minus infinity where all are."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Batch:
    """Blocks of like length, held as arrays [block, ...]; cells of a diagonal are [block, x - least x, state, path]."""

    def __init__(self, rows: list, emission, transitions: np.ndarray, width: int | None, every: int = MARK_EVERY):
        self.emission, self.every = emission, every
        with np.errstate(divide="ignore"):
            self.t = np.log(transitions)
        self.nx, self.ny = np.array([len(r.kmers) for r in rows]), np.array([len(r.events) for r in rows])
        self.last = self.nx + self.ny
        n, top = len(rows), int(self.last.max())
        self.paths = max((len(o) for r in rows for o in r.kmers), default=1)
        self.kmer = np.full((n, self.nx.max() + 1, self.paths), -2)  # -1: no level, -2: no such path
        self.event = np.zeros((n, self.ny.max() + 1))
        self.low, self.high = np.zeros((n, top + 1), np.int64), np.full((n, top + 1), -1)
        for i, r in enumerate(rows):
            for p in range(self.paths):
                own = [emission.kmers.get(o[p], -1) if p < len(o) else -2 for o in r.kmers]
                self.kmer[i, 1 : len(own) + 1, p] = own
            self.event[i, 1 : len(r.events) + 1] = r.events
            anchors = [(int(a["x"]) + 1, int(a["y"]) + 1) for a in r.anchors] if r.anchors is not None else []
            self.low[i, : self.last[i] + 1], self.high[i, : self.last[i] + 1] = band(int(self.nx[i]), int(self.ny[i]), anchors, width)
        self.kmer[:, 0] = self.kmer[:, 1]  # events before the first k-mer are extra events of it, on each of its paths
        self.width = int((self.high - self.low).max()) + 1
        self.gate = self._gates(rows) if self.paths > 1 else None
        self.left, self.right = (np.array([bool(getattr(r, c)) for r in rows]) for c in ("ragged_left", "ragged_right"))
        self.block = np.arange(n)
        self.total, self.expected = np.full(n, -np.inf), np.zeros((n, 3, 3))
        self.most_held = 0  # diagonals

    def _gates(self, rows: list) -> np.ndarray:
        """[block, x, from, to]: 0 where the path at x - 1 may go on to that at x; the first k-mer's begin before it."""
        gate = np.full((len(rows), self.kmer.shape[1] + 1, self.paths, self.paths), -np.inf)
        for i, r in enumerate(rows):
            gate[i, 1][np.diag_indices(len(r.kmers[0]))] = 0.0
            for x in range(1, len(r.kmers)):
                for p, a in enumerate(r.kmers[x - 1]):
                    for q, b in enumerate(r.kmers[x]):
                        if a is None or b is None or a[1:] == b[:-1]:
                            gate[i, x + 1, p, q] = 0.0
        return gate

    def _places(self, d: int) -> np.ndarray:
        return self.low[:, d, None] + np.arange(self.width)

    def _at(self, cells: np.ndarray | None, d: int, x: np.ndarray) -> np.ndarray:
        """Cells of diagonal d at the places x; minus infinity outside the band."""
        if cells is None or not 0 <= d < self.low.shape[1]:
            return np.full((*x.shape, 3, self.paths), -np.inf)
        i = x - self.low[:, d, None]
        out = cells[self.block[:, None], np.clip(i, 0, self.width - 1)]
        out[(i < 0) | (x > self.high[:, d, None])] = -np.inf
        return out

    def _emissions(self, d: int, x: np.ndarray) -> np.ndarray:
        """Of the three states at the places x of diagonal d; minus infinity outside the band."""
        y = d - x
        inside = (x <= self.high[:, d, None]) & (y >= 0)
        kmer = self.kmer[self.block[:, None], np.clip(x, 0, self.kmer.shape[1] - 1)]
        event = self.event[self.block[:, None], np.clip(y, 0, self.event.shape[1] - 1)][:, :, None]
        known, some = np.maximum(kmer, 0), inside[:, :, None] & (kmer > -2)
        seen = some & (kmer >= 0) & (y > 0)[:, :, None]
        blank = np.isnan(event)  # an event without level says nothing about its k-mer
        out = np.full((*x.shape, 3, self.paths), -np.inf)
        out[:, :, SKIP] = np.where(some & (x > 0)[:, :, None], SKIP_EMISSION, -np.inf)
        if len(self.emission.kmers):
            level = np.where(blank, 0.0, event)
            out[:, :, MATCH] = np.where(seen & (x > 0)[:, :, None], np.where(blank, 0.0, self.emission.match(known, level)), -np.inf)
            out[:, :, EXTRA] = np.where(seen, np.where(blank, 0.0, self.emission.extra(known, level)), -np.inf)
        return out

    def _forward(self, d: int, before: np.ndarray, two_before: np.ndarray | None) -> np.ndarray:
        x = self._places(d)
        across, along = self._at(two_before, d - 2, x - 1), self._at(before, d - 1, x - 1)
        if self.gate is not None:
            gate = self.gate[self.block[:, None], np.clip(x, 0, self.gate.shape[1] - 1)][:, :, None]
            across, along = (lse(c[..., None] + gate, 3) for c in (across, along))
        stay = self._at(before, d - 1, x)
        cell = np.stack([lse(source + self.t[:, state][:, None], 2) for state, source in ((MATCH, across), (SKIP, along), (EXTRA, stay))], axis=2)
        return cell + self._emissions(d, x)

    def _start(self) -> np.ndarray:
        """A plain start is like a match; a ragged one like a gap."""
        cell = np.full((len(self.block), self.width, 3, self.paths), -np.inf)
        plain, ragged = [0.0, -np.inf, -np.inf], [-np.inf, 0.0, 0.0]
        cell[:, 0] = np.where(self.left[:, None], ragged, plain)[:, :, None] + np.where(self.kmer[:, :1] > -2, 0.0, -np.inf)
        return cell

    def _end(self, ragged: np.ndarray) -> np.ndarray:
        """[block, state]: a plain end is like a step to a match; a ragged one like one to a gap."""
        gap = [(self.t[MATCH, SKIP] + self.t[MATCH, EXTRA]) / 2, self.t[SKIP, SKIP], self.t[EXTRA, EXTRA]]
        return np.where(ragged[:, None], gap, self.t[:, MATCH])

    def _open(self, way: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Values of the paths at x + 1 as sums over those that each path at x may go on to."""
        if self.gate is None:
            return way
        return lse(self.gate[self.block[:, None], np.clip(x + 1, 0, self.gate.shape[1] - 1)] + way[:, :, None], 3)

    def _sweep(self, rows: dict[int, np.ndarray], low: int, high: int) -> None:
        """Adds the forward values of diagonals low + 1 to high, from those of low and low - 1."""
        for d in range(low + 1, high + 1):
            rows[d] = self._forward(d, rows[d - 1], rows.get(d - 2))
            own = np.flatnonzero(self.last == d)
            if len(own):
                ended = rows[d][own] + self._end(self.right[own])[:, None, :, None]
                self.total[own] = lse(ended.reshape(len(own), -1), 1)

    def matches(self, threshold: float, expectations: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Arrays (block, x, y, path, p) of the pairs whose posterior reaches the threshold; p is clamped to 1 and cut to 1e-7.

        From the start `total` has each block's log-likelihood; at the end `expected` has its expected transitions, if
        they are asked for. Forward values are kept at the marks and between the last two only, and the walk back makes
        those before a mark again: all values are exact, whatever the window.
        """
        end, rows, marks, low = int(self.last.max()), {0: self._start()}, {}, 0
        while low + self.every < end:
            self._sweep(rows, low, low + self.every)
            self.most_held = max(self.most_held, len(rows) + 2 * len(marks))
            marks[low] = {d: rows[d] for d in (low - 1, low) if d in rows}
            low += self.every
            rows = {d: rows[d] for d in (low - 1, low)}
        self._sweep(rows, low, end)
        self.most_held = max(self.most_held, len(rows) + 2 * len(marks))
        last = self._end(self.right)[:, None, :, None]
        total = np.where(np.isfinite(self.total), self.total, np.inf)[:, None, None]
        ahead: dict[int, np.ndarray] = {}  # backward values with their cells' emissions, of the two diagonals after d
        for d in range(end, -1, -1):
            if d not in rows:
                low -= self.every
                rows = marks.pop(low)
                self._sweep(rows, low, d)
            x = self._places(d)
            inside = (x <= self.high[:, d, None])[:, :, None, None]
            moves = []
            for state, step, dx in ((MATCH, 2, 1), (SKIP, 1, 1), (EXTRA, 1, 0)):
                way = self._at(ahead.get(d + step), d + step, x + dx)[:, :, state]
                moves.append((self._open(way, x) if dx else way)[:, :, None] + self.t[:, state][:, None])
                if expectations:
                    self.expected[:, :, state] += np.exp(rows[d] + moves[-1] - total[..., None]).sum(axis=(1, 3))
            back = np.where((self.last == d)[:, None, None, None], last, lse(np.stack(moves), 0))
            back = np.where(inside, back, -np.inf)
            p = np.exp(rows[d][:, :, MATCH] + back[:, :, MATCH] - total)
            i, j, path = np.nonzero(p >= threshold)
            some = (x[i, j] > 0) & (d - x[i, j] > 0)
            i, j, path = i[some], j[some], path[some]
            yield i, x[i, j] - 1, d - x[i, j] - 1, path, np.floor(np.minimum(p[i, j, path], 1.0) * 1e7) / 1e7
            ahead[d] = back + self._emissions(d, x)
            ahead.pop(d + 2, None)


class Blocks:
    """An Arrow batch of rows of schema BLOCK as flat arrays, its k-mers as numbers in `names`."""

    def __init__(self, batch: pa.RecordBatch, emission):
        column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
        whole = lambda c: column[c].to_numpy(zero_copy_only=False)
        self.ids, self.number, self.x0, self.y0 = (whole(c).astype(np.int64) for c in ("read_id", "block", "x0", "y0"))
        self.left, self.right = (column[c].fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for c in ("ragged_left", "ragged_right"))
        places, events, anchors = column["kmers"], column["events"], column["anchors"]
        self.place, self.event, self.anchor = (np.asarray(c.offsets).astype(np.int64) for c in (places, events, anchors))
        self.path = np.asarray(places.values.offsets).astype(np.int64)
        coded = places.values.values.dictionary_encode()
        self.names = [*coded.dictionary.to_pylist(), None]
        self.code = coded.indices.fill_null(len(self.names) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = np.array([emission.kmers.get(k, -1) if k is not None else -1 for k in self.names])
        ends: dict[str, int] = {}
        end = lambda k: ends.setdefault(k, len(ends))
        self.tail, self.head = (np.array([-1 if k is None else end(f(k)) for k in self.names]) for f in (lambda k: k[1:], lambda k: k[:-1]))
        self.level = events.values.to_numpy(zero_copy_only=False).astype(float)
        self.ax, self.ay = (anchors.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        self.nx, self.ny = (np.where(np.asarray(c.is_valid()), np.diff(o), 0) for c, o in ((places, self.place), (events, self.event)))
        self.na = np.where(np.asarray(anchors.is_valid()), np.diff(self.anchor), 0)
        most = np.zeros(len(self.ids), np.int64)
        some = np.flatnonzero(self.nx)
        if len(some):
            width = np.diff(self.path)
            most[some] = np.maximum.reduceat(np.append(width, 0), np.stack([self.place[some], self.place[some] + self.nx[some]], 1).ravel())[::2]
        self.paths = most
        self.bands: dict = {}

    def marks(self, i: int) -> list[tuple[int, int]]:
        at = slice(self.anchor[i], self.anchor[i] + self.na[i])
        return list(zip(self.ax[at].tolist(), self.ay[at].tolist(), strict=True))

    def band(self, i: int, width: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of like lengths and anchors share one."""
        marks = [] if width is None else self.marks(i)
        key = (int(self.nx[i]), int(self.ny[i]), tuple(marks))
        if key not in self.bands:
            self.bands[key] = band(key[0], key[1], [(x + 1, y + 1) for x, y in marks], width)
        return self.bands[key]

    def row(self, i: int) -> SimpleNamespace:
        """One block as `Batch` takes it."""
        at = range(self.place[i], self.place[i] + self.nx[i])
        kmers = [[self.names[c] for c in self.code[self.path[p] : self.path[p + 1]]] for p in at]
        return SimpleNamespace(kmers=kmers, events=self.level[self.event[i] : self.event[i] + self.ny[i]], anchors=[{"x": x, "y": y} for x, y in self.marks(i)], ragged_left=self.left[i], ragged_right=self.right[i])

    def groups(self, width: int | None, every: int) -> Iterator[tuple[np.ndarray, bool]]:
        """Blocks that have k-mers and events, in groups of like length and paths whose windows fit together, and whether they are short."""
        some = np.flatnonzero((self.nx > 0) & (self.ny > 0))
        total = self.nx + self.ny
        size = np.minimum(total, every) * 3 * self.paths * (np.minimum(self.nx, width or 1 << 60) + 1)
        kind = np.stack([total > every, self.paths], 1)
        group: list[int] = []
        for i in some[np.lexsort((total[some], self.paths[some], total[some] > every))].tolist():
            if group and ((len(group) + 1) * size[i] > HELD or (kind[i] != kind[group[0]]).any()):
                yield np.array(group), not kind[group[0], 0]
                group = []
            group.append(i)
        if group:
            yield np.array(group), not kind[group[0], 0]


class Scaled:
    """Blocks of like length on probabilities. Cells of a diagonal are [block, x - least x + 1, path] with a zero at both ends, over a factor for each block.

    Products below the least number are lost. What is lost on a diagonal is at most TINY over its factors, and its share
    of the whole at most that times the diagonal's greatest forward and backward values over the total: `exact` tells for
    each block whether all of that is below LOSS.
    """

    def __init__(self, data: Blocks, rows: np.ndarray, emission, transitions: np.ndarray, width: int | None):
        self.emission, self.t = emission, transitions
        self.nx, self.ny = data.nx[rows], data.ny[rows]
        self.last = self.nx + self.ny
        n, top, self.paths = len(rows), int(self.last.max()), int(data.paths[rows].max())
        x = np.arange(self.nx.max())
        place = np.minimum(data.place[rows][:, None] + x, len(data.path) - 2)
        at = data.path[place][:, :, None] + np.arange(self.paths)
        own = (x < self.nx[:, None])[:, :, None] & (at < data.path[place + 1][:, :, None])
        code = data.code[np.where(own, at, 0)]
        self.code = np.where(own, code, -1)
        self.kmer = np.full((n, len(x) + 2, self.paths), -2)  # -1: no level, -2: no such path
        self.kmer[:, 1:-1] = np.where(own, data.known[code], -2)
        self.kmer[:, 0] = self.kmer[:, 1]  # events before the first k-mer are extra events of it, on each of its paths
        y = np.arange(self.ny.max())
        self.event = np.zeros((n, len(y) + 1))
        self.event[:, 1:] = data.level[np.minimum(data.event[rows][:, None] + y, len(data.level) - 1)]
        self.low, self.high = np.zeros((n, top + 1), np.int64), np.full((n, top + 1), -1)
        for i, r in enumerate(rows.tolist()):
            self.low[i, : self.last[i] + 1], self.high[i, : self.last[i] + 1] = data.band(r, width)
        self.width = int((self.high - self.low).max()) + 1
        self.before = self.after = None
        if self.paths > 1:
            tail, head = (np.where(own, e[code], -2) for e in (data.tail, data.head))
            a, b = tail[:, :-1, :, None], head[:, 1:, None, :]
            self.before, self.after = self._near(((a == b) | (a == -1) | (b == -1)) & (a > -2) & (b > -2), own)
        self.left, self.right = data.left[rows], data.right[rows]
        self.block, self.step = np.arange(n), np.arange(self.width)
        self.base = self.block[:, None] * (self.width + 2)
        self.expected, self.exact = np.zeros((n, 3, 3)), np.ones(n, bool)

    def _near(self, gate: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[block, x, path, i]: the paths at x - 1 that may go on to one at x, and those at x + 1 that one at x may go on to; -1 for none."""
        n, x, p = own.shape

        def listed(allowed: np.ndarray) -> np.ndarray:  # [..., path, other]
            most = max(int(allowed.sum(-1).max(initial=0)), 1)
            order = np.argsort(~allowed, axis=-1, kind="stable")[..., :most]
            return np.where(np.take_along_axis(allowed, order, -1), order, -1)

        first = np.where(own[:, 0], np.arange(p), -1)
        back, on = listed(gate.swapaxes(2, 3)), listed(gate)
        before, after = np.full((n, x + 2, p, back.shape[-1]), -1), np.full((n, x + 2, p, on.shape[-1]), -1)
        before[:, 1, :, 0], before[:, 2 : x + 1] = first, back
        after[:, 0, :, 0], after[:, 1:x] = first, on
        return before, after

    def _taken(self, cells: np.ndarray, d: int, x: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Cells of diagonal d at the places x; with `near`, sums of those of the paths it lists."""
        at = np.clip(x - self.low[:, d, None], -1, self.width) + 1 + self.base
        if near is None:
            return cells.reshape(-1, self.paths).take(at, axis=0) if self.paths > 1 else cells.ravel().take(at)[:, :, None]
        flat, at, none = cells.ravel(), at[:, :, None] * self.paths, (self.base * self.paths)[:, :, None]
        return sum(flat.take(np.where(near[..., i] < 0, none, at + near[..., i])) for i in range(near.shape[-1]))

    def _near_of(self, near: np.ndarray | None, x: np.ndarray) -> np.ndarray | None:
        return None if near is None else near[self.block[:, None], np.clip(x, 0, near.shape[1] - 1)]

    def _framed(self) -> np.ndarray:
        return np.zeros((len(self.block), self.width + 2, self.paths))

    def _emissions(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = d - x
        kmer = self.kmer[self.block[:, None], np.clip(x, 0, self.kmer.shape[1] - 1)]
        event = self.event[self.block[:, None], np.clip(y, 0, self.event.shape[1] - 1)][:, :, None]
        some = ((x <= self.high[:, d, None]) & (y >= 0))[:, :, None] & (kmer > -2)
        ahead = (x > 0)[:, :, None]
        skip = np.where(some & ahead, math.exp(SKIP_EMISSION), 0.0)
        if not len(self.emission.kmers):
            return np.zeros_like(skip), skip, np.zeros_like(skip)
        blank = np.isnan(event)
        seen = some & (kmer >= 0) & (y > 0)[:, :, None]
        match, extra = self.emission.densities(np.maximum(kmer, 0), np.where(blank, 0.0, event))
        if blank.any():
            match, extra = np.where(blank, 1.0, match), np.where(blank, 1.0, extra)
        return np.where(seen & ahead, match, 0.0), skip, np.where(seen, extra, 0.0)

    def _end(self) -> np.ndarray:
        gap = [math.sqrt(self.t[MATCH, SKIP] * self.t[MATCH, EXTRA]), self.t[SKIP, SKIP], self.t[EXTRA, EXTRA]]
        return np.where(self.right[:, None], gap, self.t[:, MATCH])

    def _scaled(self, cells: tuple, d: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Log of the greatest value of each block and the cells over it, framed; `before`: logs of the factor before."""
        top = np.maximum(np.maximum(cells[0], cells[1]), cells[2]).max(axis=(1, 2))
        live = d <= self.last
        self.exact &= (top > 0) | ~live
        top = np.where((top > 0) & live, top, 1.0)
        out = []
        for c in cells:
            frame = self._framed()
            frame[:, 1:-1] = c / top[:, None, None]
            out.append(frame)
        log = np.log(top)
        return log, np.maximum(0, -before) - log, out

    def run(self, threshold: float, expectations: bool = False) -> list[tuple[np.ndarray, ...]]:
        """Arrays (block, x, y, path, p) as `Batch.matches` gives them; then `total`, `expected` and `exact` are set."""
        t, n, end = self.t, len(self.block), int(self.last.max())
        start = [self._framed() for _ in range(3)]
        own = np.where(self.kmer[:, 1] > -2, 1.0, 0.0)
        for state in range(3):
            start[state][:, 1] = own * (self.left == (state != MATCH))[:, None]
        cells, emitted, sums, risk = [start], [None], np.zeros((n, end + 1)), np.zeros((n, end + 1))
        log = np.zeros(n)
        self.total = np.full(n, -np.inf)
        stop = self._end()
        for d in range(end + 1):
            if d:
                x = self.low[:, d, None] + self.step
                near = self._near_of(self.before, x)
                match, skip, extra = emission = self._emissions(d, x)
                one = cells[d - 1]
                along = self._taken(one[MATCH] * t[MATCH, SKIP] + one[SKIP] * t[SKIP, SKIP] + one[EXTRA] * t[EXTRA, SKIP], d - 1, x - 1, near)
                stay = self._taken(one[MATCH] * t[MATCH, EXTRA] + one[SKIP] * t[SKIP, EXTRA] + one[EXTRA] * t[EXTRA, EXTRA], d - 1, x)
                across = np.zeros_like(stay)
                if d > 1:
                    two = cells[d - 2]
                    across = self._taken(two[MATCH] * t[MATCH, MATCH] + two[SKIP] * t[SKIP, MATCH] + two[EXTRA] * t[EXTRA, MATCH], d - 2, x - 1, near) * np.exp(-log)[:, None, None]
                log, risk[:, d], now = self._scaled((across * match, along * skip, stay * extra), d, log)
                sums[:, d] = sums[:, d - 1] + log
                cells.append(now)
                emitted.append(emission)
            ended = np.flatnonzero(self.last == d)
            if len(ended):
                with np.errstate(divide="ignore"):
                    self.total[ended] = np.log(sum(cells[d][s][ended].sum(axis=(1, 2)) * stop[ended, s] for s in range(3))) + sums[ended, d]
        self.exact &= np.isfinite(self.total)
        total = np.where(np.isfinite(self.total), self.total, np.inf)
        found, ahead, back_sums, log = [], {}, np.zeros(n), np.zeros(n)
        for d in range(end, -1, -1):
            x = self.low[:, d, None] + self.step
            near, now = self._near_of(self.after, x), cells[d]
            moves = [np.zeros((n, self.width, self.paths))] * 3
            if d < end:
                moves[SKIP], moves[EXTRA] = self._taken(ahead[d + 1][SKIP], d + 1, x + 1, near), self._taken(ahead[d + 1][EXTRA], d + 1, x)
            if d + 1 < end:
                moves[MATCH] = self._taken(ahead[d + 2][MATCH], d + 2, x + 1, near) * np.exp(-log)[:, None, None]
            if expectations:
                share = np.exp(sums[:, d] + back_sums - total)
                for a in range(3):
                    for b in range(3):
                        if t[a, b]:
                            self.expected[:, a, b] += t[a, b] * share * (now[a][:, 1:-1] * moves[b]).sum(axis=(1, 2))
            inside = (x <= self.high[:, d, None])[:, :, None]
            last = (self.last == d)[:, None, None]
            raw = tuple(np.where(inside, np.where(last, stop[:, a, None, None], sum(t[a, b] * moves[b] for b in range(3) if t[a, b])), 0.0) for a in range(3))
            log, lost, back = self._scaled(raw, d, log)
            back_sums = back_sums + log
            with np.errstate(over="ignore"):
                share = np.exp(sums[:, d] + back_sums - total)
            live = d <= self.last
            self.exact &= ~live | (TINY + np.maximum(risk[:, d], lost) + sums[:, d] + back_sums - total + math.log(3 * (end + 1) * self.width * self.paths) < LOSS)
            if d:
                with np.errstate(invalid="ignore", over="ignore"):
                    p = now[MATCH][:, 1:-1] * back[MATCH][:, 1:-1] * share[:, None, None]
                i, j, path = np.nonzero(p >= threshold)
                if len(i):
                    found.append((i, x[i, j] - 1, d - x[i, j] - 1, path, np.floor(np.minimum(p[i, j, path], 1.0) * 1e7) / 1e7))
                for b, e in zip(back, emitted[d], strict=True):
                    b[:, 1:-1] *= e
                ahead[d] = back
            ahead.pop(d + 2, None)
            cells[d] = emitted[d] = None
        return found


def aligned(batch: pa.RecordBatch, emission, threshold: float, width: int | None, transitions: np.ndarray, every: int, expectations: bool = False) -> Iterator[tuple]:
    """For each group of a batch's blocks: their rows, log-likelihoods and expected transitions, and row, x, y, k-mer's number, p of pairs; with the batch's `Blocks`."""
    data = Blocks(batch, emission)
    for rows, short in data.groups(width, every):
        rest = rows
        if short:
            z = Scaled(data, rows, emission, transitions, width)
            found = z.run(threshold, expectations)
            i, x, y, path, p = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
            some = z.exact[i]
            i, x, y, path, p = (c[some] for c in (i, x, y, path, p))
            yield data, rows[z.exact], z.total[z.exact], z.expected[z.exact], (rows[i], x, y, z.code[i, x, path], p)
            rest = rows[~z.exact]
        if len(rest):
            z = Batch([data.row(r) for r in rest.tolist()], emission, transitions, width, every)
            i, x, y, path, p = (np.concatenate(c) for c in zip(*z.matches(threshold, expectations), strict=True))
            yield data, rest, z.total, z.expected, (rest[i], x, y, data.code[data.path[data.place[rest[i]] + x] + path], p)


PAIRS = pa.schema([("read_id", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("kmer", pa.string()), ("p", pa.float64())])


def posteriors(blocks: DataFrame, emission: Gaussian | Tabulated, threshold: float = 0.01, width: int | None = None, transitions: np.ndarray = TRANSITIONS, every: int = MARK_EVERY) -> DataFrame:
    """read_id, x, y, kmer and p of all pairs that reach the threshold, in the read's own places. blocks: schema BLOCK.

    width: cells about the line through the anchors. every: diagonals that a task holds at once. Blocks without k-mers or events give no rows. Null levels of events say nothing about k-mers.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(emission)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, _, _, (i, x, y, code, p) in aligned(batch, shared.value, threshold, width, transitions, every):
                names = pc.take(pa.array(data.names, pa.string()), pa.array(code, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(data.ids[i]), pa.array(x + data.x0[i]), pa.array(y + data.y0[i]), names, pa.array(p, pa.float64())], schema=PAIRS)

    return blocks.mapInArrow(run, "read_id long, x long, y long, kmer string, p double")


def likelihoods(blocks: DataFrame, emission: Gaussian | Tabulated, width: int | None = None, transitions: np.ndarray = TRANSITIONS) -> DataFrame:
    """read_id, block and the log-likelihood of every block with k-mers and events."""
    shared = blocks.sparkSession.sparkContext.broadcast(emission)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, rows, total, _, _ in aligned(batch, shared.value, 2.0, width, transitions, MARK_EVERY):
                yield pa.RecordBatch.from_arrays([pa.array(data.ids[rows]), pa.array(data.number[rows]), pa.array(total)], names=["read_id", "block", "log_likelihood"])

    return blocks.mapInArrow(run, "read_id long, block long, log_likelihood double")


def expectations(blocks: DataFrame, emission: Gaussian | Tabulated, transitions: np.ndarray, width: int | None = None) -> DataFrame:
    """Summed over blocks: by kind 't' (from, to) expected transitions, by kind 'k' (kmer) sums of p, p x and p x**2, 'z' log-likelihoods."""
    shared = blocks.sparkSession.sparkContext.broadcast(emission)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, _, total, expected, (i, _, y, code, p) in aligned(batch, shared.value, 0.01, width, transitions, MARK_EVERY, True):
                event = data.level[data.event[i] + y]
                some = ~np.isnan(event)
                event, code, p = event[some], code[some], p[some]
                used = np.unique(code)
                sums = [np.bincount(code, w, len(data.names))[used] if len(used) else np.zeros(0) for w in (p, p * event, p * event * event)]
                ok = np.isfinite(total)
                out = [("k", data.names[c], *map(float, v)) for c, *v in zip(used.tolist(), *sums, strict=True)]
                out.append(("z", "", float(ok.sum()), float(total[ok].sum()), 0.0))
                out += [("t", f"{a}{b}", float(expected[:, a, b].sum()), 0.0, 0.0) for a in range(3) for b in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), *[pa.float64()] * 3), strict=True)], names=["kind", "key", "p", "px", "pxx"])

    sums = blocks.mapInArrow(run, "kind string, key string, p double, px double, pxx double")
    return sums.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("p", "px", "pxx")])


def gaussian_emission(model: DataFrame) -> Gaussian:
    """Of a model's rows kmer, level_mean, level_sd (above 0); more than MAX_KMERS raise a ValueError."""
    rows = model.select("kmer", "level_mean", "level_sd").where("kmer is not null and level_sd > 0").limit(MAX_KMERS + 1).collect()
    if len(rows) > MAX_KMERS:
        raise ValueError(f"more than {MAX_KMERS} k-mers")
    rows.sort()
    return Gaussian({r["kmer"]: i for i, r in enumerate(rows)}, np.array([r["level_mean"] for r in rows], float), np.array([r["level_sd"] for r in rows], float))


def tabulated_emission(knots: DataFrame, scale: float = 1.0, shift: float = 0.0, key: str = "node") -> Tabulated:
    """Of the knots of k-mers on one evenly spaced grid: key, grid_ix, x, pdf, slope. More than MAX_KNOTS values raise a ValueError."""
    rows = knots.select(key, "grid_ix", "x", "pdf", "slope").limit(MAX_KNOTS + 1).collect()
    if len(rows) > MAX_KNOTS:
        raise ValueError(f"more than {MAX_KNOTS} knots: take fewer points for so many k-mers")
    names = sorted({r[key] for r in rows})
    number, points = {k: i for i, k in enumerate(names)}, 1 + max((r["grid_ix"] for r in rows), default=0)
    x, pdf, slope = np.zeros(points), np.full((len(names), points), np.nan), np.zeros((len(names), points))
    for r in rows:
        x[r["grid_ix"]] = r["x"]
        pdf[number[r[key]], r["grid_ix"]], slope[number[r[key]], r["grid_ix"]] = r["pdf"], r["slope"]
    if np.isnan(pdf).any() or points < 2:
        raise ValueError("every k-mer needs every point of one grid of two points or more")
    return Tabulated(number, float(x[0]), float(x[1] - x[0]), pdf, slope, scale, shift)


def baum_welch(blocks: DataFrame, model: DataFrame, iterations: int, width: int | None = None) -> tuple[np.ndarray, DataFrame, list[float]]:
    """Transitions, model and the log-likelihood before each iteration. The driver keeps nine transitions and one row a k-mer.

    Give blocks that are written, since each iteration reads them. A k-mer without matches, or whose matches have no
    spread, keeps its level and deviation.
    """
    emission, trans, history = gaussian_emission(model), TRANSITIONS, []
    for _ in range(iterations):
        sums = expectations(blocks, emission, trans, width).collect()  # at most the k-mers of the model
        history.append(sum(r["px"] for r in sums if r["kind"] == "z"))
        counts = np.zeros((3, 3))
        level, sd = emission.level.copy(), emission.sd.copy()
        for r in sums:
            if r["kind"] == "t":
                counts[int(r["key"][0]), int(r["key"][1])] = r["p"]
            if r["kind"] == "k" and r["p"] > 0:
                mean = r["px"] / r["p"]
                spread = r["pxx"] / r["p"] - mean * mean
                if spread > 1e-12 * mean * mean:
                    i = emission.kmers[r["key"]]
                    level[i], sd[i] = mean, math.sqrt(spread)
        trans = np.where(counts.sum(axis=1, keepdims=True) > 0, counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300), trans)
        emission = Gaussian(emission.kmers, level, sd)
    rows = [(k, float(emission.level[i]), float(emission.sd[i])) for k, i in emission.kmers.items()]
    return trans, blocks.sparkSession.createDataFrame(rows, "kmer string, level_mean double, level_sd double"), history
