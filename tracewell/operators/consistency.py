"""Pairs made consistent: the heaviest chain of a read's pairs, and columns of several sequences merged in a partial order."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = 10_000_000  #: weights are compared in whole parts of 1 / UNIT, so that equal totals are equal
MAX_POSITIONS = 1 << 20  #: of the sequences of one group that is merged in a task


def chain(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of a strictly increasing chain of greatest total weight. x, y: in order of (x, y); w: whole numbers above 0.

    Of equal totals the one wins whose last pair comes first, and so on backwards from there. A Fenwick tree over the
    ranks of y holds the best chain that ends at or below each rank; pairs of one x enter it together.
    """
    n = len(x)
    rank = np.unique(y, return_inverse=True)[1] + 1
    size = int(rank.max(initial=0))
    best = [(0, 1)] * (size + 1)  # total and minus the place of the last pair; 1 stands for no pair
    total, before = [0] * n, [-1] * n
    ranks, weights = rank.tolist(), w.tolist()
    for low, high in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.flatnonzero(np.r_[True, x[1:] != x[:-1]]), n).tolist() if n else [0]), strict=True):
        for i in range(low, high):
            top, r = (0, 1), ranks[i] - 1
            while r > 0:
                top = max(top, best[r])
                r &= r - 1
            total[i], before[i] = top[0] + weights[i], -top[1] if top[0] else -1
        for i in range(low, high):
            r = ranks[i]
            while r <= size:
                best[r] = max(best[r], (total[i], -i))
                r += r & -r
    at = max(range(n), key=lambda i: (total[i], -i)) if n else -1
    out = []
    while at >= 0:
        out.append(at)
        at = before[at]
    return np.array(out[::-1], np.int64)


def segments(pairs: DataFrame, key: str) -> DataFrame:
    """Adds `segment`: a new one begins where all pairs before lie strictly below all pairs from there on, in x and y.

    A heaviest chain is made of the heaviest chains of the segments, so a long read is no single task's work.
    """
    after = Window.partitionBy(key).orderBy(F.desc("x"), F.desc("y")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, -1)
    lows = pairs.select("*", F.min("y").over(after).alias("_low"))
    marked = lows.select("*", F.max("y").over(before).alias("_y"), F.max("x").over(before).alias("_x"))
    new = F.when((F.col("_x") < F.col("x")) & (F.col("_y") < F.col("_low")), 1).otherwise(0)
    order = Window.partitionBy(key).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(*pairs.columns, F.sum(new).over(order).cast("long").alias("segment"))


def heaviest_chains(pairs: DataFrame, key: str = "read_id", weight: str = "p", least: float = 0.0) -> DataFrame:
    """key, x, y and weight of the pairs of each key's heaviest strictly increasing chain.

    Pairs of no more than `least`, or without a weight, do not count; the weight of a chain is what its pairs have above
    it. Of a pair that is given twice the heavier counts. Weights are compared in ten-millionths.
    """
    units = F.round((F.col(weight) - least) * UNIT).cast("long")
    one = pairs.select(key, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col(weight).cast("double").alias(weight), units.alias("_u")).where("_u > 0 and x is not null and y is not null")
    rows = segments(one.groupBy(key, "x", "y").agg(F.max(weight).alias(weight), F.max("_u").alias("_u")), key)
    kind = rows.schema[key].dataType.simpleString()

    def best(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["x", "y"], ignore_index=True)
        return t.loc[chain(t["x"].to_numpy(), t["y"].to_numpy(), t["_u"].to_numpy()), [key, "x", "y", weight]]

    return rows.groupBy(key, "segment").applyInPandas(best, f"{key} {kind}, x long, y long, {weight} double")


class Order:
    """Columns of positions, merged while the order along every sequence stays free of cycles."""

    def __init__(self, lengths: dict[int, int]):
        first = np.append(0, np.cumsum(list(lengths.values())))
        self.begin = dict(zip(lengths, first[:-1].tolist(), strict=True))
        n = int(first[-1])
        self.head = list(range(n))  # union-find
        self.members = [[i] for i in range(n)]
        self.sequence = np.repeat(np.arange(len(lengths)), list(lengths.values())).tolist()
        self.ends = set((first[1:] - 1).tolist())
        self.rank = [0] * n  # a topological order of the heads
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            self.rank[low:high] = range(high - low)

    def find(self, i: int) -> int:
        while self.head[i] != i:
            self.head[i] = self.head[self.head[i]]
            i = self.head[i]
        return i

    def after(self, c: int) -> set[int]:
        return {self.find(i + 1) for i in self.members[c] if i not in self.ends}

    def reaches(self, a: int, b: int) -> bool:
        """Whether column b comes after column a."""
        seen, stack, limit = {a}, [a], self.rank[b]
        while stack:
            for c in self.after(stack.pop()):
                if c == b:
                    return True
                if c not in seen and self.rank[c] < limit:
                    seen.add(c)
                    stack.append(c)
        return False

    def merge(self, a: int, b: int) -> bool:
        """Merges two columns, unless they share a sequence or one comes after the other."""
        if {self.sequence[i] for i in self.members[a]} & {self.sequence[i] for i in self.members[b]} or self.reaches(a, b) or self.reaches(b, a):
            return False
        self.head[b] = a
        self.members[a] += self.members[b]
        self.rank[a] = max(self.rank[a], self.rank[b])
        stack = [a]
        while stack:  # what comes after moves up as far as it has to
            c = stack.pop()
            for x in self.after(c):
                if self.rank[x] <= self.rank[c]:
                    self.rank[x] = self.rank[c] + 1
                    stack.append(x)
        return True


def merged(lengths: dict[int, int], pairs: list[tuple[int, int, int, int, float]], least: float) -> dict[tuple[int, int], int]:
    """(sequence, position) -> column. pairs: sequence, position, sequence, position, weight.

    The two columns of greatest average weight are merged first (if equal, those whose first positions come first), and
    their weights to any third are averaged over all pairs; those that cannot be merged stay apart. It ends below `least`.
    """
    order = Order(lengths)
    links: dict[int, dict[int, list]] = defaultdict(dict)
    for s, x, t, y, w in pairs:
        a, b = order.begin[s] + x, order.begin[t] + y
        if s != t:
            both = links[a].setdefault(b, [0.0, 0])
            both[0], both[1] = both[0] + w, both[1] + 1
            links[b][a] = both
    queue = [(-w[0] / w[1], a, b, w[1]) for a, ways in links.items() for b, w in ways.items() if a < b]
    heapq.heapify(queue)
    while queue:
        weight, a, b, n = heapq.heappop(queue)
        if -weight < least:
            break
        now = links.get(a, {}).get(b)
        if now is None or now[1] != n or -now[0] / now[1] != weight:
            continue  # of columns that have changed since
        del links[a][b], links[b][a]
        if not order.merge(a, b):
            continue
        for c, w in links.pop(b, {}).items():
            del links[c][b]
            both = links[a].setdefault(c, [0.0, 0])
            both[0], both[1] = both[0] + w[0], both[1] + w[1]
            links[c][a] = both
            heapq.heappush(queue, (-both[0] / both[1], min(a, c), max(a, c), both[1]))
    return {(s, i - at): order.find(i) for s, at in order.begin.items() for i in range(at, at + lengths[s])}


def columns(sequences: DataFrame, pairs: DataFrame, least: float = 0.5, key: str = "contig") -> DataFrame:
    """key, sequence, position and column of every position of every sequence. sequences: key, sequence, length; pairs: key, s, x, t, y, w.

    A key's sequences are aligned together in one task; more than MAX_POSITIONS positions of a key raise an error, so cut
    contigs into windows first. Columns have numbers from 0 in an order that agrees with every sequence. Pairs outside
    the sequences, or without a weight, do not count.
    """
    kind = sequences.schema[key].dataType.simpleString()

    def one(lengths: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        n = {int(s): int(v) for s, v in sorted(zip(lengths["sequence"], lengths["length"], strict=True))}
        if sum(n.values()) > MAX_POSITIONS:
            raise ValueError(f"more than {MAX_POSITIONS} positions of one {key}")
        given = given.dropna().sort_values(["s", "x", "t", "y"])
        rows = [(s, x, t, y, w) for s, x, t, y, w in given[["s", "x", "t", "y", "w"]].itertuples(index=False) if s in n and t in n and 0 <= x < n[s] and 0 <= y < n[t]]
        at = merged(n, rows, least)
        numbers = number(n, at)
        return pd.DataFrame([(lengths[key].iloc[0], s, x, numbers[c]) for (s, x), c in at.items()], columns=[key, "sequence", "position", "column"])

    return sequences.groupBy(key).cogroup(pairs.groupBy(key)).applyInPandas(lambda a, b: one(a, b) if len(a) else pd.DataFrame(columns=[key, "sequence", "position", "column"]), f"{key} {kind}, sequence long, position long, column long")


def number(lengths: dict[int, int], at: dict[tuple[int, int], int]) -> dict[int, int]:
    """Columns in a topological order, those of the first positions first."""
    waits: dict[int, int] = defaultdict(int)
    after: dict[int, list[int]] = defaultdict(list)
    least: dict[int, tuple[int, int]] = {}
    for (s, x), c in at.items():
        least[c] = min(least.get(c, (x, s)), (x, s))
        if x + 1 < lengths[s]:
            after[c].append(at[s, x + 1])
            waits[at[s, x + 1]] += 1
    ready = [(least[c], c) for c in least if not waits[c]]
    heapq.heapify(ready)
    out: dict[int, int] = {}
    while ready:
        _, c = heapq.heappop(ready)
        out[c] = len(out)
        for d in after[c]:
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, (least[d], d))
    return out
