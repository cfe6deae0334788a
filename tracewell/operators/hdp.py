"""k-mer densities from a hierarchical Dirichlet process mixture of normals on a tree of k-mers, sampled in parallel.

Every node of the tree has a process whose base is its parent's; measurements belong to nodes, as a rule to leaves. The
process is truncated to a number of components, as in blocked Gibbs samplers: given weights and components, every
measurement's component is drawn independently, in one pass over all rows with uniforms hashed from the row. What a
sweep sends is sums by node and component. Tables, which are a node's customers at its parent, are drawn from the leaves
up, weights from the root down; both are arrays of nodes times components, whose number MAX_NODES bounds.

A sample's density at a node mixes the components' posterior predictive densities by the node's predictive weights: its
own counts, and its concentration times its parent's weights. So a node without data has its parent's density.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .kmeans import kmeans
from .priors import concentration

MAX_NODES = 65_536  #: of a tree; the largest model has 46,656 k-mers
ROOT = ""


@dataclass
class Tree:
    """Nodes in order of depth, the root first, with each node's parent (the root's is itself) and depth."""

    nodes: list[str]
    parent: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, pairs: dict[str, str]) -> Tree:
        """pairs: parent of every node but the root."""
        if len(pairs) >= MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} nodes")
        depth = {ROOT: 0}
        for node in pairs:
            way = []
            while node not in depth:
                if node not in pairs or node in way:
                    raise ValueError(f"{node!r} does not lead to the root")
                way.append(node)
                node = pairs[node]
            for d, x in enumerate(reversed(way), depth[node] + 1):
                depth[x] = d
        nodes = sorted(depth, key=lambda x: (depth[x], x))
        at = {x: i for i, x in enumerate(nodes)}
        return cls(nodes, np.array([at[pairs.get(x, ROOT)] for x in nodes]), np.array([depth[x] for x in nodes]))

    @classmethod
    def read(cls, tree: DataFrame) -> Tree:
        """tree: node, parent; more than MAX_NODES raise a ValueError."""
        return cls.of({r["node"]: r["parent"] for r in tree.select("node", "parent").distinct().limit(MAX_NODES + 1).collect()})

    def levels(self) -> Iterator[np.ndarray]:
        """The nodes of each depth, from the root's children down."""
        for d in range(1, int(self.depth.max()) + 1):
            yield np.flatnonzero(self.depth == d)

    def observed(self, counts: np.ndarray) -> np.ndarray:
        """Whether a node or one below it has data."""
        seen = counts.sum(axis=1) > 0
        for at in reversed(list(self.levels())):
            np.logical_or.at(seen, self.parent[at], seen[at])
        return seen


def push_down(tree: Tree, counts: np.ndarray, alpha: Sequence[float]) -> np.ndarray:
    """Predictive weights of every node. counts: [node, component] own data and children's tables; alpha: concentrations by depth.

    The last column is what the root leaves to components that nothing belongs to.
    """
    all_of = counts.sum(axis=1, keepdims=True)
    out = np.zeros((len(counts), counts.shape[1] + 1))
    out[0, :-1], out[0, -1] = counts[0] / (alpha[0] + all_of[0]), alpha[0] / (alpha[0] + all_of[0, 0])
    for d, at in enumerate(tree.levels(), 1):
        out[at, :-1] = counts[at]
        out[at] = (out[at] + alpha[d] * out[tree.parent[at]]) / (alpha[d] + all_of[at])
    return out


def tables_of(rng: np.random.Generator, n: int, a: float) -> int:
    """A draw of the number of tables that n measurements take, where the i-th opens one with probability a / (a + i).

    From one opening the next is found by inverting the probability that none comes before, so the work grows with the
    number of tables, which is about a * log(n / a), and not with n.
    """

    def none_until(i: float) -> float:  # log of i! / gamma(i + 1 + a), by its expansion where lgamma would cancel
        return -a * math.log(i + (a + 1) / 2) if i > 1e6 else math.lgamma(i + 1) - math.lgamma(i + 1 + a)

    drawn, at = 0, 0
    while at < n:
        drawn += 1
        limit = none_until(at) + math.log(1 - rng.random())
        low, high = at, n  # none has come until low; n stands for never
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if none_until(mid) >= limit else (low, mid)
        at = high
    return drawn


def seat(rng: np.random.Generator, tree: Tree, data: np.ndarray, weights: np.ndarray, alpha: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Customers of every node by component, its data and its children's tables; and the tables it has itself."""
    customers, tables = data.astype(np.int64).copy(), np.zeros(data.shape, np.int64)
    for d in range(int(tree.depth.max()), 0, -1):
        for i in np.flatnonzero(tree.depth == d):
            for k in np.flatnonzero(customers[i]):
                tables[i, k] = tables_of(rng, int(customers[i, k]), alpha[d] * weights[tree.parent[i], k])
            customers[tree.parent[i]] += tables[i]
    return customers, tables


@dataclass
class Base:
    """The normal-inverse-gamma base of the components' means and variances."""

    mu: float
    nu: float
    alpha: float
    beta: float

    def posterior(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """mu, nu, alpha, beta given numbers, sums and sums of squares."""
        mean = np.divide(s, n, out=np.full(len(n), self.mu), where=n > 0)
        beta = self.beta + np.maximum(q - n * mean * mean, 0) / 2 + self.nu * n * (mean - self.mu) ** 2 / (2 * (self.nu + n))
        return (self.nu * self.mu + s) / (self.nu + n), self.nu + n, self.alpha + n / 2, beta


@dataclass
class Sample:
    """Predictive weights [node, component], the last component being new ones, and each one's Student density."""

    weights: np.ndarray
    freedom: np.ndarray
    place: np.ndarray
    scale: np.ndarray

    def density(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Densities at x [node, place] of nodes with these weights."""
        log = np.array([math.lgamma((f + 1) / 2) - math.lgamma(f / 2) - 0.5 * math.log(f * math.pi) - math.log(c) for f, c in zip(self.freedom, self.scale, strict=True)])
        z = (x[None, :] - self.place[:, None]) / self.scale[:, None]
        return weights @ np.exp(log[:, None] - (self.freedom[:, None] + 1) / 2 * np.log1p(z * z / self.freedom[:, None]))


def _sweep(rows: DataFrame, tree: Tree, weights: np.ndarray, mu: np.ndarray, sd: np.ndarray, salt: int) -> np.ndarray:
    """Draws every row's component and sums up by node and component: numbers, sums and sums of squares."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, mu, sd))
    n_nodes, k = weights.shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, mu, sd = shared.value
        out = np.zeros((3, n_nodes * k))
        for frame in frames:
            for low in range(0, len(frame), 65_536):
                part = frame.iloc[low : low + 65_536]
                node, x = part["node"].to_numpy(), part["x"].to_numpy(float)
                with np.errstate(divide="ignore"):
                    log = np.log(weights[node]) - np.log(sd) - 0.5 * ((x[:, None] - mu) / sd) ** 2
                p = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
                z = np.minimum((p <= part["u"].to_numpy()[:, None] * p[:, -1:]).sum(axis=1), k - 1)
                at = node * k + z
                out += [np.bincount(at, w, n_nodes * k) for w in (np.ones(len(x)), x, x * x)]
        have = np.flatnonzero(out[0])
        yield pd.DataFrame({"at": have, "n": out[0, have], "s": out[1, have], "q": out[2, have]})

    u = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sums = rows.select("node", "x", u.alias("u")).mapInPandas(run, "at int, n double, s double, q double").groupBy("at").agg(*[F.sum(c).alias(c) for c in "nsq"])
    total = np.zeros((3, n_nodes * k))
    for r in sorted(sums.collect()):  # at most nodes times components
        total[:, r["at"]] = r["n"], r["s"], r["q"]
    return total.reshape(3, n_nodes, k)


def sample(rows: DataFrame, tree: DataFrame | None = None, components: int = 12, iterations: int = 30, burn_in: int = 10, thin: int = 5, seed: int = 1, gamma: float = 2.0, alpha: float = 4.0, concentrations: tuple[float, float] | None = None, start: str = "quantiles", base: Base | None = None) -> tuple[Tree, list[Sample]]:
    """The tree and the kept samples. rows: group (a node), id (unique), x; rows of no node of the tree, or without a value, do not count.

    tree: node, parent, with the empty string for the root; without it every group is a child of the root. gamma is the
    root's concentration, alpha that of all other depths; concentrations: shape and rate of their gamma prior, under
    which each depth's is drawn anew in every sweep. start: first components by `quantiles` or `kmeans`.
    """
    rng = np.random.default_rng(seed)
    rows = rows.select(F.col("group").cast("string").alias("group"), "id", F.col("x").cast("double").alias("x")).where("group is not null and x is not null and not isnan(x)")
    own = rows.select("group").distinct().limit(MAX_NODES + 1).collect() if tree is None else []
    known = Tree.read(tree) if tree is not None else Tree.of({r["group"]: ROOT for r in own})
    numbers = rows.sparkSession.createDataFrame([(x, i) for i, x in enumerate(known.nodes)], "group string, node int")
    rows = written(rows.join(F.broadcast(numbers), "group").select("node", "id", "x"))
    first = rows.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).first()
    var0 = max(float(first["v"] or 1.0), 1e-6)
    base = base or Base(float(first["m"] or 0.0), 0.1, 2.0, var0 / components)
    sd = np.full(components, math.sqrt(var0 / components))
    if start == "kmeans" and first["n"]:
        centres, cost = kmeans(rows, components, seed=seed)
        mu, sd = centres, np.full(components, max(math.sqrt(cost / first["n"]), 1e-3 * sd[0]))
    else:
        mu = np.array(rows.agg(F.percentile_approx("x", [(i + 0.5) / components for i in range(components)], 1000).alias("q")).first()["q"] or [base.mu] * components, float)
    weights = np.full((len(known.nodes), components), 1 / components)
    depths = [gamma] + [alpha] * int(known.depth.max())
    kept: list[Sample] = []
    for step in range(iterations):
        n, s, q = _sweep(rows, known, weights, mu, sd, seed * 100_003 + step)
        post = base.posterior(n.sum(axis=0), s.sum(axis=0), q.sum(axis=0))
        sd = 1 / np.sqrt(rng.gamma(post[2]) / post[3])
        mu = rng.normal(post[0], sd / np.sqrt(post[1]))
        customers, tables = seat(rng, known, n, weights, depths)
        if step >= burn_in and (step - burn_in) % thin == 0:
            a = (np.append(x, y) for x, y in zip(post, (base.mu, base.nu, base.alpha, base.beta), strict=True))
            place, nu, shape, rate = a
            kept.append(Sample(push_down(known, customers, depths), 2 * shape, place, np.sqrt(rate * (nu + 1) / (nu * shape))))
        if concentrations is not None:
            at_root = np.array([customers[0].sum()])
            depths[0] = concentration(rng, depths[0], at_root, np.count_nonzero(customers[0]), *concentrations)
            for d, at in enumerate(known.levels(), 1):
                depths[d] = concentration(rng, depths[d], customers[at].sum(axis=1), tables[at].sum(), *concentrations)
        weights[0] = rng.dirichlet(depths[0] / components + customers[0])
        for d, at in enumerate(known.levels(), 1):
            draw = rng.standard_gamma(np.maximum(depths[d] * weights[known.parent[at]] + customers[at], 1e-6))
            weights[at] = draw / np.maximum(draw.sum(axis=1, keepdims=True), 1e-300)
    return known, kept


def densities(spark: SparkSession, tree: Tree, kept: list[Sample], low: float, high: float, points: int) -> DataFrame:
    """group, grid_ix, x, pdf: every node's posterior predictive density over the kept samples, at evenly spaced points."""
    if not kept:
        raise ValueError("no samples were kept")
    rows = [(x, [s.weights[i].tolist() for s in kept]) for i, x in enumerate(tree.nodes)]
    table = spark.createDataFrame(rows, "group string, w array<array<double>>").repartition(max(1, len(rows) // 64))
    parts = [Sample(np.zeros((0, 0)), s.freedom, s.place, s.scale) for s in kept]
    x = np.array([low + i * ((high - low) / (points - 1)) for i in range(points)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 64):
                some = frame.iloc[at : at + 64]
                w = np.array([[list(v) for v in r] for r in some["w"]])
                pdf = sum(s.density(w[:, j], x) for j, s in enumerate(parts)) / len(parts)
                yield pd.DataFrame({"group": np.repeat(some["group"].to_numpy(), points), "grid_ix": np.tile(np.arange(points), len(some)), "x": np.tile(x, len(some)), "pdf": pdf.ravel()})

    return table.mapInPandas(run, "group string, grid_ix int, x double, pdf double")
