"""The mixture on a tree, starts by k-means, ancestors' densities and training with densities as emissions."""

import itertools
import math

import numpy as np
import pytest

from tracewell.operators import blocks, hdp, hmm, kmeans, metrics, training

from test_pairhmm import EVENTS, KMERS, PAIRS, tables


def test_tree_of_pairs():
    tree = hdp.Tree.of({"b": "a", "c": "a", "a": "", "d": ""})
    assert tree.nodes == ["", "a", "d", "b", "c"] and tree.parent.tolist() == [0, 0, 0, 1, 1] and tree.depth.tolist() == [0, 1, 1, 2, 2]
    assert [x.tolist() for x in tree.levels()] == [[1, 2], [3, 4]]
    assert tree.observed(np.array([[0], [0], [0], [0], [3]])).tolist() == [True, True, False, False, True]
    for bad in ({"a": "b", "b": "a"}, {"a": "gone"}):
        with pytest.raises(ValueError, match="does not lead to the root"):
            hdp.Tree.of(bad)


def test_push_down_equals_the_recursion():
    rng = np.random.default_rng(1)
    tree = hdp.Tree.of({"a": "", "b": "", "aa": "a", "ab": "a", "ba": "b"})
    counts, alpha = rng.integers(0, 9, (6, 3)), [1.5, 2.0, 5.0]
    counts[tree.nodes.index("ba")] = 0
    counts[tree.nodes.index("b")] = 0

    def weights(node):
        i = tree.nodes.index(node)
        a, above = alpha[tree.depth[i]], np.array([0, 0, 0, 1.0]) if not node else weights(node[:-1])
        return (np.append(counts[i], 0) + a * above) / (a + counts[i].sum())

    have = hdp.push_down(tree, counts, alpha)
    for i, node in enumerate(tree.nodes):
        assert have[i] == pytest.approx(weights(node)) and have[i].sum() == pytest.approx(1)
    assert have[tree.nodes.index("ba")] == pytest.approx(have[0])  # no data on the way: the root's


def test_seats_are_distributed_as_drawn():
    """A parent's customers are its children's tables, in number as customers that come one by one open them."""
    rng = np.random.default_rng(2)
    tree = hdp.Tree.of({"a": "", "aa": "a", "ab": "a"})
    data = np.array([[0, 0], [2, 0], [30, 4], [9, 0]])
    weights = np.full((4, 2), 0.5)
    got = np.array([hdp.seat(rng, tree, data, weights, [1.0, 3.0, 3.0])[0][1] for _ in range(3000)])
    opened = lambda n: (1.5 / (1.5 + np.arange(n))).sum()
    assert got.mean(axis=0) == pytest.approx([2 + opened(30) + opened(9), opened(4)], rel=0.03)


def test_posterior_of_the_base_and_student_density():
    """The predictive density is that of the normal-gamma model, integrated numerically."""
    base = hdp.Base(1.0, 2.0, 3.0, 4.0)
    x = np.array([0.5, 2.0, 3.5])
    mu, nu, a, b = base.posterior(np.array([3.0]), np.array([x.sum()]), np.array([(x * x).sum()]))
    s = hdp.Sample(np.ones((1, 1)), 2 * a, mu, np.sqrt(b * (nu + 1) / (nu * a)))
    t, m = np.linspace(1e-4, 6, 1500)[:, None], np.linspace(-5, 9, 900)[None, :]

    def joint(values):
        out = 3.0 * np.log(4.0) - math.lgamma(3.0) + 2.0 * np.log(t) - 4.0 * t + 0.5 * np.log(2.0 * t / (2 * np.pi)) - t * (m - 1.0) ** 2
        return np.exp(out + sum(0.5 * np.log(t / (2 * np.pi)) - 0.5 * t * (v - m) ** 2 for v in values)).sum()

    for v in (0.0, 2.0, 5.0):
        assert s.density(np.ones((1, 1)), np.array([v]))[0, 0] == pytest.approx(joint([*x, v]) / joint(x), rel=2e-3)


@pytest.mark.parametrize("start", ["quantiles", "kmeans"])
def test_tree_mixture(spark, start):
    """Leaves find their components; one without data has its parent's density exactly; a leaf of little data leans on its relatives."""
    rng = np.random.default_rng(8)
    parts = {"AA": (40, 150), "AB": (40, 150), "AC": (40, 3), "BA": (80, 200)}
    rows = [(g, 1000 * i + j, float(x)) for i, (g, (m, n)) in enumerate(parts.items()) for j, x in enumerate(rng.normal(m, 2, n))] + [("other", 9, 5.0), (None, 10, 5.0), ("AA", 11, None), ("AA", 12, math.nan)]
    tree = spark.createDataFrame([(k, k[0]) for k in ("AA", "AB", "AC", "AD", "BA", "BB")] + [("A", ""), ("B", "")], "node string, parent string")
    data = spark.createDataFrame(rows, "group string, id long, x double")
    known, kept = hdp.sample(data, tree, components=5, iterations=14, burn_in=6, thin=4, start=start)
    assert len(kept) == 2 and sorted(known.nodes) == ["", "A", "AA", "AB", "AC", "AD", "B", "BA", "BB"]
    d = hdp.densities(spark, known, kept, 0.0, 120.0, 241).toPandas().sort_values(["group", "grid_ix"])
    by = {g: t.pdf.to_numpy() for g, t in d.groupby("group")}
    x = np.linspace(0, 120, 241)
    assert all(np.trapezoid(p, x) == pytest.approx(1, abs=0.05) for p in by.values())
    assert by["AD"] == pytest.approx(by["A"]) and by["BB"] == pytest.approx(by["B"])
    for g, (m, _) in parts.items():
        assert abs(x[by[g].argmax()] - m) <= 2
    share = lambda g: by[g][(x > 30) & (x < 50)].sum() / by[g].sum()
    assert share("AA") > 0.9 and share("AC") > share("") > share("BA") and share("BA") < 0.2
    again = hdp.densities(spark, *hdp.sample(data.repartition(5), tree, components=5, iterations=14, burn_in=6, thin=4, start=start), 0.0, 120.0, 241).toPandas().sort_values(["group", "grid_ix"])
    assert again.pdf.to_numpy() == pytest.approx(d.pdf.to_numpy(), rel=1e-6, abs=1e-9)  # partitions do not matter


def test_mixture_of_nothing(spark):
    rows = spark.createDataFrame([], "group string, id long, x double")
    known, kept = hdp.sample(rows, components=3, iterations=2, burn_in=0, thin=1)
    assert known.nodes == [""] and len(kept) == 2 and kept[0].weights.tolist() == [[0, 0, 0, 1.0]]
    with pytest.raises(ValueError, match="no samples"):
        hdp.densities(spark, known, [], 0, 1, 2)


def best_cut(x, k):
    """The least objective of k means on a line: every cut of the ordered values."""
    x = sorted(x)
    cost = lambda part: sum((v - sum(part) / len(part)) ** 2 for v in part)
    return min(sum(cost(x[a:b]) for a, b in zip((0, *c), (*c, len(x)))) for c in itertools.combinations(range(1, len(x)), k - 1))


def test_kmeans(spark):
    rng = np.random.default_rng(3)
    x = [float(v) for m in (0, 10, 11, 40) for v in rng.normal(m, 0.5, 5)]
    rows = spark.createDataFrame(list(enumerate(x)) + [(100, None), (101, math.nan)], "id long, x double").repartition(4)
    for k in (1, 3, 4):
        centres, cost = kmeans.kmeans(rows, k, restarts=8, seed=2)
        assert len(centres) == k and (np.diff(centres) > 0).all()
        assert cost == pytest.approx(best_cut(x, k), rel=1e-6)
    few, cost = kmeans.kmeans(rows.where("id < 2"), 4)
    assert len(few) == 4 and cost == 0 and set(np.round(few, 9)) == set(np.round(x[:2], 9))
    assert kmeans.kmeans(rows.limit(0), 3)[0].tolist() == []
    with pytest.raises(ValueError, match="centres"):
        kmeans.kmeans(rows, 1 << 15, restarts=3)


def test_nearest_ancestor_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else "") for i in range(7)] + [("x", "y"), ("y", "")]
    values = spark.createDataFrame([("n1", 1.0), ("n3", None), ("n5", 5.0), ("gone", 9.0)], "node string, value double")
    have = {r.node: r.value for r in metrics.with_fallback(values, spark.createDataFrame(chain, "node string, parent string")).collect()}
    assert have == {"n0": None, "n1": 1, "n2": 1, "n3": 1, "n4": 1, "n5": 5, "n6": 5, "x": None, "y": None}


def test_training_with_densities(spark):
    """Levels with two humps: densities explain the events better than the normals of the first round."""
    rng = np.random.default_rng(5)
    humps = {"A": (40.0, 52.0), "B": (90.0, 90.0), "C": (140.0, 155.0)}
    reads = []
    for i in range(10):
        seq = [str(x) for x in rng.choice(list(humps), 40)]
        events = [float(rng.choice(humps[k]) + rng.normal(0, 1)) for k in seq]
        reads.append((i, seq, events, []))
    kmers, events, marks = tables(spark, reads)
    model = spark.createDataFrame([(k, (a + b) / 2, 8.0) for k, (a, b) in humps.items()], "kmer string, level_mean double, level_sd double")
    tree = spark.createDataFrame([(k, "") for k in humps], "node string, parent string")
    rows = blocks.read_blocks(kmers, events, marks)
    trans, emission, history = training.train(rows, events, model, tree, training.Grid(0.0, 200.0, 201), 2, components=8, iterations=12, burn_in=6, thin=3, start="kmeans")
    assert history[1] > history[0] + 50 and trans.sum(axis=1) == pytest.approx(np.ones(3))
    at = lambda k, v: float(emission.match(np.array([emission.kmers[k]]), np.array([v]))[0])
    assert at("A", 40.0) > at("A", 46.0) + 0.3 < at("A", 52.0) and at("B", 90.0) > at("B", 100.0)
    pairs = hmm.posteriors(rows, emission, 0.5)
    found = training.assignments(pairs, events, 0.5)
    assert found.count() == found.select("id").distinct().count() == pairs.count()


def test_schemas_are_those_of_the_aligner(spark):
    assert [spark.createDataFrame([], s).columns for s in (KMERS, EVENTS, PAIRS)] == [["read_id", "x", "options"], ["read_id", "y", "mean"], ["read_id", "x", "y"]]
