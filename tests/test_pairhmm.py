"""The pair HMM against plain recurrences cell by cell, over all paths, in blocks, over windows; its training; cuts of reads."""

import itertools
import math
from types import SimpleNamespace

import numpy as np
import pytest

from tracewell.functions import splines
from tracewell.operators import blocks, hmm

NAMES = [f"k{i}" for i in range(30)]


def plain(levels, sds, events, t=hmm.TRANSITIONS, left=False, right=False):
    """Log-likelihood and the match posteriors, cell by cell; a level of nan has no emission, an event of nan says nothing."""
    nx, ny = len(levels), len(events)
    with np.errstate(divide="ignore"):
        t = np.log(t)

    def emit(x, y, wide):
        if math.isnan(levels[x]):
            return -math.inf
        return 0.0 if math.isnan(events[y]) else hmm.gaussian(events[y], levels[x], sds[x] * wide)

    f = np.full((nx + 1, ny + 1, 3), -np.inf)
    f[0, 0] = [-np.inf, 0, 0] if left else [0, -np.inf, -np.inf]
    b = np.full((nx + 2, ny + 2, 3), -np.inf)
    end = np.array([(t[0, 1] + t[0, 2]) / 2, t[1, 1], t[2, 2]]) if right else t[:, 0]
    cells = sorted(itertools.product(range(nx + 1), range(ny + 1)), key=sum)
    for x, y in cells[1:]:
        k = max(x, 1) - 1
        if x and y:
            f[x, y, 0] = np.logaddexp.reduce(f[x - 1, y - 1] + t[:, 0]) + emit(k, y - 1, 1)
        if x:
            f[x, y, 1] = np.logaddexp.reduce(f[x - 1, y] + t[:, 1]) + hmm.SKIP_EMISSION
        if y:
            f[x, y, 2] = np.logaddexp.reduce(f[x, y - 1] + t[:, 2]) + emit(k, y - 1, hmm.EXTRA_WIDTH)
    b[nx, ny] = end
    for x, y in cells[-2::-1]:
        ahead = [b[x + 1, y + 1, 0] + emit(x, y, 1) if x < nx and y < ny else -np.inf, b[x + 1, y, 1] + hmm.SKIP_EMISSION if x < nx else -np.inf, b[x, y + 1, 2] + emit(max(x, 1) - 1, y, hmm.EXTRA_WIDTH) if y < ny else -np.inf]
        b[x, y] = np.logaddexp.reduce(t + ahead, axis=1)
    z = np.logaddexp.reduce(f[nx, ny] + end)
    return z, {(x - 1, y - 1): math.exp(f[x, y, 0] + b[x, y, 0] - z) for x, y in cells if x and y}


def block(kmers, events, anchors=None, left=False, right=False, **more):
    return SimpleNamespace(kmers=[k if isinstance(k, list) else [k] for k in kmers], events=list(events), anchors=anchors, ragged_left=left, ragged_right=right, **more)


def run(rows, emission, width=None, every=hmm.MARK_EVERY, threshold=1e-4, expectations=False):
    z = hmm.Batch(rows, emission, hmm.TRANSITIONS, width, every)
    out = [{} for _ in rows]
    for parts in z.matches(threshold, expectations):
        for i, x, y, path, p in zip(*parts):
            out[i][x, y, path] = p
    return z, out


def some_emission(rng):
    return hmm.Gaussian({k: i for i, k in enumerate(NAMES)}, rng.uniform(40, 90, 30), rng.uniform(1, 3, 30))


def some_read(rng, emission, nx, stay=0.2, skip=0.1, step=10):
    ids = rng.integers(0, 30, nx)
    events, anchors = [], []
    for x, i in enumerate(ids):
        if rng.random() > skip:
            if x % step == 0:
                anchors.append({"x": x, "y": len(events)})
            events += [emission.level[i] + rng.normal(0, 2) for _ in range(1 + (rng.random() < stay))]
    return [NAMES[i] for i in ids], events or [50.0], anchors


def test_batches_equal_plain_recurrences():
    """Blocks of different lengths in one batch, with every kind of end, unknown k-mers and blank events."""
    rng = np.random.default_rng(1)
    emission, rows, want = some_emission(rng), [], []
    for i in range(12):
        kmers, events, _ = some_read(rng, emission, int(rng.integers(1, 22)))
        if i % 3 == 1:
            kmers[len(kmers) // 2] = [None, "new"][i % 2]
            events[len(events) // 3] = math.nan
        left, right = bool(i & 1), bool(i & 2)
        rows.append(block(kmers, events, left=left, right=right))
        level = [emission.level[emission.kmers[k]] if k in emission.kmers else math.nan for k in kmers]
        sd = [emission.sd[emission.kmers[k]] if k in emission.kmers else 1.0 for k in kmers]
        want.append(plain(level, sd, events, left=left, right=right))
    z, have = run(rows, emission, expectations=True)
    for i, (total, pairs) in enumerate(want):
        assert z.total[i] == pytest.approx(total, abs=1e-8)
        assert {(x, y): p for (x, y, _), p in have[i].items()} == pytest.approx({k: p for k, p in pairs.items() if p >= 1e-4}, abs=2e-7)
        if math.isfinite(total):  # every event is matched or extra, every k-mer matched or skipped
            into = z.expected[i].sum(axis=0)
            assert into[hmm.MATCH] + into[hmm.EXTRA] == pytest.approx(len(rows[i].events)) and into[hmm.MATCH] + into[hmm.SKIP] == pytest.approx(len(rows[i].kmers))


def test_unknown_kmer_keeps_its_place():
    rng = np.random.default_rng(2)
    emission = hmm.Gaussian({k: i for i, k in enumerate(NAMES)}, np.linspace(40, 185, 30), np.ones(30))
    kmers = [NAMES[i] for i in (1, 9, 17, 25, 5, 13)]
    events = [emission.level[emission.kmers[k]] + rng.normal(0, 0.2) for k in kmers]
    kmers[3] = "unknown"
    _, (pairs,) = run([block(kmers, events[:3] + events[4:])], emission, threshold=0.5)
    assert sorted(pairs) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (4, 3, 0), (5, 4, 0)]


def test_windows_change_nothing_and_bound_what_is_held():
    rng = np.random.default_rng(3)
    emission = some_emission(rng)
    held = []
    for nx in (200, 800):
        kmers, events, anchors = some_read(rng, emission, nx)
        rows = [block(kmers, events, anchors), block(kmers[: nx // 3], events[: nx // 3])]
        (whole, a), (parts, b) = run(rows, emission, 20, 10**9, 0.01, True), run(rows, emission, 20, 60, 0.01, True)
        assert a == b and (whole.total == parts.total).all() and whole.expected == pytest.approx(parts.expected)
        assert whole.most_held == len(kmers) + len(events) + 1
        held.append(parts.most_held)
    assert held[1] - held[0] <= 2 * (600 * 2 + 200) // 60 + 2 and held[1] < 62 + 2 * 1700 // 60  # two diagonals more for each window more


def test_band():
    low, high = hmm.band(40, 44, [(10, 11), (20, 25)], 8)
    centre = np.interp(np.arange(85), [0, 21, 45, 84], [0, 10, 20, 40])
    assert (low <= high).all() and low[0] == high[0] == 0 and low[-1] == high[-1] == 40
    inner = slice(8, 77)
    assert (low[inner] == np.ceil(centre[inner] - 4 - 1e-9)).all() and (high[inner] == np.floor(centre[inner] + 4 + 1e-9)).all()
    assert all((a == b).all() for a, b in zip(hmm.band(5, 3, [], None), ([0, 0, 0, 0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5, 5, 5, 5])))


def test_paths_equal_the_sum_over_concrete_sequences():
    """With ambiguous places the likelihood is the sum over all sequences, and a path's posterior its sequences' share."""
    rng = np.random.default_rng(4)
    kmers = [a + b for a in "ACE" for b in "ACE"]
    emission = hmm.Gaussian({k: i for i, k in enumerate(kmers)}, rng.uniform(40, 60, 9), np.full(9, 3.0))
    text = "AXCXA"  # X: C or E
    options = [[p + q for p in ("CE" if a == "X" else a) for q in ("CE" if b == "X" else b)] for a, b in zip(text, text[1:])]
    events = rng.uniform(40, 60, 5).tolist()
    z, (have,) = run([block(options, events)], emission, threshold=1e-4)
    total, share = -math.inf, {}
    for letters in itertools.product(*["CE" if c == "X" else c for c in text]):
        word = "".join(letters)
        own = [word[i : i + 2] for i in range(4)]
        one, pairs = plain([emission.level[emission.kmers[k]] for k in own], [3.0] * 4, events)
        total = np.logaddexp(total, one)
        for (x, y), p in pairs.items():
            share[x, y, own[x]] = share.get((x, y, own[x]), 0.0) + math.exp(one) * p
    assert z.total[0] == pytest.approx(total, abs=1e-9)
    assert {(x, y, options[x][path]): p for (x, y, path), p in have.items()} == pytest.approx({k: v / math.exp(total) for k, v in share.items() if v / math.exp(total) >= 1e-4}, abs=2e-7)
    assert len({path for _, _, path in have}) == 2


def test_tabulated_normals_agree_with_the_gaussian_machine(spark):
    rng = np.random.default_rng(5)
    gauss = hmm.Gaussian({k: i for i, k in enumerate(NAMES)}, rng.uniform(50, 80, 30), rng.uniform(2, 3, 30))
    grid = np.linspace(20, 110, 901)
    table = [(k, j, float(x), float(math.exp(hmm.gaussian(x, gauss.level[i], gauss.sd[i])))) for k, i in gauss.kmers.items() for j, x in enumerate(grid)]
    knots = splines.with_slopes(spark.createDataFrame(table, "node string, grid_ix int, x double, pdf double"))
    density = hmm.tabulated_emission(knots)
    kmers, events, anchors = some_read(rng, gauss, 60)
    gauss.extra = gauss.match  # as tabulated densities have it
    a, b = (run([block(kmers, events, anchors)], e, 20)[1][0] for e in (gauss, density))
    assert {k: p for k, p in b.items() if p > 1e-3} == pytest.approx({k: a.get(k, 0) for k, p in b.items() if p > 1e-3}, abs=1e-4)
    far = hmm.Tabulated({"a": 0}, 0.0, 1.0, np.ones((1, 5)), np.zeros((1, 5)), scale=2.0, shift=10.0)
    assert far.match(np.array([0]), np.array([13.0])) == pytest.approx(math.log(0.5))
    with pytest.raises(ValueError, match="every point"):
        hmm.tabulated_emission(knots.where("node <> 'k3' or grid_ix <> 4"))


KMERS, EVENTS, PAIRS = "read_id long, x long, options array<string>", "read_id long, y long, mean double", "read_id long, x long, y long"


def tables(spark, reads):
    """reads: id, k-mers, events, anchors."""
    return (
        spark.createDataFrame([(i, x, k) for i, ks, _, _ in reads for x, k in enumerate(k if isinstance(k, list) else [k] for k in ks)] or [], KMERS),
        spark.createDataFrame([(i, y, e) for i, _, es, _ in reads for y, e in enumerate(es)], EVENTS),
        spark.createDataFrame([(i, a["x"], a["y"]) for i, _, _, marks in reads for a in marks], PAIRS),
    )


def spans_by_hand(nx, ny, anchors, limit, left, right):
    """The published rule of cutting, anchor by anchor."""
    out, begin, before, side = [], (0, 0), (0, 0), math.isqrt(limit)
    cut = False
    for i, (x, y) in enumerate([*anchors, (nx, ny)]):
        gx, gy = x - before[0], y - before[1]
        cut = gx * gy > limit
        if cut:
            hx, hy = min(gx // 2, side), min(gy // 2, side)
            if not (left and i == 0):
                out.append((*begin, before[0] + hx, before[1] + hy))
            begin = (x - hx, y - hy)
        before = (x + 1, y + 1)
    if not cut or not right:
        out.append((*begin, nx, ny))
    return out


@pytest.mark.parametrize(("left", "right"), [(False, False), (True, False), (False, True), (True, True)])
def test_spans(spark, left, right):
    rng = np.random.default_rng(6)
    cases = [(1, 50, 60, []), (2, 50, 60, [(0, 0), (49, 59)]), (3, 5, 5, [(2, 2)]), (4, 90, 80, [(40, 30), (45, 36)]), (5, 200, 100, [(10, 10)])]
    cases += [(i, 120, 120, sorted({(int(v), int(v)) for v in rng.integers(0, 120, 4)})) for i in range(6, 16)]
    lengths = spark.createDataFrame([c[:3] for c in cases], "read_id long, nx long, ny long")
    marks = spark.createDataFrame([(i, *a) for i, _, _, s in cases for a in s] + [(1, 70, 3)], PAIRS)
    have = {}
    for r in blocks.spans(lengths, marks, 400, left, right).orderBy("read_id", "block").collect():
        have.setdefault(r.read_id, []).append(r)
    for i, nx, ny, anchors in cases:
        want = spans_by_hand(nx, ny, anchors, 400, left, right)
        own = have.get(i, [])
        assert [(r.x0, r.y0, r.x1, r.y1) for r in own] == want and [r.block for r in own] == list(range(len(want)))
        assert [r.ragged_left for r in own] == [left or k > 0 for k in range(len(own))]
        assert [r.ragged_right for r in own] == [right or k < len(own) - 1 for k in range(len(own))]


def test_blocks_of_a_read_equal_the_read(spark):
    """Apart from the gaps that are cut, pairs in blocks are those of the read as a whole, in its own places."""
    rng = np.random.default_rng(7)
    emission = hmm.Gaussian({k: i for i, k in enumerate(NAMES)}, np.linspace(40, 185, 30), np.ones(30))
    reads = []
    for i in range(3):
        kmers = [NAMES[k] for k in rng.permutation(np.resize(rng.permutation(30), 240))]
        events = [float(emission.level[emission.kmers[k]] + rng.normal(0, 0.3)) for k in kmers]
        reads.append((i, kmers, events, [{"x": x, "y": x} for x in (*range(5, 100, 8), *range(150, 240, 8))]))
    reads.append((9, ["k1"] * 3, [], []))
    whole = blocks.read_blocks(*tables(spark, reads))
    cut = blocks.read_blocks(*tables(spark, reads), limit=400)
    assert whole.count() == 3 and cut.count() == 6 and {len(r.events) for r in cut.collect()} < {*range(90, 130)}
    pairs = [{(r.read_id, r.x, r.y, r.kmer): r.p for r in hmm.posteriors(b, emission, width=20).collect()} for b in (whole, cut)]
    near = lambda ps: {k: p for k, p in ps.items() if k[1] < 100 or k[1] > 145}
    assert near(pairs[1]) == pytest.approx(near(pairs[0]), abs=1e-6) and len(near(pairs[0])) > 500
    assert hmm.posteriors(cut.limit(0), emission).collect() == []


def test_block_rows_keep_null_places(spark):
    kmers = spark.createDataFrame([(1, 0, ["a"]), (1, 1, None), (1, 2, ["c"])], KMERS)
    events = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0)], EVENTS)
    row = blocks.read_blocks(kmers, events, spark.createDataFrame([], PAIRS)).first()
    assert row.kmers == [["a"], [None], ["c"]] and row.events == [1.0, None, 3.0] and row.anchors is None and (row.x0, row.block) == (0, 0)
    emission = hmm.Gaussian({"a": 0, "c": 1}, np.array([1.0, 3.0]), np.array([0.1, 0.1]))
    found = {(r.x, r.y) for r in hmm.posteriors(blocks.read_blocks(kmers, events, spark.createDataFrame([], PAIRS)), emission, threshold=0.3).collect()}
    assert {(0, 0), (2, 2)} <= found and not any(x == 1 for x, _ in found)


def test_training_improves(spark):
    rng = np.random.default_rng(6)
    level = dict(zip("abcdef", (45.0, 55.0, 62.0, 70.0, 78.0, 88.0)))
    reads = []
    for i in range(12):
        seq = [str(x) for x in rng.choice(list(level), 30)]
        reads.append((i, seq, [float(level[k] + rng.normal(0, 1.5)) for k in seq for _ in range(1 + (rng.random() < 0.2)) if rng.random() > 0.1], []))
    model = spark.createDataFrame([(k, v + 1.5, 3.0) for k, v in level.items()] + [("unseen", 5.0, 2.0)], "kmer string, level_mean double, level_sd double")
    trans, model, history = hmm.baum_welch(blocks.read_blocks(*tables(spark, reads)), model, 4)
    assert all(b > a for a, b in zip(history, history[1:]))
    assert trans.sum(axis=1) == pytest.approx(np.ones(3)) and trans[1, 2] == 0
    assert {r.kmer: r.level_mean for r in model.collect()} == pytest.approx(level | {"unseen": 5.0}, abs=1.0)
