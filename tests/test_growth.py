"""What keeps tasks bounded as tables grow: blocks on scaled probabilities, partitions by the number of events, sums in order."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tracewell.operators import anchors, blocks, correction, hmm
from tracewell.plans import mixtures, posteriors, projection, results

LETTERS = "ACEGT"
TYPE = pa.schema([("read_id", pa.int64()), ("block", pa.int64()), ("x0", pa.int64()), ("y0", pa.int64()), ("kmers", pa.list_(pa.list_(pa.string()))), ("events", pa.list_(pa.float64())), ("anchors", pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))), ("ragged_left", pa.bool_()), ("ragged_right", pa.bool_())])


def some_blocks(rng, emission, n, ambiguous):
    for i in range(n):
        text = rng.choice(list(LETTERS), int(rng.integers(3, 30)))
        kmers = [["".join(text[j : j + 2])] for j in range(len(text) - 1)]
        if ambiguous:
            kmers = [[a + b for a in ("CE" if k[0] in "CE" else k[0]) for b in ("CE" if k[1] in "CE" else k[1])] for (k,) in kmers]
        if i % 5 == 3:
            kmers[len(kmers) // 2] = [None]
        events = [float(emission.level[emission.kmers[k[0] or "AA"]] + rng.normal(0, 5)) for k in kmers for _ in range(int(rng.integers(0, 3)))] or [40.0]
        if i % 4 == 1:
            events[len(events) // 2] = None
        if i % 6 == 2:
            events[0] = 9000.0  # its density is no double under any k-mer
        anchors = [{"x": j, "y": j} for j in range(0, min(len(kmers), len(events)), 6)]
        yield {"read_id": i, "block": 0, "x0": 0, "y0": 0, "kmers": kmers, "events": events, "anchors": anchors if i % 3 else None, "ragged_left": bool(i & 1), "ragged_right": bool(i & 2)}


@pytest.mark.parametrize("ambiguous", [False, True])
@pytest.mark.parametrize("width", [8, None])
def test_scaled_blocks_equal_logs(ambiguous, width):
    """Pairs, likelihoods and expectations; blocks whose densities vanish are done on logs, the others are not."""
    rng = np.random.default_rng(7)
    names = [a + b for a in LETTERS for b in LETTERS]
    emission = hmm.Gaussian({k: i for i, k in enumerate(names)}, rng.uniform(30, 70, 25), rng.uniform(2, 9, 25))
    batch = pa.RecordBatch.from_pylist(list(some_blocks(rng, emission, 40, ambiguous)), schema=TYPE)
    out = []
    for every in (hmm.MARK_EVERY, 2):  # blocks of more than two diagonals are long
        pairs, totals, moves = {}, {}, {}
        for data, rows, total, expected, (i, x, y, code, p) in hmm.aligned(batch, emission, 0.01, width, hmm.TRANSITIONS, every, True):
            totals |= dict(zip(rows.tolist(), total.tolist()))
            moves |= dict(zip(rows.tolist(), expected))
            pairs |= {(a, b, c, data.names[d]): q for a, b, c, d, q in zip(i.tolist(), x.tolist(), y.tolist(), code.tolist(), p.tolist())}
        out.append((pairs, totals, moves))
    (pairs, totals, moves), (want, logs, counts) = out
    assert len(want) > 300 and pairs == pytest.approx(want, abs=2e-7) and totals == pytest.approx(logs, abs=1e-8)
    assert all(moves[i] == pytest.approx(counts[i], abs=1e-7) for i in totals if math.isfinite(totals[i]))
    data = hmm.Blocks(batch, emission)
    fast = np.zeros(40, bool)
    for rows, short in data.groups(width, hmm.MARK_EVERY):
        z = hmm.Scaled(data, rows, emission, hmm.TRANSITIONS, width)
        z.run(0.5)
        fast[rows] = z.exact & short
    far = np.arange(40) % 6 == 2
    assert not fast[far].any() and fast[~far].sum() > 20


def events_of(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


def made(n_reads, n_events, seed=3):
    import datetime

    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    for i in range(n_reads * n_events):
        yield i, start + datetime.timedelta(seconds=i), i % n_reads, rng.choice(list(projection.BASES)), round(rng.uniform(1, 90), 2), f'{{"k": {rng.randrange(6)}}}'


def test_partitions_follow_the_events(spark, tmp_path, monkeypatch):
    """A partition keeps its size as the table grows, and the blocks stay what they were."""
    folder = events_of(spark, tmp_path, list(made(20, 50)))
    rows = lambda: sorted(posteriors.block_spans(spark, folder).collect())
    before = rows()
    monkeypatch.setattr(projection, "ROWS", 50)
    s = projection.series(spark, folder)
    assert s.rdd.getNumPartitions() == 20 and projection.by_read(spark, s.limit(100)).rdd.getNumPartitions() <= 4
    assert rows() == before and len(before) >= 20


def test_posteriors_are_summed_in_order(spark, tmp_path):
    """The sum behind a posterior follows the read's order, at a tie of the threshold too, however the rows lie in files."""
    import datetime

    values = [5.94, 3.54, 2.4, 33.71, 81.37, 47.66]
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i), 1, "view", v, f'{{"k": {i // 3}}}') for i, v in enumerate(values)]
    added = lambda a, b, c: (a + b) + c
    want = [v / added(*values[i // 3 * 3 : i // 3 * 3 + 3]) for i, v in enumerate(values)]
    plan = projection.series(spark, events_of(spark, tmp_path / "plan", rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(read_id" in plan.split("sum(")[1] and "event_index" in plan.split("sum(")[1].split("specifiedwindowframe")[0]
    for i in range(3):
        random.Random(i).shuffle(rows)
        s = projection.series(spark, events_of(spark, tmp_path / str(i), rows))
        assert [r.posterior for r in s.orderBy("event_index").collect()] == want


def test_copies_of_reads_are_members_and_lose_no_anchor(spark, tmp_path):
    """Anchors of the least ids, given to all copies, are those between all reads; rows follow the reads, not their pairs."""
    rows = list(made(8, 40, seed=5))
    first = {(r[2], r[0] // 8): r[3] for r in rows}
    rows = [(*r[:3], first[r[2] % 4, r[0] // 8] if r[2] % 4 != 1 else first[0, r[0] // 8], *r[4:]) for r in rows]  # 4 to 7 copy 0 to 3; 1 and 5 copy 0 on the other side
    folder = events_of(spark, tmp_path, rows)
    found = results.recursive_anchors(spark, folder).collect()
    s = projection.sequences(projection.series(spark, folder)).selectExpr("read_id as id", "sequence")
    want = {tuple(r) for r in anchors.recursive_seeds(s.where("id % 2 = 0"), s.where("id % 2 = 1"), [8, 6, 4], 100).collect()}
    copies = {r.id_b: r.id_a for r in found if r.role == "copy"}
    assert copies == {4: 0, 6: 2, 5: 1, 7: 3}
    of = lambda i: [i, *(c for c, a in copies.items() if a == i)]
    anchored = [tuple(r)[:4] for r in found if r.role == "anchor"]
    assert {(a, b, x, y) for i, j, x, y in anchored for a in of(i) for b in of(j)} == want
    assert len(anchored) * 4 == len(want) > 0


def test_blocks_of_a_correction_are_made_once_for_all_registers(spark):
    """One row a block whatever the step; its letters are opened in place."""
    reference = spark.createDataFrame([(1, i, b) for i, b in enumerate("ACGTACG")], "contig long, pos long, base string")
    reads = spark.createDataFrame([(4, 1, 1, 7)], "read_id long, contig long, start long, end long")
    events = spark.createDataFrame([(4, y, 50.0) for y in range(4)], "read_id long, y long, mean double")
    marks = spark.createDataFrame([(4, 0, 0)], "read_id long, x long, y long")
    (row,) = correction.aligned_blocks(reference, reads, events, marks, 3).collect()
    assert row.kmers == [list("CGT"), list("GTA"), list("TAC"), list("ACG")] and row.start == 1
    from pyspark.sql import functions as F

    one = spark.sql("select array('A', null, 'C') as b")
    got = one.select(*[correction.opened(F.col("b"), F.lit(7), F.lit(r), 4, 3, "AC").alias(f"r{r}") for r in range(4)]).first()
    assert list(got) == [["AAC", "ACC"], ["AA", "AC"], ["AC"], ["AC", "CC"]]


def test_density_posteriors_take_lengths_from_one_pass(spark, tmp_path, monkeypatch):
    """The blocks are those of the k-mers and events, but their lengths are not joined from both."""
    folder = events_of(spark, tmp_path, list(made(8, 40)))
    s = projection.series(spark, folder)
    want = sorted(posteriors.shown(hmm.posteriors(blocks.read_blocks(*posteriors.parts(s)), hmm.tabulated_emission(mixtures.normal_knots(projection.kmer_model(s), 0.0, 1000.0, 501)), width=20)).collect())
    monkeypatch.setattr(blocks, "lengths_of", None)
    assert sorted(mixtures.density_posteriors(spark, folder).collect()) == want and len(want) > 100


@pytest.mark.parametrize("name", ["aligned_assignments", "aligned_marginals", "forward_backward_posteriors", "read_likelihoods"])
def test_alignments_share_the_bounded_step(spark, tmp_path, monkeypatch, name):
    """Lengths from one pass and partitions by the number of events, with the rows that the joined lengths give."""
    folder, module = events_of(spark, tmp_path, list(made(8, 40))), results if name.startswith("aligned") else posteriors
    s, once = projection.series(spark, folder), posteriors.lengths
    with monkeypatch.context() as m:
        m.setattr(posteriors, "lengths", lambda s: blocks.lengths_of(*posteriors.parts(s)[:2]))
        want = sorted(getattr(module, name)(spark, folder).collect())
    assert sorted(once(s).collect()) == sorted(blocks.lengths_of(*posteriors.parts(s)[:2]).collect())
    monkeypatch.setattr(projection, "ROWS", 40)
    monkeypatch.setattr(blocks, "lengths_of", None)
    assert projection.series(spark, folder).rdd.getNumPartitions() == 8
    assert sorted(getattr(module, name)(spark, folder).collect()) == want and len(want) >= 8


def test_ties_are_rounded_as_the_sql_rounds_them(spark):
    """Seventh digits of 5, which the scaled double may hold from below; Spark's own rounding differs in some."""
    import duckdb
    from pyspark.sql import functions as F

    from tracewell.plans import alignments

    ties = [(2 * k + 1) / d for d in (128, 640, 3200, 16000, 2_000_000) for k in range(60)] + [0.0653125, 0.0648125, -0.0653125, 0.0, 1e12 + 0.5]
    want = [x for (x,) in duckdb.connect().execute("select round(x, 6) from (select unnest(?::double[]) as x)", [ties]).fetchall()]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(ties)], "i long, x double").select("i", alignments.r("x").alias("y"), F.round("x", 6).alias("own"), alignments.r(F.lit(None).cast("double")).alias("none")).orderBy("i").collect()
    assert [x.y for x in got] == want and [x.own for x in got] != want and all(x.none is None for x in got)
