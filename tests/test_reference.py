"""The engine's own operators on micro-fixtures, and every registered query against its SQL."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.functions import emissions as em
from tracewell.functions import sequences as sq
from tracewell.operators import anchors, calls, hdp, metrics, scaling, windows
from tracewell.plans import catalog, registry  # noqa: F401
from tracewell.sources import formats

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def as_rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, map(tuple, frame.astype(object).where(frame.notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    have, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert as_rows(have) == as_rows(want)


@pytest.mark.parametrize("kmer,alphabet,rank", [("AAAC", "ACGT", 1), ("AAAT", "ACGT", 3), ("AAAT", "ACT", 2), ("AACAA", "ACGT", 16)])
def test_kmer_rank(spark, kmer, alphabet, rank):
    assert value(spark, sq.kmer_rank(F.lit(kmer), alphabet, len(kmer))) == rank
    assert value(spark, sq.rank_kmer(F.lit(rank), alphabet, len(kmer))) == kmer
    assert value(spark, sq.kmer_rank(F.lit("AXA"), alphabet, 3)) is None


def test_ambiguity(spark):
    paths = value(spark, sq.expand_ambiguous(F.lit("ATGXAX"), 6, "CEO"))
    assert len(paths) == 9 and paths[0] == "ATGCAC" and paths[-1] == "ATGOAO"
    assert len(value(spark, sq.expand_ambiguous(F.lit("XXXXXX"), 6, "CEO"))) == 729
    assert value(spark, sq.ambiguous_positions(F.lit("ATGXAX"), 6)) == [3, 5]
    assert value(spark, sq.legal_transition(F.lit("AAETTT"), F.lit("AETTTC"), 6))
    assert not value(spark, sq.legal_transition(F.lit("AAETTT"), F.lit("ACTTTC"), 6))
    assert value(spark, sq.legal_transition(F.lit(None).cast("string"), F.lit("ACTTTC"), 6))


def test_short_sequences(spark):
    assert value(spark, sq.kmers(F.lit("AC"), 3)) == [] and value(spark, sq.kmers(F.lit("ACG"), 3)) == ["ACG"]
    assert value(spark, sq.motif_positions(F.lit("CGCGC"), "CGC")) == [0, 2]
    assert value(spark, sq.strided_mask(F.lit("ACGTA"), 2, F.lit(1))) == "AXGXA"
    ops = sq.cigar_ops(F.lit("5S10M2I3D4M"))
    assert value(spark, sq.cigar_span(ops, "MD")) == 17 and value(spark, sq.cigar_span(ops, "MI")) == 16


def test_densities(spark):
    assert value(spark, em.log_gauss(F.lit(1.0), F.lit(0.0), F.lit(2.0))) == pytest.approx(math.log(math.exp(-1 / 8) / (2 * math.sqrt(2 * math.pi))))
    assert value(spark, em.log_gauss(F.lit(1.0), F.lit(0.0), F.lit(0.0))) == -math.inf
    x, mu, shape = 1.3, 0.9, 2.5
    assert value(spark, em.log_inv_gauss(F.lit(x), F.lit(mu), F.lit(shape))) == pytest.approx(math.log(math.sqrt(shape / (2 * math.pi * x**3)) * math.exp(-shape * (x - mu) ** 2 / (2 * mu * mu * x))))
    assert value(spark, em.log_add(F.lit(-3.0), F.lit(-4.0))) == pytest.approx(np.logaddexp(-3, -4))
    assert value(spark, em.fixed_point(F.lit(1.2))) == 1.0 and value(spark, em.fixed_point(F.lit(0.123456789))) == 0.1234567


def test_monotone_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(x), int(y)) for k in range(20) for x, y in zip(np.sort(rng.integers(0, 60, 14)), np.sort(rng.integers(0, 60, 14)) + rng.integers(-2, 3, 14))]
    want = {p for p in set(rows) if all((q[1] < p[1] and q[2] < p[2]) or (q[1] > p[1] and q[2] > p[2]) for q in set(rows) if q[0] == p[0] and q != p)}
    have = anchors.monotone(spark.createDataFrame(rows, "read_id long, x long, y long")).collect()
    assert {tuple(r) for r in have} == want and len(have) == len(want)


def test_event_map_and_groups(spark):
    ev = [(1, i, m, p) for i, (m, p) in enumerate([(1, 0.5), (0, 0.6), (0, 0.4), (1, 0.1), (0, 0.05), (2, 0.3)])]
    out = windows.event_map_1d(spark.createDataFrame(ev, "read_id long, event_index long, move long, p double")).collect()
    assert {(r.base_pos, r.event_index) for r in out} == {(1, 1), (2, 3), (4, 5)}
    sites = spark.createDataFrame([(1, p, s) for p, s in [(3, 0.1), (5, 0.9), (20, 0.2), (40, 0.5)]], "k long, pos long, score double")
    best = windows.best_of_groups(windows.gap_groups(sites, "pos", 6, ["k"]), "pos", "score", ["k"]).collect()
    assert sorted(r.pos for r in best) == [5, 20, 40]
    files = spark.createDataFrame([(i, 40) for i in range(5)], "f long, n long")
    assert sorted(r.f for r in windows.capped(files, "n", 100, "f").collect()) == [0, 1, 2]


def test_scaling_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    mu, sd, t = rng.uniform(40, 90, 300), rng.uniform(1, 2, 300), np.arange(300) / 100
    rows = [(7, float(m), float(s), float(u), float(3 + 1.1 * m + 0.5 * u)) for m, s, u in zip(mu, sd, t)]
    fit = scaling.scale_shift_drift(spark.createDataFrame(rows, "read_id long, level_mean double, level_sd double, start double, mean double")).first()
    assert (fit.shift, fit.scale, fit.drift) == pytest.approx((3, 1.1, 0.5), rel=1e-4)
    one = spark.createDataFrame([(7, 50.0, 1.0, 0.0, 51.0)], "read_id long, level_mean double, level_sd double, start double, mean double")
    assert scaling.scale_shift(one).first().shift is None


def test_consensus(spark):
    rows = [(0, "t", True, 0.9, 0.1, 0.0, 0.0), (0, "c", True, 0.2, 0.0, 0.0, 0.8), (1, "t", True, 0.5, 0.5, 0.0, 0.0)]
    got = {r.ref_pos: r for r in calls.consensus(spark.createDataFrame(rows, "ref_pos long, strand string, forward boolean, pA double, pC double, pG double, pT double"), "ACGT").collect()}
    assert got[0].call == "A" and got[0].pA == pytest.approx(0.85) and got[0].depth == 2
    assert got[1].call == "A"  # a tie goes to the first base
    ref = spark.createDataFrame([("c", "GGG")], "contig string, sequence string")
    assert calls.apply_calls(ref, spark.createDataFrame([("c", 1, "T")], "contig string, ref_pos int, call string")).first().sequence == "GTG"


def test_distances_are_metrics(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), float(x)) for k in range(3) for x in rng.normal(30 + 5 * k, 4, 400)]
    h = metrics.histogram(spark.createDataFrame(rows, "k string, x double"), "k", "x", 2.0, 40)
    d = {(r.a, r.b): r for r in metrics.distances(metrics.pairs(h, "k")).collect()}
    for m in ("hellinger", "l2", "jensen_shannon"):
        a, b, c = (d[p][m] for p in (("0", "1"), ("1", "2"), ("0", "2")))
        assert 0 < a and 0 < b and c <= a + b
    mean = {r.k: r.expected for r in metrics.moments(h, "k").collect()}
    assert mean["0"] == pytest.approx(30, abs=1)


def test_hierarchical_mixture(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i + 1000 * k, float(x)) for k, (g, m) in enumerate((("a", 40), ("b", 60))) for i, x in enumerate(np.r_[rng.normal(m, 2, 150), rng.normal(80, 2, 50)])]
    found = hdp.sample(spark.createDataFrame(rows, "group string, id long, x double"), components=6, iterations=20, burn_in=10, thin=5)
    d = hdp.densities(spark, *found, 20.0, 100.0, 161).toPandas()
    for g, m in (("a", 40), ("b", 60)):
        own = d[d.group == g].sort_values("x")
        assert np.trapezoid(own.pdf, own.x) == pytest.approx(1, abs=0.05)
        assert np.trapezoid(own.pdf * own.x, own.x) == pytest.approx(0.75 * m + 20, abs=2)


def test_formats(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.fa").write_text(">one first\nACGT\nac\n>two\nGG\n")
    assert {(r.contig, r.sequence, r.complement) for r in formats.fasta(spark, f"{p}/a.fa").collect()} == {("one", "ACGTAC", "TGCATG"), ("two", "GG", "CC")}
    (tmp_path / "s.pos").write_text("X 1 5 9\nX 2\n")
    assert {(r.contig, r.strand, r.pos) for r in formats.positions(spark, f"{p}/s.pos").collect()} == {("X", "forward", 1), ("X", "forward", 5), ("X", "forward", 9), ("X", "backward", 2)}
    (tmp_path / "r.tgt").write_text("9 3 ACG\n4 8 ACG\n")
    assert {(r.start, r.end) for r in formats.regions(spark, f"{p}/r.tgt").collect()} == {(3, 9), (4, 8)}
    kmers = [a + b for a in "AC" for b in "AC"]
    (tmp_path / "m.model").write_text("3\t2\tAC\t2\n" + "\t".join(map(str, [0.1] * 9 + [-5])) + "\n" + "\t".join(str(10 * i + j) for i in range(4) for j in range(5)) + "\n")
    table, moves = formats.model(spark, f"{p}/m.model")
    assert {(r.kmer_id, r.kmer, r.level_mean, r.noise_lambda) for r in table.collect()} == {(i, k, 10.0 * i, 10.0 * i + 4) for i, k in enumerate(kmers)}
    assert moves.count() == 9
    (tmp_path / "bad.model").write_text("3\t2\tAC\t2\n0.1\n1 2 3\n")
    with pytest.raises(Exception, match="do not agree"):
        formats.model(spark, f"{p}/bad.model")[0].collect()
    lines = ["4 2 1 0 0 0 1.1 2 0.9 1 1 0 1 0 1 1 1 0", "ACGT", "ACGT", "0 1 2", "AC", "0 1", "0 0 1", "50 1 0.1 0 60 2 0.2 0.1", "0 0", "55 1 0.1 0", "", "", "", ""]
    (tmp_path / "x.npRead").write_text("\n".join(lines))
    read = formats.signal_reads(spark, f"{p}/x.npRead").first()
    assert len(read.template_events) == 2 and read.template_events[1].mean == 60 and read.template_params.scale == 1.1 and read.complement_map == [0, 0]
    (tmp_path / "a.sam").write_text("@HD\tx\n" + "".join(f"{q}\t{f}\tc\t7\t60\t3M\t*\t0\t0\tACG\t*\n" for q, f in (("a", 4), ("a", 0), ("a", 16), ("b", 256))))
    assert [(r.qname, r.flag, r.pos) for r in formats.sam(spark, f"{p}/a.sam").collect()] == [("a", 0, 7)]
    full = spark.createDataFrame([("c", 10, "AXC", "r", "t", 3, 1.0, 1.0, 0.1, "AXC", 1.0, 1.0, 0.5, 1.0, 1.0, "AEC"), ("c", 11, "AAC", "r", "t", 4, 1.0, 1.0, 0.1, "AAC", 1.0, 1.0, 0.5, 1.0, 1.0, "AAC")], formats.FULL)
    formats.write_table(full, f"{p}/full.backward.tsv", formats.FULL)
    assert formats.read_table(spark, f"{p}/full.backward.tsv", formats.FULL).count() == 2
    assert [tuple(r) for r in formats.variant_rows(full).collect()] == [(3, 11, "E", 0.5, "t", "forward", "r")]
    rows = formats.build_rows(spark.createDataFrame([("ACG", "t", 61.5, 0.9)], formats.ASSIGNMENTS))
    assert rows.columns.index("strand") == 4 and rows.columns.index("kmer") == 9 and rows.columns.index("event_mean") == 13
    formats.write_fasta(spark.createDataFrame([("k", "ACG")], "contig string, sequence string"), f"{p}/out.fa")
    assert formats.fasta(spark, f"{p}/out.fa/*.txt").first().sequence == "ACG"
    (tmp_path / "list").write_text(" a.tsv \n\nb.tsv\n")
    assert formats.file_list(spark, f"{p}/list").count() == 2
