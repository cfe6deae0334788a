"""Expectation files and k-mer dumps: what is written is what is read; damaged files raise."""

import pytest

from tracewell.sources import model_files

N = 4  # k-mers of two letters


def normal(file, shift=0.0):
    rows = [(file, "transition", i, None, i / 9) for i in range(9)] + [(file, "likelihood", 9, None, -123.25 - shift)]
    kmers = ["AA", "AC", "CA", "CC"]
    for item, width in model_files.NORMAL.items():
        rows += [(file, item, i, kmers[i // width], float(i) + shift) for i in range(width * N)]
    return rows


def dense(file):
    return [r for r in normal(file) if r[1] in ("transition", "likelihood", "model")] + [(file, "assignment", i, k, v) for i, (k, v) in enumerate([("AC", 50.5), ("AA", 61.0), ("AC", 49.0)])]


def test_round_trip(spark, tmp_path):
    rows = normal("a b/é+1.txt") + normal("second", 0.5)
    model_files.write_expectations(spark.createDataFrame(rows, model_files.ROWS).repartition(5), f"{tmp_path}/x", "AC", 2)
    assert sorted(map(tuple, model_files.expectations(spark, f"{tmp_path}/x").collect()), key=repr) == sorted(rows, key=repr)
    model_files.write_expectations(spark.createDataFrame(dense("d"), model_files.ROWS), f"{tmp_path}/d", "AC", 2)
    assert sorted(map(tuple, model_files.expectations(spark, f"{tmp_path}/d", densities=True).collect()), key=repr) == sorted(dense("d"), key=repr)


@pytest.mark.parametrize(("line", "change"), [(0, "3\t2\tAC"), (1, "0.1\t0.2"), (2, "1\t2\t3"), (4, "1\t1\t1"), (5, "")])
def test_damaged_files_raise(spark, tmp_path, line, change):
    at = ["\t".join(str(r[4]) for r in normal("f") if r[1] in items) for items in (("transition", "likelihood"), ("model",), ("expectation",), ("posterior",), ("observed",))]
    text = ["3\t2\tAC\t2\t", *at]
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "f").write_text("\n".join(text) + "\n")
    assert sorted(map(tuple, model_files.expectations(spark, f"{tmp_path}/ok").collect()), key=repr) == sorted(normal("f"), key=repr)
    text[line] = change
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "f").write_text("\n".join(text) + "\n")
    with pytest.raises(Exception, match="do not agree"):
        model_files.expectations(spark, f"{tmp_path}/bad").collect()


def test_kmer_values(spark, tmp_path):
    rows = [("AC", 1.5), ("AC", 99.5), ("AC", 100.0), ("GT", 0.0), ("GT", 42.0), (None, 3.0), ("GT", None)]
    model_files.write_kmer_values(spark.createDataFrame(rows, "kmer string, value double"), f"{tmp_path}/k")
    assert sorted(map(tuple, model_files.kmer_values(spark, f"{tmp_path}/k").collect())) == [("AC", 1.5), ("AC", 99.5), ("GT", 42.0)]
    assert sorted(p.name for p in (tmp_path / "k").glob("kmer=*")) == ["kmer=AC", "kmer=GT"]
