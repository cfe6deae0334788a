"""Ranked search and Lloyd rounds against brute force, the byte network by its gradients and held-out accuracy; odd cases of each."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import language_id, lloyd, queries, ranked_search

from test_llm import LOW

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- 11


def terms_of(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def search_by_hand(docs, items, k):
    """(item_id, rank, score) with the ids of each score's documents as a sorted list, since equal rows have no order."""
    tf = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in {(i, (t or "").translate(LOW)) for i, t in items}:
        found = []
        for doc, c in tf:
            n = sum(c.values())
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * (100 - 75 + (75 * n * n_docs) // n_words))) for t in terms_of(text) if t in c)
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "block_bytes"), [(10, 1 << 20), (3, 60), (1, 1 << 20)])
def test_search(spark, docs, rows, k, block_bytes):
    long = [t for _, t, *_ in rows if t and 90 < len(t.split()) < 200]
    items = [(1, long[0][:300]), (2, " ".join(long[1].split()[5:30]).upper()), (3, "one"), (4, None), (5, ""), (6, "zzzz not-there"), (7, "now now now three"), (7, "two words"), (7, "two words"), (None, long[2][:90]), (9, " ".join(long[0].split()[:5] * 4))]
    found = ranked_search.ranked_search(docs.select("*", docs.doc_id.alias("score"), docs.doc_id.alias("item")), spark.createDataFrame(items, "item_id long, text string"), k=k, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    have = sorted(map(tuple, found.collect()), key=repr)
    assert have == search_by_hand([(i, t) for i, t, *_ in rows], items, k)
    assert {r[0] for r in have} == {1, 2, 3, 7, None, 9}


def test_search_bounds_prune_and_ties_hold(spark):
    """Frequent terms seed nothing once a rare one has k documents; equal scores go by id over many partitions."""
    r = random.Random(3)
    texts = [(i, " ".join(["the"] * r.randint(1, 9) + ["rare"] * (i % 40 == 0) + [f"w{r.randint(0, 50)}" for _ in range(8)])) for i in range(600)]
    texts += [(1000 + i, "rare same text") for i in range(40)]
    items = [(1, "the rare the"), (2, "the"), (3, "rare same w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    have = sorted(map(tuple, ranked_search.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert have == search_by_hand(texts, items, 10)
    block = ranked_search.block_of([["the", "rare", "the"]])
    order = np.argsort([bytes(block.body[a:b]) for a, b in zip(block.start[:-1], block.start[1:])])
    most, kth = np.zeros(2, np.int64), np.zeros(2, np.int64)
    most[order], kth[order] = [900, 5], [800, 4]  # of "rare", "the"
    plan = ranked_search.plan_of(block, ranked_search.Weights(most, 1, 1), most, kth)
    assert plan.threshold.tolist() == [800] and plan.rest.tolist() == [10] and len(plan.seed_item) == 1
    kth[order] = [10, 0]  # the threshold is reached by what is left: it seeds too
    assert len(ranked_search.plan_of(block, ranked_search.Weights(most, 1, 1), most, kth).seed_item) == 2


def test_search_empty_and_long(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.ranked_search(empty, items).collect() == []
    docs = spark.createDataFrame([(1, "a " * 700_000 + "c"), (2, "b"), (3, "x" * 3_000_000), (4, "c d")], "doc_id long, text string")
    assert ranked_search.ranked_search(docs, items.limit(0)).collect() == []
    have = sorted(map(tuple, ranked_search.ranked_search(docs, items).collect()), key=repr)
    assert have == search_by_hand([tuple(r) for r in docs.collect()], [(1, "a b")], 10)


# --- 12


def lloyd_by_hand(rows, k, size, rounds, seed):
    limit = 1 << 27
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(max(min(1024 * x, limit), -limit)) for x in v]))
    hashed = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in hashed[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        by = {}
        for _, v in kept:
            by.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(by[n]) for x in zip(*by[n])] if n in by else c for n, c in enumerate(centres)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, n, d in last:
        each[n] += d
    whole = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, d, whole(each[n]), whole(sum(each.values())), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, n, d in last), key=repr)


def vectors(n, size, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice([-1, 1]) * (i % 3) * 0.25 + r.uniform(-0.1, 0.1) for _ in range(size)]) for i in range(n)]


ODD = [(900, None), (901, []), (902, [0.0] * 3), (903, [0.1, None, 0.2, 0.3]), (904, [0.1, float("nan"), 0.2, 0.3]), (905, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.5, -0.5, 0.25, 0.0]), (906, [0.0, -0.0, 1e-9, -1e-9]), (5, [0.3, 0.3, -0.3, -0.3])]


@pytest.mark.parametrize("k", [1, 5, 8])
def test_lloyd(spark, k):
    rows = vectors(150, 4) + ODD + [(7, vectors(8, 4)[7][1])] * 3
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(5)
    found = lloyd.cluster(df, k, 4, rounds=6, seed=3)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == lloyd_by_hand(rows, k, 4, 6, 3)


def test_lloyd_large_values_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(i, [1e300 * (-1) ** i, -3.4e38, 131071.9, -131072.5]) for i in range(9)] + [(20, [0.0] * 4)]
    assert sorted(map(tuple, lloyd.cluster(spark.createDataFrame(rows, schema), 2, 4).collect()), key=repr) == lloyd_by_hand(rows, 2, 4, 10, 3)
    few = [(1, [0.5] * 4), (2, [0.25] * 4)]
    assert sorted(map(tuple, lloyd.cluster(spark.createDataFrame(few, schema), 8, 4).collect()), key=repr) == lloyd_by_hand(few, 8, 4, 10, 3)
    same = [(i, [0.5] * 4) for i in range(12)]  # equal centroids: the first takes all
    assert {r.cluster for r in lloyd.cluster(spark.createDataFrame(same, schema), 8, 4).collect()} == {0}
    assert lloyd.cluster(spark.createDataFrame([], schema), 8, 4).collect() == []
    with pytest.raises(ValueError, match="between 1 and"):
        lloyd.cluster(spark.createDataFrame(few, schema), 0, 4)


def test_lloyd_floats_and_registered(spark, tmp_path):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors(60, 64)]
    spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op12_lloyd(spark, str(tmp_path)).collect()), key=repr) == lloyd_by_hand(rows, 8, 64, 10, 3)


# --- 13

SYLLABLES = {"xx": "an er und sch ei ig lich", "yy": "ión que los ar ez ñ", "zz": "eau oi è ment ai re"}


def spoken(r, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))).capitalize() if r.random() < 0.1 else "".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def speech(spark):
    r = random.Random(5)
    rows = [(i, spoken(r, lang, r.randint(5, 80)), lang) for i in range(240) for lang in [["xx", "xx", "yy", "zz"][i % 4]]]
    rows += [(300, None, "xx"), (301, "", "yy"), (302, " 12 \t", "zz"), (303, "!!! 😀 3", "xx"), (304, spoken(r, "xx", 20), None), (305, spoken(r, "xx", 20), ""), (None, spoken(r, "yy", 20), "yy"), (7, spoken(r, "zz", 20), "zz"), (7, spoken(r, "zz", 20), "zz")]
    return rows


def test_language_held_out(spark, speech, tmp_path):
    spark.createDataFrame([(*x, "s", 1) for x in speech], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    have = queries.op13_language_id(spark, str(tmp_path)).collect()
    truth = {i: lang for i, _, lang in speech}
    assert len(have) == len(speech) and {r.lang_pred for r in have} == {"xx", "yy", "zz", "und"}
    assert all(0 <= r.score <= 1 for r in have)
    und = {r.doc_id for r in have if r.lang_pred == "und"}
    assert und == {300, 301, 302, 303} and all(r.score == 0 for r in have if r.doc_id in und)
    held = [r for r in have if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert next(r.lang_pred for r in have if r.doc_id == 304) == "xx"


def test_language_whole_text_and_odd_tables(spark, speech, empty):
    r = random.Random(6)
    table = spark.createDataFrame(speech, "doc_id long, text string, lang string")
    net = language_id.train(table, sample_docs=90, epochs=15)
    assert net.langs == ["xx", "yy", "zz"]
    again = language_id.train(table.repartition(4), sample_docs=90, epochs=15)
    assert all((a == b).all() for a, b in zip(net.parameters(), again.parameters()))  # neither order nor partitions matter
    late = [(1, "12 " * 200_000 + spoken(r, "yy", 40)), (2, spoken(r, "xx", 30) + " " + spoken(r, "zz", 4000)), (3, "ñ" * 1_000_000)]
    odd = spark.createDataFrame([(i, t, "kept", i) for i, t in late], "doc_id long, text string, score string, k0 long")
    have = {x.doc_id: x for x in language_id.predict(odd.withColumnRenamed("score", "none"), net, keep=["doc_id", "none", "k0"]).collect()}
    assert have[1].lang_pred == "yy" and have[2].lang_pred == "zz" and have[1].none == "kept" and have[3].k0 == 3
    assert language_id.predict(empty, net, keep=["doc_id"]).collect() == []
    assert language_id.train(empty) is None and language_id.train(table.where("text is null")) is None
    assert {x.lang_pred for x in language_id.predict(odd, None, keep=["doc_id"]).collect()} == {"und"}
    one = language_id.train(table.where("lang = 'xx'"), sample_docs=5)
    assert {x.lang_pred for x in language_id.predict(odd, one).collect()} == {"xx"}


def test_language_windows_see_every_run_of_bytes():
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcxyz") for _ in range(n)) for n in (0, 1, 3, 124, 125, 126, 127, 128, 129, 250, 253, 254, 900)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    seen = [set() for _ in texts]
    for text, rows in language_id.windows(buf, off):
        assert rows.shape[1] == language_id.WINDOW
        for t, row in zip(text, rows):
            seen[t] |= {bytes(row[i : i + 4]) for i in range(language_id.WINDOW - 3)}
    for t, s in zip(texts, seen):
        assert {t[i : i + 4] for i in range(len(t) - 3)} <= s
        assert {x for x in s if b" " not in x} <= {t[i : i + 4] for i in range(len(t) - 3)}


def test_language_gradients():
    r = np.random.default_rng(1)
    net = language_id.Network.new(["a", "b", "c"], r)
    net = language_id.Network(net.langs, *[x.astype(float) for x in net.parameters()])
    symbols, lang = r.integers(97, 105, (5, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(symbols)[np.arange(5), lang]).mean()
    for x, g in zip(net.parameters(), net.gradients(symbols, lang), strict=True):
        for at in zip(*[r.integers(0, n, 12) for n in x.shape]):
            if x is net.filters and not net.shape[at]:
                assert g[at] == 0
                continue
            if x is net.embedding:
                at = (97 + at[0] % 8, at[1])
            was, eps = x[at], 1e-6
            x[at] = was + eps
            up = loss()
            x[at] = was - eps
            down = loss()
            x[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=2e-5)
