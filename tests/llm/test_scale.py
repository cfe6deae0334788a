"""Many shards and blocks, long texts, hot keys, and the registered queries' own columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import hilbert, kernels, kneser_ney, parity_join, queries, quality_lm, token_counts

from test_llm import LOW, WORD, components_by_hand, key, lm_by_hand, repeats_by_hand, rules_by_hand, without_lines


@pytest.fixture(scope="module")
def sf(spark, docs, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    long = [t for _, t, *_ in rows if t and 90 < len(t.split()) < 200]
    items = [(10, " ".join(long[0].split()[10:30])), (9, " ".join(long[1].split()[5:20]).translate({v: k for k, v in LOW.items()})), (3, "two words"), (3, "two words"), (None, "one"), (4, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i, t, *_ in rows if i is not None and t and len(t) > 300], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, items


def test_registered_decontaminate(spark, sf, rows):
    path, items = sf
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(LOW))
    want = []
    for i, t, *_ in rows:
        x, hit, found = split(t), set(), set()
        for item, text in items:
            w = split(text)
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if n and item is not None else 0):
                for j in range(len(x) - n + 1):
                    if x[j : j + n] == w[k : k + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        want.append((i, len(x), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    have = queries.op2_decontaminate(spark, path).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert key(map(tuple, have)) == key(want)
    assert {w[3] for w in want} == {0, 1} and sum(w[5] for w in want) > 2


def test_registered_rules(spark, sf, rows):
    want = [(i, *rules_by_hand(t), lost, not rules_by_hand(t)[5] and lost <= 0.3 * rules_by_hand(t)[0]) for (i, t, *_), (lost, _) in zip(rows, without_lines(rows, 10))]
    have = queries.op3_quality_rules(spark, sf[0]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept").collect()
    assert key(map(tuple, have)) == key(want)


def test_registered_token_counts_and_packing(spark, sf, rows):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for _, x, *_ in rows]
    have = queries.op4_token_counts(spark, sf[0]).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert key(map(tuple, have)) == key((i, len((x or "").encode()), k, k > 1024) for (i, x, *_), k in zip(rows, n))
    total, want = Counter(), Counter()
    for (i, *_), k in zip(rows, n):
        want[i] += k + 1
    for r in queries.op8_best_fit_packing(spark, sf[0]).collect():
        total[r.doc_id] += r.length
    assert total == want


def test_registered_suffix_dedup(spark, sf, rows):
    have = queries.op5_suffix_dedup(spark, sf[0]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert key(map(tuple, have)) == key((i, n, gone, spans, hashlib.sha256(left).hexdigest()) for i, n, gone, spans, left in repeats_by_hand(rows, 50))


def test_registered_kneser_ney(spark, sf, rows):
    number = lambda i: b"" if i is None else str(i).encode()
    split = lambda t: [*WORD.findall((t or "").translate(LOW)), "</s>"]
    held = [zlib.crc32(number(i)) % 7 == 2 for i, *_ in rows]
    train = [split(t) for (_, t, *_), h in zip(rows, held) if not h]
    want = sorted((-1 if r[0] is None else r[0], h, *x) for r, h, x in zip(rows, held, lm_by_hand(train, [split(r[1]) for r in rows])))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in queries.op6_kneser_ney(spark, sf[0]).collect())
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in have], [x[5:] for x in want])


def test_registered_shards(spark, sf, rows):
    have = queries.op7_hilbert_shards(spark, sf[0]).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in have) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    n = Counter(r.shard for r in have)
    assert sorted(n) == list(range(16)) and max(n.values()) - min(n.values()) <= 1
    assert {(r.law, r.grown_shard) for r in have} == {("rows", None)} and Counter((r.shard, r.slot) for r in have) == Counter((s, k) for s in n for k in range(n[s]))


def test_registered_parity_join(spark, sf, rows):
    have = queries.op10_parity_join(spark, sf[0]).select("doc_id", "n_shingles", "component_id").collect()
    assert key(map(tuple, have)) == key(components_by_hand(rows, 85, 4))


def test_registered_quality_keeps_the_trusted(spark, sf, rows):
    have = queries.op1_quality_lm(spark, sf[0]).collect()
    assert len(have) == len(rows)
    by = {}
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf[0]}/labels.parquet").collect()}
    for r in have:  # by hand: each language's quantile over its calibration documents
        if r.doc_id in trusted and zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
            by.setdefault(r.lang or "", []).append(r.perplexity)
    assert any(len(v) >= 5 for v in by.values())
    for r in have:
        own = sorted(by.get(r.lang or "", []))
        if len(own) >= 5:
            assert r.threshold == own[max(0, int(np.ceil(0.99 * len(own))) - 1)] and r.kept == (r.perplexity <= r.threshold)
        else:
            assert r.threshold is None and r.kept


@pytest.fixture
def many_shards(spark):
    """Many more shards than the fixture fills, and blocks of a few hundred bytes."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "131")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_many_shards(spark, docs, rows, many_shards):
    """The same results where a first word's bigrams are spread over several shards."""
    number = lambda i: b"" if i is None else str(i).encode()
    split = lambda t: [*WORD.findall((t or "").translate(LOW)), "</s>"]
    held = kneser_ney.id_remainder(docs["doc_id"], 7) == 2
    model = kneser_ney.train(docs.where(~held))
    assert model.shards == 131
    have = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs, model).collect())
    train = [split(t) for i, t, *_ in rows if zlib.crc32(number(i)) % 7 != 2]
    want = sorted((-1 if r[0] is None else r[0], x[0], x[1], x[3], x[4]) for r, x in zip(rows, lm_by_hand(train, [split(r[1]) for r in rows])))
    assert np.allclose(have, want)


def test_frequent_first_words_are_spread():
    r = np.random.default_rng(1)
    for n in (32, 200, 2000):
        u = np.where(r.random(1_000_000) < 0.02, np.uint64(7 << 60), r.integers(0, 1 << 63, 1_000_000, dtype=np.uint64))
        load = np.bincount(kneser_ney.pair_shard(u, kneser_ney.pair_hash(u, r.integers(0, 1 << 63, len(u), dtype=np.uint64)), n), minlength=n)
        assert load.max() < 3 * load.mean()


def test_frequent_units_are_spread():
    """A unit of every document goes to the block's own shard."""
    pa = pytest.importorskip("pyarrow")
    rows = [(i, f"the x{i} the y{i} of") for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])

    class Context:
        partitionId = staticmethod(lambda: 5)

    old = token_counts.TaskContext
    token_counts.TaskContext = type("T", (), {"get": staticmethod(lambda: Context)})
    try:
        out = next(token_counts._deal(40, iter([batch]))).to_pylist()
    finally:
        token_counts.TaskContext = old
    own = 5 * 7919 % 40
    loads = {r["shard"]: len(kernels.unpacked(r["docs"])) for r in out}
    assert loads[own] >= 1200 and max(v for s, v in loads.items() if s != own) < 100


def test_long_texts(spark):
    """Texts beyond every block size, alone in theirs."""
    r = np.random.default_rng(2)
    vocab = np.array([f"v{i}" for i in range(3000)])
    long = " ".join(r.choice(vocab, 900_000))
    assert len(long) > kernels.CHUNK_BYTES + (2 << 20)
    rows = [(1, long, "en", "a", len(long)), (2, long[1000:], "en", "a", 1), (3, "short text here", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    have = {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, path).collect()}
    assert have == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x, *_ in rows}
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.jaccard_components(docs).collect()}
    w = [x.split() for _, x, *_ in rows]
    assert got == {i: (max(1, len({tuple(y[k : k + 4]) for k in range(len(y) - 3)})), 1 if i < 3 else 3) for i, y in enumerate(w, 1)}
    trusted = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert quality_lm.quality_by_perplexity(docs, trusted).count() == 3


def test_low_percentages_lose_no_pair():
    r = np.random.default_rng(3)
    bands = parity_join.Bands(10)
    for _ in range(40):
        common, own, other = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (30, 2, 250))
        a, b = np.union1d(common, own), np.union1d(common, other)
        keys, text = parity_join.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
        assert set(keys[text == 0]) & set(keys[text == 1])


def test_strings_that_share_a_beginning(spark):
    rows = [(i, "x", f"https://common.example/{i % 64:02d}") for i in range(512)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    found = hilbert.hilbert_shards(docs, ["url"], n_shards=16).collect()
    urls = {i: u for i, _, u in rows}
    span = [sorted({urls[r.doc_id] for r in found if r.shard == s}) for s in range(16)]
    assert max(map(len, span)) <= 12, [len(s) for s in span]  # of 64 values; 32 if the cuts did not tell them apart


def test_counts_beyond_32_bits(tmp_path):
    u = np.zeros(2, np.uint64)
    table = kernels.table_of([(0, u[:1].tobytes(), kernels.packed(np.array([2])), np.array([5, 9], np.uint64).tobytes(), kernels.packed(np.array([1 << 33, 3], np.int64)))], kneser_ney.PAIRS)
    kneser_ney._merge(1, str(tmp_path), table)
    counts = kneser_ney.get(f"{tmp_path}/pair-0.counts", np.uint64)
    assert sorted(counts.tolist()) == [3, 1 << 33]


def test_string_cuts_are_those_of_all_rows(spark):
    """Quantiles of every row's string, with repeats, where a sample of 4096 would be off."""
    rows = [(i, f"v{(i * 7919) % 6007:05d}" if i % 3 else "v03000", "one" if i % 50 else None) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, host string").repartition(5)
    cuts = hilbert.string_cuts(docs, ["url", "host"], 64)
    values = sorted(u for _, u, _ in rows)
    part = lambda x: min((x * 64 + 63) // len(values), 63)
    first = {v: values.index(v) for v in set(values)}
    ends = {v: i for i, v in enumerate(values)}
    assert cuts["url"] == sorted(v for v in first if part(ends[v]) > part(first[v] - 1)) and cuts["host"] == ["one"] and len(cuts["url"]) > 40
