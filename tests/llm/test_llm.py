"""Every training-data operator against brute force, on a fixture with the odd cases, and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tracewell.llm import decontaminate, hilbert, kneser_ney, packing, parity_join, quality_lm, quality_rules, repeats, token_counts, url_filter
from tracewell.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else df.collect()


def key(rows):
    return sorted(rows, key=repr)


# --- 2


def test_decontaminate(spark, docs, rows, empty):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 70]
    w = texts[0].split()
    items = [(1, " ".join(w[5:40])), (2, "two WORDS"), (3, ""), (4, None), (None, " ".join(w[:30])), (5, " ".join(texts[1].split()[30:41]).upper()), (5, "one"), (22, " ".join(w[30:44]) + " zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        x = word.findall((t or "").translate(LOW))
        n = min(10, len(x))
        for k in range(len(x) - n + 1 if n and i is not None else 0):
            windows[tuple(x[k : k + n])].add(i)
    want = []
    for i, t, *_ in rows:
        x, hit, found = word.findall((t or "").translate(LOW)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(x) - n + 1):
                if tuple(x[k : k + n]) in windows:
                    found |= windows[tuple(x[k : k + n])]
                    hit |= set(range(k, k + n))
        want.append((i, len(x), len(hit), tuple(sorted(found))))
    for block_bytes in (1 << 20, 60):  # one block, and several
        df = decontaminate.benchmark_matches(docs, bench, block_bytes=block_bytes).withColumn("n_hit", decontaminate.hit_words())
        have = [(r.doc.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}))) for r in df.collect()]
        assert key(have) == key(want)
    assert sum(bool(x[3]) for x in want) > 2
    assert decontaminate.benchmark_matches(empty, bench).count() == 0
    none = decontaminate.benchmark_matches(docs, bench.limit(0))
    assert none.count() == len(rows) and none.where("size(matches) > 0").count() == 0
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[3] for x in want)


def test_longest_matches(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "x y " + text + " z"), (2, text[10:90])], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "q " + text)], "item_id long, text string")
    found = {r.doc.doc_id: r.matches for r in decontaminate.benchmark_matches(docs, bench).collect()}
    assert [tuple(m) for m in found[1]] == [(9, 2, 1, 50)]
    assert len(found[2]) == 1 and found[2][0].length > 10


# --- 3


def rules_by_hand(t):
    t = t or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def without_lines(rows, max_docs):
    """Words lost and text left of each row: lines of more than max_docs documents of a host go, but in the first of them."""
    norm = lambda x: re.sub(r"[0-9\x20\x09\x0B-\x0D]+", "", x).lower()
    docs, first = defaultdict(set), {}
    for at, (i, t, _, src, *_) in enumerate(rows):
        for k in {(src, norm(x)) for x in (t or "").split("\n") if norm(x)}:
            docs[k].add((i, None if i is not None else at))
            if i is not None:
                first[k] = min(i, first.get(k, i))
    for i, t, _, src, *_ in rows:
        gone = [x for x in (t or "").split("\n") if norm(x) and len(docs[src, norm(x)]) > max_docs and first.get((src, norm(x))) != i]
        yield sum(len(WORD.findall(x)) for x in gone), "\n".join(x for x in (t or "").split("\n") if x not in gone)


def test_quality_rules(docs, rows, empty):
    df = quality_rules.quality_rules(docs, max_docs=5, depleted=0.1, clean="clean").cache()
    want = [(i, *rules_by_hand(t)) for i, t, *_ in rows]
    assert key(got(df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) == key(want)
    cut = [(r[0], lost, not rules_by_hand(r[1])[5] and lost <= 0.1 * rules_by_hand(r[1])[0], left) for r, (lost, left) in zip(rows, without_lines(rows, 5))]
    assert key((r.doc_id, r.n_removed_words, r.kept, r.clean) for r in df.collect()) == key(cut)
    assert sum(lost > 0 for _, lost, *_ in cut) > 10 and any(lost and not kept and not rules_by_hand(r[1])[5] for r, (_, lost, kept, _) in zip(rows, cut))
    without = quality_rules.quality_rules(docs, max_docs=5, depleted=0.1)
    assert key(map(tuple, without.collect())) == key(map(tuple, df.drop("clean").collect()))
    assert quality_rules.quality_rules(empty).count() == 0
    kept = quality_rules.quality_rules(docs, keep=docs.columns, max_docs=10**6).where("kept")
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if not rules_by_hand(t)[5]}


def test_rows_of_one_id_are_one_document(spark):
    text = lambda k: "The same line here\n" + " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, text(k), None, "h") for k in range(11)] + [(2, text(20), None, "h")] + [(None, text(30 + k), None, "n") for k in range(12)] + [(40, text(45), None, "n")] + [(k, text(50 + k), None, "m") for k in range(11)] + [(3, text(3), None, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    have = quality_rules.quality_rules(docs, max_docs=10, keep=["doc_id", "source"]).collect()
    want = Counter((r[0], r[3], lost) for r, (lost, _) in zip(rows, without_lines(rows, 10)))
    assert Counter((r.doc_id, r.source, r.n_removed_words) for r in have) == want
    assert {s for _, s, lost in want if lost} == {"n", "m"}


def test_lines_above_the_limit_go(spark):
    """The text without them is returned, and the pipeline's stage writes it and counts n_chars again."""
    import corpus_pipeline

    letters = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits would not count
    body = lambda i: " ".join(f"{letters(i)}x{letters(k)}" for k in range(60))
    rows = [(i, f"{body(i)}\n\nShare   page {i}\nend {'abcdefgh'[i % 8]}{i // 8 * 'z'}", "en", "h" if i < 40 else "g", 1) for i in range(50)]
    rows += [rows[3], (90, None, "en", "h", 0), (91, "share PAGE 7\n" + body(91), None, "h", 2), (92, "share page 1", "en", "h", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # host g has the line on ten documents, which is not above the limit; document 0 is the first that has it
    without = lambda i, t, h: "\n".join(x for x in (t or "").split("\n") if h != "h" or i == 0 or not x.lower().startswith("share"))
    have = quality_rules.quality_rules(docs, clean="clean").select("doc_id", "clean")
    assert key(map(tuple, have.collect())) == key([(i, without(i, t, h)) for i, t, _, h, _ in rows])
    stage = corpus_pipeline.rules(spark, docs, "")
    assert stage.columns == docs.columns
    want = [(i, without(i, t, h), g, h, len(without(i, t, h))) for i, t, g, h, _ in rows if i not in (90, 92)]
    assert key(map(tuple, stage.collect())) == key(want)


def test_copies_do_not_vanish(spark):
    """A text on thirty documents of a host stays on the first."""
    rows = [(i, " ".join(f"w{'abcdefghij'[i % 10]}{'xyz'[i // 10]}{k}{'q' * k}" for k in range(60)), "h") for i in range(30)] + [(100 - i, "\n".join(" ".join(f"c{'z' * k}{'y' * j}" for k in range(20)) for j in range(4)), "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()} == {*range(30), 71}


# --- 4


def test_token_counts(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, x, *_ in rows:
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 1024))
    assert key(got(token_counts.token_counts(docs, path))) == key(want)
    assert token_counts.token_counts(empty, path).count() == 0


# --- 5


def whole_characters(text, gone):
    """What is left of a text if only characters go all of whose bytes are to go."""
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not all(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def repeats_by_hand(rows, span, texts=False):
    first = {}
    big = 1 << 63
    for i, t in sorted(((big if i is None else i), (t or "").encode()) for i, t, *_ in rows):
        for s in range(len(t) - span + 1):
            first.setdefault(t[s : s + span], i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < (big if i is None else i):
                gone[s : s + span] = b"\1" * span
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield (i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)) if not texts else (i, whole_characters(t or "", gone), len(b))


@pytest.mark.parametrize("batch", [50, 200_000])
def test_repeats(docs, rows, empty, batch):
    df = repeats.remove_repeats(docs, batch_windows=batch)
    have = [(r.rest.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]
    want = list(repeats_by_hand(rows, 50))
    assert key(have) == key(want)
    assert sum(x[2] > 0 for x in want) > 10
    assert repeats.remove_repeats(empty).count() == 0
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns
    whole = [(i, t) for i, t, n in repeats_by_hand(rows, 50, texts=True) if t or not n]
    assert key((r.doc_id, r.text or "") for r in left.collect()) == key(whole)


def test_cuts_keep_other_characters(spark):
    """A mark of an invalid character outside the cut stays, and so does a character that the cut splits."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghij") for _ in range(60))
    rows = [(1, f"first \ufffd {passage}\u00e9 end"), (2, f"keep (\ufffd) this {passage}\u00e8 and \ufffd that"), (3, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    have = {x.doc_id: x.text for x in repeats.without_repeats(docs).collect()}
    assert have == {1: rows[0][1], 2: "keep (\ufffd) this\u00e8 and \ufffd that"} or have == {1: rows[0][1], 2: "keep (\ufffd) this \u00e8 and \ufffd that"}
    assert have == {i: t for i, t, n in repeats_by_hand(rows, 50, texts=True) if t}


def test_repeats_of_periodic_text(spark):
    """Runs of different lengths with the same short tail: repeats longer than the suffix order, and zero bytes."""
    import random

    r = random.Random(4)
    other = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    texts = ["-" * 100 + "\n" + other(), "-" * 120 + "\n" + other(), other() + "-" * 400, "x" + "-" * 180 + "\n" + other()]
    texts += ["of " * n + f"tail {other()}" for n in (40, 60, 200)] + [f"{other()}{'=+' * n}| shared tail" for n in (30, 64, 90)]
    texts += [c * n + "\n" + other() for c in "=_.*~#+ox" for n in (100, 120)]  # whether a window's least hash is the run's is a matter of luck
    texts += ["\0" * 60, "\0" * 70 + "a", "\0" * 200 + "ab", "z" + "\0" * 130, other() + "\0" * 75 + "ab"]
    rows = list(enumerate(texts))
    for order in (rows, [(100 - i, t) for i, t in rows]):
        df = repeats.remove_repeats(spark.createDataFrame(order, "doc_id long, text string"))
        have = [(x.rest.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in df.collect()]
        assert key(have) == key(repeats_by_hand(order, 50))


def test_maximal_repeats():
    segments = [b"xabcabcabcq", b"yabcabcz", b"zabcabcz"]
    body = np.frombuffer(b"".join(segments), np.uint8)
    span, at, room, before = 3, [], [], []
    low = 0
    for s in segments:
        for k in range(len(s) - span + 1):
            at.append(low + k)
            room.append(len(s) - k)
            before.append(s[k - 1] if k else -1)
        low += len(s)
    depth, bounds, member = repeats.maximal_repeats(body, np.array(at), np.array(room), np.array(before), span)
    have = {(bytes(body[at[member[a]] : at[member[a]] + d]), b - a) for d, a, b in zip(depth.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())}
    where = [(s[k : k + n], s[k - 1 : k] if k else None, s[k + n : k + n + 1] or None) for s in segments for k in range(len(s)) for n in range(span, len(s) - k + 1)]
    want = set()
    for x in {w[0] for w in where}:
        own = [w for w in where if w[0] == x]
        left, right = {w[1] for w in own}, {w[2] for w in own}
        if len(own) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
            want.add((x, len(own)))
    assert have == want


# --- 6


def lm_by_hand(train, texts):
    bi = Counter(p for t in train for p in zip(["<s>", *t], t))
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    before = Counter(w for _, w in bi)

    def disc(counts):
        n1, n2, n3, n4 = (sum(x == k for x in counts) for k in (1, 2, 3, 4))
        if min(n1, n2, n3) > 0:
            y = n1 / (n1 + 2 * n2)
            d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
            if all(0 <= x <= k for k, x in enumerate(d, 1)):
                return [0, *d]
        return [0, 0.5, 1.0, 1.5]

    d2, d1 = disc(bi.values()), disc(before.values())
    total, kinds = Counter(), defaultdict(Counter)
    for (u, _), x in bi.items():
        total[u] += x
        kinds[u][min(x, 3)] += 1
    spread = sum(d1[min(x, 3)] for x in before.values()) / max(len(bi), 1) if bi else 1.0
    word = lambda w: max(before[w] - d1[min(before[w], 3)], 0) / max(len(bi), 1) + spread / (v + 1)

    def p(u, w):
        if not total[u]:
            return word(w)
        x = bi.get((u, w), 0)
        return max(x - d2[min(x, 3)], 0) / total[u] + sum(d2[k] * kinds[u][k] for k in (1, 2, 3)) / total[u] * word(w)

    for t in texts:
        yield len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(u, w)) for u, w in zip(["<s>", *t], t))


def test_kneser_ney(docs, rows, empty):
    held = kneser_ney.id_remainder(docs["doc_id"], 7) == 2
    model = kneser_ney.train(docs.where(~held))
    have = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.n_known, model.n_tokens, r.base_score, r.score) for r in kneser_ney.score(docs, model).collect())
    split = lambda t: [*WORD.findall((t or "").translate(LOW)), "</s>"]
    number = lambda i: b"" if i is None else str(i).encode()
    train = [split(t) for i, t, *_ in rows if zlib.crc32(number(i)) % 7 != 2]
    want = sorted((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, lm_by_hand(train, [split(r[1]) for r in rows])))
    assert [x[:4] for x in have] == [x[:4] for x in want]
    assert np.allclose([x[4:] for x in have], [x[4:] for x in want])
    nothing = kneser_ney.train(empty)
    assert nothing.n_tokens == 0 and kneser_ney.score(docs, nothing).where("score <> 0").count() == 0
    assert kneser_ney.score(empty, model).count() == 0


# --- 1


def test_quality_lm(spark, docs, rows, empty):
    ids = [i for i, t, *_ in rows if i is not None and t and len(t) > 300]
    trusted = spark.createDataFrame([(i,) for i in ids] + [(None,), (5,)], "doc_id long")
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.log10_prob) for r in quality_lm.quality_by_perplexity(docs, trusted).collect())
    split = lambda t: [*WORD.findall((t or "").translate(LOW)), "</s>"]
    want = []
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        train = [split(r[1]) for r in own if r[0] in ids and zlib.crc32(str(r[0]).encode()) % 3 != 0]
        want += [(-1 if r[0] is None else r[0], x[0], x[4] if train else 0.0) for r, x in zip(own, lm_by_hand(train, [split(r[1]) for r in own]))]
    want.sort()
    assert [x[:2] for x in have] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in have], [x[2] for x in want], rtol=1e-5)
    assert quality_lm.quality_by_perplexity(empty, trusted).count() == 0
    all_kept = quality_lm.quality_by_perplexity(docs, trusted.limit(0))
    assert all_kept.where("kept").count() == len(rows)


def test_quality_lm_rejects_junk(spark):
    import random

    r = random.Random(1)
    vocab = [f"word{i}" for i in range(60)]
    good = [(i, " ".join(r.choice(vocab) for _ in range(60)), "en") for i in range(300)]
    junk = [(1000 + i, " ".join("".join(r.choice("xyzq#|") for _ in range(6)) for _ in range(60)), "en") for i in range(20)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    judged = {x.doc_id: x.kept for x in quality_lm.quality_by_perplexity(docs, trusted).collect()}
    assert not any(judged[1000 + i] for i in range(20)) and np.mean([judged[i] for i in range(300)]) > 0.95


def test_quality_lm_samples_each_language(spark):
    """A rare language has its own bound, and a text that crosses a bound does not end the sample."""
    rows = [(i, "en", 1000) for i in range(400)] + [(1000 + i, "is", 100) for i in range(9)] + [(2000, "en", 9000), (2001, "is", 60_000), (2002, "is", 2000), (2003, "fo", 5000)]
    for seed in range(3):
        sizes = spark.createDataFrame(rows, "doc_id long, _l string, size int").selectExpr("doc_id", "_l", "size", f"xxhash64(doc_id, {seed}) as rank")
        have = defaultdict(set)
        for r in quality_lm.training_sample(sizes, 10_000).collect():
            have[r["_l"]].add(r.doc_id)
        assert len(have["en"]) == 10 and max(have["en"]) < 400
        assert have["is"] == {1000 + i for i in range(9)} | {2002} and have["fo"] == {2003}


def test_quality_lm_of_a_rare_language(spark):
    rows = [(i, f"some english words {i} " * 20, "en") for i in range(300)] + [(1000 + i, f"rare words of it {i} " * 20, "is") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.select("doc_id")
    judged = quality_lm.quality_by_perplexity(docs, trusted, train_bytes=3000).where("lang = 'is'").collect()
    assert len(judged) == 4 and all(r.log10_prob < -1 for r in judged)  # without a training text it is 0


def test_quality_lm_trains_on_all_trusted_text(spark):
    """Over 16 MiB of a language's text, and texts larger than that, train whole; the words of some are in no other."""
    word = lambda i, j: f"{i}x{j}".ljust(1000, "y")
    rows = [(i, " ".join(word(i, j % 7000) for j in range(9000)), "en") for i in (1, 3, 4)] + [(5, " ".join(word(5, j % 900) for j in range(18_000)), "is"), (8, word(1, 2) + " " + word(3, 4), "en"), (9, word(5, 7), "is")]
    taught = [r for r in rows if r[0] < 8 and zlib.crc32(str(r[0]).encode()) % 3]
    assert sum(len(r[1]) for r in taught if r[2] == "en") > 17 << 20 and any(r[2] == "is" for r in taught)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    have = {r.doc_id: r.log10_prob for r in quality_lm.quality_by_perplexity(docs, docs.select("doc_id").where("doc_id < 8")).collect()}
    split = lambda t: [*t.split(), "</s>"]
    for lang in ("en", "is"):
        own = [r for r in rows if r[2] == lang]
        want = lm_by_hand([split(r[1]) for r in taught if r[2] == lang], [split(r[1]) for r in own])
        assert np.allclose([have[r[0]] for r in own], [x[4] for x in want])


# --- 7


def test_hilbert(docs, rows, empty):
    df = hilbert.hilbert_shards(docs, ["lang", "source"], n_shards=16)
    have = df.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in have) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in have:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(16))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    curve = [r.curve for r in sorted(have, key=lambda r: (r.shard, r.slot))]
    assert curve == sorted(curve)
    assert hilbert.hilbert_shards(empty, ["lang", "source"]).count() == 0


def test_hilbert_dimensions_of_any_type(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    rows = [(k, "t", day + datetime.timedelta(k), k / 2000, "p" * 300 + f"{k:05d}", k % 2 == 0, datetime.datetime(2020, 1, 1, k % 24)) for k in range(2000)] + [(5000, None, None, None, None, None, None), (5001, "", None, math.nan, "", None, None), (5002, "", None, math.inf, "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, day date, share double, name string, odd boolean, at timestamp")
    for dim in ("day", "share", "name"):
        have = {r.doc_id: r for r in hilbert.hilbert_shards(docs, [dim], n_shards=8).collect()}
        assert len(have) == 2003 and len({have[k].curve for k in range(2000)}) >= 14  # cells
        n = Counter(r.shard for r in have.values())
        assert max(n.values()) - min(n.values()) <= 1
        own = [{k * 16 // 2000 for k in range(2000) if have[k].shard == s} for s in range(8)]
        assert all(len(x) <= 5 for x in own)  # a shard spans few of 16 parts of the dimension
    assert hilbert.hilbert_shards(docs, ["odd", "at"], n_shards=4).count() == 2003
    with pytest.raises(ValueError, match="no order"):
        hilbert.hilbert_shards(docs.withColumn("list", docs.doc_id.cast("string").cast("binary")), ["list"])


def test_curve_is_hilbert():
    bits, n = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    index = hilbert.curve_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- 8


def test_packing(docs, rows, empty):
    have = packing.pack(docs, packing.words_and_end(), sizes=(64, 128, 256), group_rows=40).collect()
    want = Counter((i, len(WORD.findall(t or "")) + 1) for i, t, *_ in rows)
    total = Counter()
    for r in have:
        total[r.doc_id] += r.length
    assert total == Counter({i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in want})
    bins = defaultdict(list)
    for r in have:
        assert r.capacity in (64, 128, 256) and r.start == r.piece * 256
        bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.bin_offset for r in own] == [0, *ends[:-1]]
        assert own[0].capacity == min(s for s in (64, 128, 256) if s >= ends[-1])
    assert packing.pack(empty, packing.words_and_end()).count() == 0


def test_best_fit_by_hand():
    lengths = sorted(np.random.default_rng(3).integers(1, 9, 60).tolist(), reverse=True)
    where, offset, capacity = packing.best_fit(lengths, (4, 8, 16), overhead=1, attention=64)
    bins, waiting = [], sum(lengths)
    for n, b, at in zip(lengths, where, offset):
        waiting -= n
        fits = [(cap - used, -i) for i, (cap, used) in enumerate(bins) if cap - used >= n]
        if fits:
            assert bins[b][0] - bins[b][1] == min(fits)[0]
        else:
            assert b == len(bins)
            bins.append([packing.least_cost_size(n, waiting, (4, 8, 16), 1, 64), 0])
        assert at == bins[b][1]
        bins[b][1] += n
    assert capacity == [min(s for s in (4, 8, 16) if s >= used) for _, used in bins]


# --- 9


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.org", ""), ("allow", "x.a.org", "/p"), ("block", "a.org", "/long/path/")]
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.b.Example.NET/en/x?q=1", "ftp://example.net/e", "http://example.com/de/#f", "http://notexample.com/de/", "x://y://net/", "http://a.org?x", "http://x.a.org/public", "http://x.a.org/long/path/1", "http://.net/", "http://É.net/", "http://org/fr/", "http://q.org:80/fr/", "http://a.net\n/x"]
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls * 2)] + [(None, None, None, None)], "page_id long, url string, host string, verdict string")
    want = []
    for k, u in [*enumerate(urls * 2), (None, None)]:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((k, host, path, best and best[2], best[3] if best else "allow"))
    assert key(got(url_filter.filter_urls(pages, rules, keep=["page_id"]))) == key(want)
    loud = [(a, h.upper(), p) for a, h, p in rules]
    for most in (url_filter.MAX_RULES, 0):
        old, url_filter.MAX_RULES = url_filter.MAX_RULES, most
        clash = url_filter.filter_urls(pages, loud, keep=["verdict", "host", "page_id"])
        url_filter.MAX_RULES = old
        assert clash.columns == ["verdict", "host", "page_id", "host", "path", "rule", "verdict"]
        plain = [(r[2], r[3], r[4], *([r[5].lower()] if r[5] else [None]), r[6]) for r in clash.collect()]
        assert key(plain) == key((k, h, p, r.lower() if r else r, v) for k, h, p, r, v in want)
    old, url_filter.MAX_RULES = url_filter.MAX_RULES, 0
    try:
        assert key(got(url_filter.filter_urls(pages, rules, keep=["page_id"]))) == key(want)
    finally:
        url_filter.MAX_RULES = old
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, []).where("rule is not null or verdict <> 'allow'").count() == 0


# --- 10


def components_by_hand(rows, percent, n):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (i, *_) in zip(label, rows):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [(r[0], len(s), least.get(x) if s else r[0]) for r, s, x in zip(rows, sets, label)]


@pytest.mark.parametrize("percent,n,tile", [(85, 4, 2048), (80, 5, 2048), (85, 4, 3)])
def test_parity_join(docs, rows, empty, percent, n, tile):
    have = parity_join.jaccard_components(docs, percent, n, tile_sets=tile).collect()
    assert key(map(tuple, have)) == key(components_by_hand(rows, percent, n))
    assert len({r.component_id for r in have}) < len(have) - 10
    if tile == 3:
        assert parity_join.jaccard_components(empty).count() == 0
        kept = parity_join.keep_one(docs, percent, n)
        assert kept.columns == docs.columns
        one_of_each(rows, [(r.doc_id, r.text) for r in kept.collect()], percent, n)


def one_of_each(rows, kept, percent, n):
    """Every component of texts keeps one row, of the least id (null last); rows without words stay."""
    numbered = [(k, t) for k, (_, t, *_) in enumerate(rows)]
    by = {}
    for k, size, c in components_by_hand(numbered, percent, n):
        by.setdefault(c if size else -1 - k, []).append(k)
    kept, order = Counter(kept), lambda i: (i is None, i or 0)
    assert sum(kept.values()) == len(by)
    for members in by.values():
        least = min(order(rows[k][0]) for k in members)
        mine = {(rows[k][0], rows[k][1]) for k in members if order(rows[k][0]) == least}
        assert any(kept[x] for x in mine)
        kept.subtract([next(x for x in mine if kept[x])])
    assert not any(kept.values())


def test_keep_one_of_rows_that_share_ids(spark):
    """Different texts under one id are judged by their own links; null ids have an order; extra columns may clash."""
    r = random.Random(12)
    words = lambda: " ".join(r.choice("abcdefgh") * r.randint(1, 6) + str(r.randint(0, 99)) for _ in range(40))
    a, b, c, d = (words() for _ in range(4))
    rows = [(5, a), (3, a), (5, b), (7, c), (7, d), (7, d), (None, c), (None, c), (None, words()), (9, None), (9, ""), (4, b + " more"), (None, None)]
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int, label int").repartition(3)
    have = parity_join.keep_one(docs, 80, 5)
    assert have.columns == docs.columns
    kept = [(x.doc_id, x.text) for x in have.collect()]
    one_of_each(rows, kept, 80, 5)
    assert (3, a) in kept and (5, a) not in kept and (7, c) in kept and kept.count((7, d)) == 1 and kept.count((None, c)) == 0


def test_clusters_of_several_classes(spark):
    """Groups of near copies that share their heaviest blocks, and loose sets under the same blocks, over many tiles."""
    import random

    r = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(3):
        shared = [r.choice(vocab) for _ in range(150)]
        for k in range(25):
            t = shared + [r.choice(vocab) for _ in range(10 + 9 * (k % 4) * (g > 0))]
            for _ in range(k % 3):
                t[r.randrange(len(t))] = f"x{k}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_by_hand(rows, 85, 4)
    assert 3 < len({c for *_, c in want}) < 70
    for tile in (2, 5):
        assert key(map(tuple, parity_join.jaccard_components(docs, tile_sets=tile).collect())) == key(want)


def test_loose_texts_of_one_block_are_not_tiled(spark, monkeypatch):
    """Texts that one passage chains into a cluster of many tiles leave it before sets are sent there; links stay."""
    import random

    r = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(80 + k % 40)]) for k in range(60)]
    for k in range(8):
        words = texts[k].split()
        words[-1] = "other"
        texts.append(" ".join(words))
    rows, seen, tiles_of = list(enumerate(texts)), [], parity_join.tiles_of

    def spy(wanted, tile_sets, tile_shingles):
        seen.append(sorted(x["count"] for x in wanted.groupBy("label").count().collect()))
        return tiles_of(wanted, tile_sets, tile_shingles)

    monkeypatch.setattr(parity_join, "tiles_of", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(map(tuple, parity_join.jaccard_components(docs, tile_sets=4).collect())) == key(components_by_hand(rows, 85, 4))
    assert seen[0][-1] > 20 and seen[1][-1] <= 4


def test_near_sets_of_buckets_by_brute_force():
    """Groups are those of all pairs of a bucket, whatever its size, that share enough; a bucket's members may repeat elsewhere."""
    rng = np.random.default_rng(5)
    bases = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (30, 90, 400, 1500)]
    sets = []
    for base in bases:
        for k in range(25):
            cut = len(base) * (k % 5) // 12
            sets.append(np.unique(np.append(base[: len(base) - cut], rng.integers(0, 1 << 62, k % 3).astype(np.uint64))))
    size = np.array([len(x) for x in sets])
    words = parity_join.widths(size)
    flat = parity_join.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    buckets = [rng.choice(len(sets), n, replace=False) for n in (2, 2, 3, 5, 16, 17, 40, 5)] + [np.arange(50, 75)]
    known = parity_join.Sketched(size, flat, np.cumsum(words) - words, 85)
    known.buckets(np.concatenate(buckets), np.concatenate([[0], np.cumsum([len(b) for b in buckets])]))
    want = list(range(len(sets)))
    for b in buckets:
        for i in b:
            for j in b:
                if known.near(np.array([i]), np.array([j]))[0]:
                    want = [want[i] if x == want[j] else x for x in want]
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 85 * (size[i] + size[j] - common):
                    assert want[i] == want[j]
    groups = lambda label: {tuple(np.flatnonzero(np.array(label) == x)) for x in set(label)}
    assert groups(known.label.tolist()) == groups(want) and 30 < len(groups(want)) < len(sets)


def test_bands_lose_no_pair():
    r = np.random.default_rng(5)
    bands = parity_join.Bands(85)
    for n in (6, 7, 13, 40, 300, 2000):
        for _ in range(30):
            a = r.integers(0, 1 << 63, n, dtype=np.uint64)
            b = a.copy()
            k = int(0.081 * n)
            b[r.choice(n, k, replace=False)] = r.integers(0, 1 << 63, k, dtype=np.uint64)
            b = b[: n - int(r.integers(0, 2))]
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            keys, text = parity_join.block_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            if 100 * common >= 85 * (len(a) + len(b) - common):
                assert set(keys[text == 0]) & set(keys[text == 1])


@pytest.mark.parametrize("percent,n", [(80, 4), (75, 3), (90, 9), (50, 1)])
def test_bands_of_the_smallest_sets(percent, n):
    """n of n + 1 shingles in common are exactly `percent`."""
    for seed in range(20):
        a = np.sort(np.random.default_rng(seed).integers(0, 1 << 63, n + 1, dtype=np.uint64))
        b = np.delete(a, seed % (n + 1))
        keys, text = parity_join.block_keys(np.concatenate([a, b]), np.array([0, n + 1, 2 * n + 1]), parity_join.Bands(percent))
        assert set(keys[text == 0]) & set(keys[text == 1])


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (90, 2))] + [(500, k) for k in range(501, 540)] + [(600 + k, 601 + k) for k in range(25)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    have = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in have.collect()} == label and have.count() == len(label)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    long = next(t for _, t, *_ in rows if t and 90 < len(t.split()) < 200).split()
    spark.createDataFrame([(1, " ".join(long[10:30]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    have = pipeline.run(spark, str(tmp_path)).collect()
    live = [(r[0], left, *r[2:]) for r, (lost, left) in zip(rows, without_lines(rows, 10)) if not rules_by_hand(r[1])[5] and lost <= 0.3 * rules_by_hand(r[1])[0]]
    linked = components_by_hand([(k, r[1]) for k, r in enumerate(live)], 80, 5)
    once, seen = [], set()  # one row of each component: of the least id, null last; which of equal ids does not matter here
    for k in sorted(range(len(live)), key=lambda k: (live[k][0] is None, live[k][0] or 0)):
        if not linked[k][1] or linked[k][2] not in seen:
            once.append(live[k])
            seen.add(linked[k][2])
    left = [(i, t) for i, t, n in repeats_by_hand(once, 50, texts=True) if t or not n]
    window = {tuple(long[10 + k : 20 + k]) for k in range(11)}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    clean = []
    for i, t in left:
        w = word.findall(t.translate(LOW))
        if not any(tuple(w[k : k + 10]) in window for k in range(len(w) - 9)):
            clean.append((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1))
    total = Counter()
    for r in have:
        total[r.doc_id] += r.length
    assert total == Counter(dict(clean))
    assert len(clean) < len(left)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
