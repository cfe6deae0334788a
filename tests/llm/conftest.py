import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, matches int"


def make_rows():
    """Copies, near copies, shared passages, short texts, long texts, nulls, repeated rows and odd characters."""
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdeéßü") for _ in range(r.randint(1, 9))) for _ in range(400)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    rows, ids = [], iter(range(1000, 3000, 3))
    add = lambda t, lang="en", src="s0": rows.append((next(ids), t, lang, src, len(t or ""), "x", 1))
    base, passage, line = words(120), words(60), "Common line no 12 of this host, all rights reserved"
    for k in range(60):
        add(" ".join(words(r.randint(55, 130))) + ("\n" + line if k % 2 else "") + "\n" + " ".join(words(20)), r.choice(["en", "de"]), "s0" if k % 3 else f"s{k % 5}")
    for k in range(12):
        t = list(base)
        for _ in range(k % 5):
            t[r.randrange(len(t))] = r.choice(vocab).upper()
        add(" ".join(t))
    for _ in range(6):
        t = words(80)
        t[20:20] = passage
        add(" ".join(t), "fr")
    for t in (None, "", " ", "\n\n", "one", "two words", "now three words", "four words right here", "\u00a0 x\u2003y", "a" * 400, "ab " * 300, "word\n" * 80, "<|endoftext|> and It's 123's\t\t x", "ends in space   ", "\x00\x01 nul", "É ü  \u3000wide", "😀 emoji 😀 emoji 😀"):
        add(t, None, None)
    add(" ".join(words(9000)), "de", "s1")
    add(" ".join(base), "en", "s2")
    add("b" * 100, "en", "s2")
    add("a" * 77, "en", "s2")
    rows += [rows[3], rows[3], (None, " ".join(base), "en", "s0", 1, None, None), (None, None, None, None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
