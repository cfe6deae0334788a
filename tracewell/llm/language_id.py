"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A text's bytes, letters lower-cased and all runs of other ASCII bytes as spaces, go through in windows of a fixed length
that overlap by the widest filter less one, so that every run of bytes a filter could see is seen once. Filters of
several widths pass over embedded bytes; each filter's greatest value in a window, above 0, feeds a softmax over the
languages. A document's probabilities are the mean of its windows', weighted by their letters.

The network is fitted on the driver on a sample of windows, bounded for each language; it is a few thousand numbers,
which is what is broadcast. Counts of languages and every prediction cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .kernels import LOWER, chunks, owner, schema_of

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16  #: of each width
EMBEDDED = 8
STRIDE = WINDOW - max(WIDTHS) + 1
BATCH = 256  #: windows that go through at once
MAX_LANGUAGES = 1000
SPACE = 0x20

SYMBOL = np.full(256, SPACE, np.uint8)  # what a byte counts as
for _b in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    SYMBOL[_b] = LOWER[_b]


def windows(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, symbols) of windows: batches of all windows of all texts, the last of each text filled up with spaces."""
    size = np.diff(off)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    ptr = np.append(0, np.cumsum(count))
    symbols = np.append(SYMBOL[buf], np.full(WINDOW, SPACE, np.uint8))
    text = owner(ptr)
    start = off[text] + (np.arange(ptr[-1]) - ptr[text]) * STRIDE
    left = off[text + 1] - start
    for low in range(0, len(text), BATCH):
        at = slice(low, low + BATCH)
        rows = symbols[start[at, None] + np.arange(WINDOW)]
        if left[at].min() < WINDOW:
            rows[np.arange(WINDOW) >= left[at, None]] = SPACE
        yield text[at], rows


def _shape(width: int) -> np.ndarray:
    return np.repeat([np.repeat([j < w for j in range(width)], EMBEDDED) for w in WIDTHS], FILTERS, axis=0).T


@dataclass
class Network:
    """Byte embedding, filters (one matrix; narrower ones are 0 beyond their width), and the softmax layer."""

    langs: list[str]
    embedding: np.ndarray
    filters: np.ndarray  # [width * EMBEDDED, filters]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shape: np.ndarray = field(default_factory=lambda: _shape(max(WIDTHS)))

    @classmethod
    def new(cls, langs: list[str], rng: np.random.Generator) -> Network:
        n, wide = len(WIDTHS) * FILTERS, max(WIDTHS) * EMBEDDED
        draw = lambda *s: rng.normal(0, 1, s).astype(np.float32)
        net = cls(langs, draw(256, EMBEDDED) * 0.5, draw(wide, n) * 0.2, np.zeros(n, np.float32), draw(n, len(langs)) * 0.1, np.zeros(len(langs), np.float32))
        net.filters *= net.shape
        return net

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.out, self.out_bias]

    def patches(self, symbols: np.ndarray) -> np.ndarray:
        """[window, place, width * EMBEDDED]: what the filters see, as a view."""
        flat = self.embedding[symbols].reshape(len(symbols), -1)
        return np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * EMBEDDED, axis=1)[:, ::EMBEDDED]

    def pooled(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each filter's greatest value in each window above 0, its place, and the patches."""
        seen = self.patches(symbols)
        values = (seen.reshape(-1, seen.shape[2]) @ self.filters).reshape(*seen.shape[:2], -1)
        return np.maximum(values.max(axis=1) + self.bias, 0), values, seen

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        z = self.pooled(symbols)[0] @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def gradients(self, symbols: np.ndarray, lang: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, by the parameters. Only the places with the greatest values pass it on."""
        h, values, seen = self.pooled(symbols)
        place = values.argmax(axis=1)  # [window, filter]
        z = h @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), lang] -= 1
        p /= len(p)
        back = (p @ self.out.T) * (h > 0)
        best = seen[np.arange(len(p))[:, None], place]  # [window, filter, width * EMBEDDED]
        to_filters = np.einsum("nf,nfw->wf", back, best) * self.shape
        to_bytes = (back[:, :, None] * self.filters.T[None]).reshape(*back.shape, max(WIDTHS), EMBEDDED)
        which = symbols[np.arange(len(p))[:, None, None], place[:, :, None] + np.arange(max(WIDTHS))]
        to_embedding = np.zeros_like(self.embedding)
        np.add.at(to_embedding, which.ravel(), to_bytes.reshape(-1, EMBEDDED))
        return [to_embedding, to_filters, back.sum(axis=0), h.T @ p, p.sum(axis=0)]


def fit(langs: list[str], symbols: np.ndarray, lang: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004, seed: int = 13) -> Network:
    """Adam over shuffled batches; each language's windows are drawn alike often, whatever their number."""
    rng = np.random.default_rng(seed)
    net = Network.new(langs, rng)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in net.parameters()]
    by = [np.flatnonzero(lang == i) for i in range(len(langs))]
    most, step = max(map(len, by)), 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([np.resize(rng.permutation(x), most) for x in by]))
        for low in range(0, len(order), batch):
            some = order[low : low + batch]
            step += 1
            pace = rate * (1 - epoch / epochs)
            for x, g, (m, v) in zip(net.parameters(), net.gradients(symbols[some], lang[some]), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _draw(each: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, order and up to `each` evenly spread windows, end to end, of every text that has windows with enough letters."""
    for batch, buf, off in chunks(batches):
        text, rows = (np.concatenate(x) for x in zip(*windows(buf, off), strict=True))
        good = np.flatnonzero((rows != SPACE).sum(axis=1) >= WINDOW // 8)
        text, rows = text[good], rows[good]
        ptr = np.searchsorted(text, np.arange(len(off)))
        count = np.diff(ptr)
        have = np.flatnonzero(count)
        drawn = [rows[ptr[t] + np.unique(np.arange(each) * count[t] // each)].tobytes() for t in have]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(have)), batch.column("order").take(pa.array(have)), pa.array(drawn, pa.binary())], schema=schema_of("lang string,order long,symbols binary"))


def train(labelled: DataFrame, sample_docs: int = 4000, windows_each: int = 4, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **fitting) -> Network | None:
    """A network on a sample of `sample_docs` documents at most, as many of each language, up to `windows_each` windows of each.

    The sample takes a language's documents of least hash of id and text; copies under one id count once. Rows without
    text or language, or of an empty one, teach nothing; without any window with letters there is no network (None).
    More than MAX_LANGUAGES languages raise a ValueError.
    """
    rows = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang <> '' and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return None
    each = max(1, sample_docs // len(counts))
    # only documents whose hash is below their language's limit go on, about twice as many as are taken
    limits = [(k, int(-(1 << 63) + min(1.0, 2 * each / n) * ((1 << 64) - 1025))) for k, n in counts.items()]
    limit = rows.sparkSession.createDataFrame(limits, "lang string, limit long")
    near = rows.withColumn("order", F.xxhash64(F.lit(13), "id", "text")).join(F.broadcast(limit), "lang").where("order <= limit")
    drawn = near.select("lang", "order", "text").mapInArrow(partial(_draw, windows_each), "lang string, order long, symbols binary")
    single = drawn.groupBy("lang", "order").agg(F.first("symbols").alias("symbols"))
    taken = single.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("order"))).where(F.col("r") <= each)
    sample = sorted((r["lang"], r["order"], bytes(r["symbols"])) for r in taken.collect())  # bounded by sample_docs
    if not sample:
        return None
    langs = sorted({k for k, _, _ in sample})
    symbols = np.frombuffer(b"".join(s for _, _, s in sample), np.uint8).reshape(-1, WINDOW)
    return fit(langs, symbols, np.repeat([langs.index(k) for k, _, _ in sample], [len(s) // WINDOW for _, _, s in sample]), **fitting)


def probabilities(net: Network, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of each text and language: the mean over the text's windows, weighted by letters; 0 for texts without any."""
    total = np.zeros((len(off) - 1, len(net.langs)))
    for text, symbols in windows(buf, off):
        letters = (symbols != SPACE).sum(axis=1)
        some = np.flatnonzero(letters)
        if len(some):
            np.add.at(total, text[some], net.probabilities(symbols[some]) * letters[some, None])
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] | list[str] = (), text: str = "text") -> DataFrame:
    """keep, lang_pred and score of every row, from its whole text.

    `und` with score 0 stands for texts that are null or have no letter, and for all without a network. Of equal
    probabilities the language that is first in order wins. Names of `keep` may be any but lang_pred and score.
    """
    kept = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.lit(0).alias("none"))
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(kept.alias("kept"), has.alias("has"), F.when(has, F.col(text)).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch, buf, off in chunks(batches):
            has = batch.column("has").to_numpy(zero_copy_only=False)
            pred, score = np.full(len(has), "und", object), np.zeros(len(has))
            if net is not None and has.any():
                p = probabilities(net, buf, off)
                best = p.argmax(axis=1)
                pred[has], score[has] = np.array(net.langs, object)[best[has]], np.minimum(p[has, best[has]], 1.0)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(pred, pa.string()), pa.array(score)], names=["kept", "lang_pred", "score"])

    schema = StructType([rows.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema).select(*[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
