"""Language identification by a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into fixed-length windows. Each byte becomes a small vector; filters of several
widths slide over the window; the largest response of each filter goes into a softmax. Training rows are windows of
labelled texts, drawn from all windows of all of them; a text's scores are the mean over all of its windows, weighted
by their letters (bytes of letters and of signs beyond ASCII).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import crc_of_id

WINDOW = 256  # bytes
WIDTHS, FILTERS, EMBEDDING = (2, 3, 5), 16, 8
TRAINED = 8000  # windows that training draws, the same share for each language
EPOCHS, BATCH, RATE = 6, 64, 0.004
BLOCK = 512  # windows that are applied at once
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_LETTERS = np.array([b > 127 or chr(b).isalpha() for b in range(256)])


def windows_of(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """The windows that cover all bytes, zeros behind the last one."""
    n = max(1, -(-len(raw) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, length)


@dataclass
class ByteNet:
    classes: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # width * EMBEDDING x FILTERS
    biases: list[np.ndarray]
    dense: np.ndarray  # pooled x classes
    shift: np.ndarray

    @classmethod
    def new(cls, classes: list[str], seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        e = rng.normal(0, 0.5, (256, EMBEDDING))
        e[0] = 0
        filters = [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS)) for w in WIDTHS]
        size = FILTERS * len(WIDTHS)
        f32 = lambda x: x.astype(np.float32)
        return cls(classes, f32(e), [f32(x) for x in filters], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], f32(rng.normal(0, size**-0.5, (size, len(classes)))), np.zeros(len(classes), np.float32))

    @staticmethod
    def patches(x: np.ndarray, width: int) -> np.ndarray:
        """Of embedded windows, every run of `width` positions as one row."""
        b, n, e = x.shape
        s0, s1, s2 = x.strides
        return np.lib.stride_tricks.as_strided(x, (b, n - width + 1, width * e), (s0, s1, s2), writeable=False)

    def pool(self, windows: np.ndarray, keep: bool = False):  # noqa: ANN201
        """Pooled responses; with keep, also the embedded bytes and the place of each largest response."""
        x = self.embedding[windows]
        pooled, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            p = self.patches(x, w)
            r = (p.reshape(-1, p.shape[2]) @ f).reshape(p.shape[0], p.shape[1], -1)
            if keep:
                places.append(r.argmax(1))
                pooled.append(np.take_along_axis(r, places[-1][:, None], 1)[:, 0] + b)
            else:
                pooled.append(r.max(1) + b)
        out = np.maximum(np.concatenate(pooled, 1), 0)
        return (out, x, places) if keep else out

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.dense + self.shift
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        return self.softmax(self.pool(windows))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ByteNet:
        """Adam on the cross entropy. A filter's gradient flows through the place of its largest response alone."""
        rng = np.random.default_rng(seed)
        params = [self.embedding, *self.filters, *self.biases, self.dense, self.shift]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, k = 0, len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                pooled, x, places = self.pool(windows[chosen], keep=True)
                error = self.softmax(pooled)
                error[np.arange(len(chosen)), labels[chosen]] -= 1
                error /= len(chosen)
                back = (error @ self.dense.T) * (pooled > 0)
                g_x = np.zeros_like(x)
                g_filters, g_biases = [], []
                rows = np.arange(len(chosen))[:, None]
                for j, w in enumerate(WIDTHS):
                    g = back[:, j * FILTERS : (j + 1) * FILTERS]
                    best = self.patches(x, w)[rows, places[j]]  # windows x filters x width * EMBEDDING
                    g_filters.append(np.einsum("bf,bfd->df", g, best))
                    g_biases.append(g.sum(0))
                    d = (g[:, :, None] * self.filters[j].T[None]).reshape(len(chosen), FILTERS, w, EMBEDDING)
                    for o in range(w):
                        np.add.at(g_x, (rows, places[j] + o), d[:, :, o])
                g_e = np.zeros_like(self.embedding)
                np.add.at(g_e, windows[chosen].reshape(-1), g_x.reshape(-1, EMBEDDING))
                g_e[0] = 0
                grads = [g_e, *g_filters, *g_biases, pooled.T @ error, error.sum(0)]
                assert len(grads) == len(params) == 3 + 2 * k
                step += 1
                for p, g, (m, s) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", windows: int = TRAINED) -> ByteNet:
    """Fit on about `windows` windows (one for each language at least), drawn from all labelled texts.

    Each window of a language has the same chance, by a hash of its bytes and place, wherever in its text it stands. The
    drawn windows are collected: 256 bytes each, whatever the input; the number of languages is the labels' own.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    many = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW))
    counts = rows.groupBy("lang").agg(F.sum(many).alias("n"), F.max(F.struct(F.xxhash64("text").alias("h"), F.left("text", F.lit(WINDOW)).alias("t"))).alias("any")).orderBy("lang").collect()
    share = max(1.0, windows / max(1, len(counts)))
    chance = {r.lang: min(1.0, share / r.n) for r in counts}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, raws = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                limit, n = chance[lang] * 2.0**32, -(-len(raw) // WINDOW)
                for i in np.flatnonzero(spread(zlib.crc32(raw), n) < limit).tolist():
                    part = raw[i * WINDOW : (i + 1) * WINDOW]
                    if _LETTER.search(part.decode("utf-8", "ignore")):
                        langs.append(lang)
                        raws.append(part.ljust(WINDOW, b"\0"))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(raws, pa.binary())], ["lang", "raw"])

    found = [(r.lang, bytes(r.raw)) for r in rows.mapInArrow(cut, "lang string, raw binary").collect()]
    found += [(r.lang, r.any.t.encode()[:WINDOW].ljust(WINDOW, b"\0")) for r in counts if _LETTER.search(r.any.t)]
    found = sorted(set(found))
    classes = sorted({lang for lang, _ in found})
    if not classes:
        return ByteNet.new([UNKNOWN])
    index = {c: i for i, c in enumerate(classes)}
    net = ByteNet.new(classes)
    if len(classes) > 1:
        net.fit(np.stack([np.frombuffer(raw, np.uint8) for _, raw in found]), np.array([index[lang] for lang, _ in found]))
    return net


def spread(seed: int, n: int) -> np.ndarray:
    """For each of a text's windows a number from 0 to 2**32, evenly spread."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(32)).astype(np.float64)


def predict(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, lang_pred and score (its mean probability over the letters of the whole text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            raws = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            n = len(raws)
            sums = np.zeros((n, len(net.classes)))

            def apply(owners: list[np.ndarray], blocks: list[np.ndarray], sums: np.ndarray = sums) -> None:
                owner, block = np.concatenate(owners), np.concatenate(blocks)
                for at in range(0, len(block), BLOCK):
                    part = block[at : at + BLOCK]
                    weight = 1e-6 + _LETTERS[part].sum(1)
                    np.add.at(sums, owner[at : at + BLOCK], net(part) * weight[:, None])

            owners, blocks, held = [], [], 0
            for i, raw in enumerate(raws):
                w = windows_of(raw)
                owners.append(np.full(len(w), i))
                blocks.append(w)
                held += len(w)
                if held >= 8 * BLOCK:
                    apply(owners, blocks)
                    owners, blocks, held = [], [], 0
            if owners:
                apply(owners, blocks)
            mean = sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)
            best = mean.argmax(1)
            letters = [bool(raw) and _LETTER.search(raw.decode()) is not None for raw in raws]
            pred = [net.classes[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            prob = np.where(letters, mean[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.clip(prob, 0, 1), pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: tuple[int, int] = (4, 2)) -> DataFrame:
    """Train on the rows outside the held-out fold that name a language, then predict every text's language.

    Returns per input row: the id column, held_out (crc32 of the id as text modulo fold[0] is fold[1]; a null id is
    not), lang_pred, score. A null text and one without letters are `und` with score 0; rows whose language is null
    teach nothing; a table without labels predicts `und`; of languages that are equally likely it is the first by name;
    other columns are ignored; an empty table gives no rows.
    """
    out = F.coalesce(crc_of_id(id_col) % fold[0] == fold[1], F.lit(False))
    net = train(docs.where(~out), id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
