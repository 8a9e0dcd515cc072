"""Quality by votes of the nearest labelled texts in a latent-semantic space.

A text's terms are its words, the shapes of its words (case, digits, other signs), pieces of three signs of long runs
without blanks, and how often words and lines return. Their hashed counts are damped, weighted by rarity and reduced to
a few latent dimensions by a singular value decomposition of the training texts: one of the words, one of the rest,
which lie side by side with weights. The labelled vectors are broadcast; every document is compared with all of them,
in blocks, and takes the labels of the nearest, weighted by cosine.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import bounded_sample, crc_of_id, frugal

PER_CLASS = 2000  # labelled vectors of each class
BUCKETS = 4096  # of hashed terms, and as many again for words
DIMENSIONS = 32  # of either decomposition
WORDS = 0.25  # weight of the words' dimensions beside the others'
LONG = 24  # runs of more signs also count by pieces of three
POWER = 8  # iterations of the decomposition
NEIGHBOURS = 15
BLOCK = 256  # documents that are compared at once
CACHED = 400_000
THRESHOLD = 0.3

_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A for capitals, a for other letters, 9 for digits, other signs as they are; runs are one sign."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", out)


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Counts:
    """Hashed term counts of whole texts; remembers the shapes of words it has met."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.repeat, self.again = bucket("~repeat"), bucket("~again")
        self.lines, self.short = bucket("~line again"), bucket("~few words")
        self.empty = bucket("~no words")

    def buckets_of(self, word: str) -> tuple[int, ...]:
        """Buckets of a word: its shape's, then its own; long runs have those of their pieces too."""
        if len(word) > LONG:
            pieces = Counter(word[i : i + 3].lower() for i in range(len(word) - 2))
            return (bucket("s:" + shape(word)), *(BUCKETS + bucket("p:" + p) for p in pieces))
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            hit = self.known[word] = (bucket("s:" + shape(word)), BUCKETS + bucket("w:" + word.lower()))
        return hit

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and damped counts. A null text is an empty one; a text without words has a term that says so."""
        words = text.split() if text else []
        if not words:
            return np.array([self.empty]), np.ones(1)
        seen, n = Counter(words), len(words)
        known, of = self.known, self.buckets_of
        hits = [known.get(w) or of(w) for w in seen]
        times = np.fromiter(seen.values(), np.float64, len(seen))
        flat = np.fromiter(chain.from_iterable(hits), np.int64)
        out = np.bincount(flat, np.repeat(times, np.fromiter(map(len, hits), np.int64, len(hits))), 2 * BUCKETS)
        out[self.repeat] += sum(map(eq, words, words[1:]))
        out[self.again] += n - len(seen)
        lines = text.split("\n")
        out[self.lines] += n * (1 - len(set(lines)) / len(lines))
        if n < 20:
            out[self.short] += n
        keys = np.flatnonzero(out)
        return keys, np.sqrt(out[keys] / n)


@dataclass
class Votes:
    """Labelled texts in the latent space."""

    project: np.ndarray  # 2 * BUCKETS x dimensions, rarity and weights included
    split: int  # dimensions of shapes and counters; those of words follow
    vectors: np.ndarray  # labelled texts x dimensions, unit length
    labels: np.ndarray

    def embed(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors: the two parts by themselves, then together. A part without a known term is zero."""
        out = np.zeros((len(counts), self.project.shape[1]))
        for i, (keys, values) in enumerate(counts):
            out[i] = values @ self.project[keys]
        out[:, : self.split] = unit(out[:, : self.split])
        out[:, self.split :] = WORDS * unit(out[:, self.split :])
        return unit(out)

    def __call__(self, counts: list[tuple[np.ndarray, np.ndarray]], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, by cosine; exact, as all are compared.

        Of labelled texts that are equally near, all vote that are as near as the last of the nearest. A text without
        any known term is as near to one as to another, so its score is the labels' mean.
        """
        if not len(self.vectors):
            return np.full(len(counts), 0.5)
        near = np.round(self.embed(counts) @ self.vectors.T, 9)
        k = min(neighbours, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        weight = np.where(near >= last, np.maximum(near, 1e-6) ** 4, 0)
        return np.clip((weight * self.labels).sum(1) / weight.sum(1), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent(dense: np.ndarray, dimensions: int) -> np.ndarray:
    """Projection of counts (texts x buckets) to the latent dimensions, rarity included. The counts are used up."""
    width, used = dense.shape[1], np.flatnonzero(dense.any(0))
    weighted = dense[:, used] if len(used) < width else dense
    del dense
    rarity = np.log((1 + len(weighted)) / (1 + np.count_nonzero(weighted > 0, axis=0))) + 0.2
    for at in range(0, len(weighted), BLOCK):
        weighted[at : at + BLOCK] = unit(weighted[at : at + BLOCK] * rarity.astype(np.float32))
    # Subspace iteration for the largest singular vectors, a few more than are wanted.
    basis = np.random.default_rng(3).normal(size=(len(used), min(len(used), dimensions + 16))).astype(np.float32)
    for _ in range(POWER):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, turn = np.linalg.svd(weighted @ basis, full_matrices=False)
    basis = (basis @ turn.T)[:, :dimensions]
    out = np.zeros((width, dimensions))
    out[used, : basis.shape[1]] = rarity[:, None] * basis
    return out


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dimensions: int = DIMENSIONS) -> Votes:
    if not counts:
        return Votes(np.zeros((2 * BUCKETS, 2)), 1, np.zeros((0, 2)), np.zeros(0))

    def dense(low: int) -> np.ndarray:
        """The counts of half the buckets; only one half is held at a time."""
        out = np.zeros((len(counts), BUCKETS), np.float32)
        for i, (k, v) in enumerate(counts):
            own = (k >= low) & (k < low + BUCKETS)
            out[i, k[own] - low] = v[own]
        return out

    project = np.zeros((2 * BUCKETS, 2 * dimensions))
    project[:BUCKETS, :dimensions] = latent(dense(0), dimensions)
    project[BUCKETS:, dimensions:] = latent(dense(BUCKETS), dimensions)
    model = Votes(project, dimensions, np.zeros((0, 2 * dimensions)), np.asarray(labels, np.float64))
    model.vectors = model.embed(list(counts))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Votes:
    """Fit on at most about per_class labelled texts of each class; their terms are counted on the executors.

    What is collected are at most 2 * BUCKETS counts of each training text, whatever its length. Rows that repeat an
    id are one training text, the first by its counts.
    """
    narrow = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y in (0, 1) and __id is not null")
    chosen = bounded_sample(narrow, "__y", "__id", per_class, "vote")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            made = [counts(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), *(pa.array([m[j].astype(kind).tobytes() for m in made], pa.binary()) for j, kind in ((0, "<u2"), (1, "<f4")))], ["id", "y", "k", "v"])

    rows = texts.join(F.broadcast(chosen), "__id").select("__id", "__y", "text").mapInArrow(count, "id string, y int, k binary, v binary")
    found = sorted(rows.groupBy("id", "y").agg(F.min(F.struct("k", "v")).alias("c")).select("id", "y", "c.k", "c.v").collect())
    return fit([(np.frombuffer(r.k, "<u2").astype(np.int64), np.frombuffer(r.v, "<f4").astype(np.float64)) for r in found], np.array([r.y for r in found]))


def score(docs: DataFrame, model: Votes, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """The id column and the quality, 0 to 1, of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PER_CLASS and BUCKETS bound it to a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                scores = shared.value([counts(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, score double").select(F.col("id").alias(id_col), F.col("score").alias(out))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: tuple[int, int] = (5, 0), threshold: float = THRESHOLD) -> DataFrame:
    """Vote with the labelled rows outside the held-out fold on every text.

    Returns per input row: the id column, held_out (crc32 of the id as text modulo fold[0] is fold[1]; a null id is
    not), score, predicted. Null texts are scored as empty ones, which are like other labelled texts without words;
    labels other than 0 and 1 are ignored, as are other columns; without any label every score is 0.5; an empty
    table gives no rows.
    """
    out = F.coalesce(crc_of_id(id_col) % fold[0] == fold[1], F.lit(False))
    model = train(docs, labels.where(~out), id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
