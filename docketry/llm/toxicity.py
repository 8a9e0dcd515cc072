"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their beginnings of four and five letters, hashed to 32 bits. The score
is sigmoid(b + sum w + pairwise interactions <v_i, v_j> of the terms present), so a pair of terms can count for
more, or less, than its two weights, and two terms that tell nothing alone can tell all together.

The machine takes two kinds of terms of the training texts. Of all terms, those whose share differs between the two
classes. And of the most frequent terms, whether they tell anything alone or not, those of pairs: every pair is looked
at, and one that goes with what the first kind leaves unexplained brings both its terms in. A worker remembers, for
every word it met, which terms of the machine it has, and for nearly every word that is none.
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

from docketry.llm.common import bounded_sample, crc_of_id, frugal, stored

LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5)

PER_CLASS = 4000  # training texts of each class
RANK = 4  # size of the interaction vectors
LEAST_DOCS = 4  # a term is in so many training texts at least
LEAST_Z = 5.0  # so many standard errors a term's shares in the classes lie apart
MOST_TERMS = 8192  # of these, the most telling
PAIR_TERMS = 4096  # most frequent terms, whose pairs are looked at
PAIR_Z = 7.0  # so many standard errors a pair's texts lie off; there are eight million pairs
RATE, BATCH = 0.03, 128
EPOCHS, DECAY, SPREAD = 60, 0.1, 0.02  # decay: over the number of training texts
STEPS = 400  # small samples get more epochs, so that there are so many
CACHED = 400_000  # words that a worker remembers
THRESHOLD = 0.7


def hashed_terms(word: str) -> list[int]:
    """32-bit hashes of a word and its beginnings."""
    raw = word.encode()
    out = [zlib.crc32(b"w:" + raw)]
    out += [zlib.crc32(f"{n}:{word[:n]}".encode()) for n in BEGINNINGS if len(word) >= n]
    return out


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall(text.lower())) if text else set()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class FactorizationMachine:
    terms: np.ndarray  # hashes, sorted
    bias: float
    weights: np.ndarray
    vectors: np.ndarray  # terms x RANK

    def rows(self, parts: list[np.ndarray]) -> np.ndarray:
        """Scores of documents, each given by the indices of its terms."""
        sizes = np.array([len(p) for p in parts])
        flat = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        linear = np.bincount(owner, self.weights[flat], len(parts))
        v = self.vectors[flat]
        both = np.zeros(len(parts))
        for k in range(self.vectors.shape[1]):
            s = np.bincount(owner, v[:, k], len(parts))
            both += s * s - np.bincount(owner, v[:, k] ** 2, len(parts))
        return sigmoid(self.bias + linear + both / 2)


@dataclass
class Bits:
    """A table of documents x terms, 0 or 1, of which only the bits are held; rows are given as numbers."""

    packed: np.ndarray
    width: int

    @classmethod
    def of(cls, table: np.ndarray) -> Bits:
        return cls(np.packbits(np.asarray(table, np.uint8), axis=1), table.shape[1])

    def __len__(self) -> int:
        return len(self.packed)

    def rows(self, at: np.ndarray | slice) -> np.ndarray:
        return np.unpackbits(self.packed[at], axis=1, count=self.width)

    def columns(self, chosen: np.ndarray) -> Bits:
        out = np.zeros((len(self), -(-len(chosen) // 8)), np.uint8)
        for at in blocks(len(self)):
            out[at] = np.packbits(self.rows(at)[:, chosen], axis=1)
        return Bits(out, len(chosen))


def descend(present: np.ndarray | Bits, labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, decay: float = DECAY, spread: float = SPREAD, seed: int = 7) -> tuple[float, np.ndarray]:
    """Bias and parameters (weight, vector) of each term: Adam on the log loss, with decay.

    present: documents x terms, 0 or 1. With S = present @ (w, V), the gradient of all terms is one product with
    (error, error * S), less the error times the term's own vector.
    """
    present = present if isinstance(present, Bits) else Bits.of(present)
    rng, labels = np.random.default_rng(seed), labels.astype(np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    params = [np.log(np.full(1, share / (1 - share), np.float32)), np.concatenate([np.zeros((present.width, 1)), rng.normal(0, spread, (present.width, rank))], 1).astype(np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(max(epochs, STEPS * BATCH // len(present))):
        order = rng.permutation(len(present))
        for at in range(0, len(order), BATCH):
            x, y = present.rows(order[at : at + BATCH]).astype(np.float32), labels[order[at : at + BATCH]]
            sums = x @ params[1]
            squares = x @ (params[1][:, 1:] ** 2).sum(1)
            error = (sigmoid(params[0] + sums[:, 0] + ((sums[:, 1:] ** 2).sum(1) - squares) / 2) - y) / len(y)
            sums[:, 0] = 1
            slope = x.T @ (error[:, None] * sums)
            slope[:, 1:] -= slope[:, :1] * params[1][:, 1:]
            step += 1
            for p, g, (m, s) in zip(params, (error.sum(keepdims=True), slope + decay / len(present) * params[1]), moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-4)
    return float(params[0][0]), params[1]


def blocks(n: int, size: int = 512) -> Iterator[slice]:
    return (slice(at, at + size) for at in range(0, n, size))


def paired(present: np.ndarray | Bits, residuals: np.ndarray, least: float = PAIR_Z, wide: int = 512) -> np.ndarray:
    """Columns that are in a pair whose texts' residuals sum to `least` standard errors or more.

    The pairs of `wide` columns with all are looked at together: two matrices of so many rows of single-precision
    numbers are held, and a block of texts.
    """
    present = present if isinstance(present, Bits) else Bits.of(present)
    largest = np.zeros(present.width, np.float32)
    for own in blocks(present.width, wide):
        here = np.arange(present.width)[own]
        off, error = (np.zeros((len(here), present.width), np.float32) for _ in range(2))
        for rows in blocks(len(present)):
            x, r = present.rows(rows).astype(np.float32), residuals[rows].astype(np.float32)[:, None]
            mine = r * x[:, own]
            off += mine.T @ x
            error += (r * mine).T @ x
        error += 1
        off /= np.sqrt(error, out=error)
        np.abs(off, out=off)
        off[np.arange(len(here)), here] = 0
        largest[own] = off.max(1, initial=0)
    return np.flatnonzero(largest >= least)


def fit(terms: np.ndarray, present: np.ndarray | Bits, labels: np.ndarray, telling: np.ndarray, frequent: np.ndarray) -> FactorizationMachine:
    """Train on documents x terms (sorted hashes), 0 or 1; telling and frequent mark the columns of each kind."""
    present = present if isinstance(present, Bits) else Bits.of(present)
    labels = np.asarray(labels)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = float(np.log(share / (1 - share)))
    if not len(terms) or not len(labels) or labels.min() == labels.max():
        return FactorizationMachine(np.zeros(0, np.uint32), prior, np.zeros(0), np.zeros((0, RANK)))
    single = np.flatnonzero(telling)
    alone = present.columns(single)
    bias, params = descend(alone, labels, rank=0) if len(single) else (prior, np.zeros((0, 1), np.float32))
    linear = np.concatenate([alone.rows(rows).astype(np.float32) @ params[:, 0] for rows in blocks(len(present))])
    residuals = labels - sigmoid(bias + linear)
    often = np.flatnonzero(frequent)
    chosen = np.union1d(single, often[paired(present.columns(often), residuals)])
    bias, params = descend(present.columns(chosen), labels)
    return FactorizationMachine(terms[chosen], bias, params[:, 0].astype(np.float64), params[:, 1:].astype(np.float64))


class Scorer:
    """Scores whole texts; remembers the weighted terms of words it has met."""

    def __init__(self, model: FactorizationMachine) -> None:
        self.model = model
        self.index = {int(t): i for i, t in enumerate(model.terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def terms(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        known = self.known
        for w in words_of(text):
            hit = known.get(w)
            if hit is None:
                hit = tuple(self.index[h] for h in hashed_terms(w) if h in self.index)
                if len(known) >= CACHED:
                    known.clear()
                known[w] = hit
            if hit:
                found.update(hit)
        return np.array(sorted(found), np.int64)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return self.model.rows([self.terms(t) for t in texts])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> DataFrame:
    """(label, text) of the bounded training sample: chosen among the labels, then joined with the texts."""
    narrow = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__y in (0, 1) and __id is not null")
    chosen = bounded_sample(narrow, "__y", "__id", per_class, "train")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where("__text is not null")
    return texts.join(F.broadcast(chosen), "__id").select("__id", F.col("__y").alias("y"), F.col("__text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> FactorizationMachine:
    """Fit on at most about per_class labelled texts of each class.

    Terms are hashed and counted on the executors. What is collected are at most MOST_TERMS + PAIR_TERMS hashes and one
    bit for each of them and each training text, about 2 * per_class * 1536 bytes (12 MB) whatever the texts' lengths.
    Rows that repeat an id are one training text, the first by its terms.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.unique(np.array([h for w in words_of(t.as_py()) for h in hashed_terms(w)], np.int64)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "y", "terms"])

    rows = training_rows(docs, labels, id_col, text_col, label_col, per_class).mapInArrow(hashes, "id string, y int, terms array<long>")
    rows = stored(rows.groupBy("id", "y").agg(F.min("terms").alias("terms")), "terms")
    n, ones = (int(x or 0) for x in rows.agg(F.count(F.lit(1)), F.sum("y")).first())
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).where(F.col("n") >= LEAST_DOCS)
    p = F.col("n") / max(1, n)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / max(1, ones) + 1 / max(1, n - ones)))
    counts = stored(counts.withColumn("z", F.abs(F.col("ones") / max(1, ones) - (F.col("n") - F.col("ones")) / max(1, n - ones)) / error), "counts")
    telling = {r.term for r in counts.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(MOST_TERMS).collect()}
    frequent = {r.term for r in counts.orderBy(F.desc("n"), "term").limit(PAIR_TERMS).collect()}
    terms = np.array(sorted(telling | frequent), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.packbits(np.isin(shared.value, t.values.to_numpy(), assume_unique=True)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "y", "bits"])

    found = sorted(rows.mapInArrow(bits, "id string, y int, bits binary").collect())
    packed = np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -(-len(terms) // 8))
    labels_of = np.array([r.y for r in found], np.int64)
    del found
    marked = (np.array([t in kind for t in terms.tolist()], bool) for kind in (telling, frequent))
    return fit(terms, Bits(packed, len(terms)), labels_of, *marked)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """The id column and the toxicity, 0 to 1, of each whole text; a null or empty text is scored by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_TERMS + PAIR_TERMS rows of RANK + 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(batch.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, score double").select(F.col("id").alias(id_col), F.col("score").alias(out))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: tuple[int, int] = (3, 1), threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows outside the held-out fold, then score every text.

    Returns per input row: the id column, held_out (crc32 of the id as text modulo fold[0] is fold[1]; a null id is
    not), score, predicted. Null texts are scored as empty ones; labels other than 0 and 1 are ignored, as are
    other columns; without labels of both classes the score is the classes' smoothed share; an empty table gives
    no rows.
    """
    out = F.coalesce(crc_of_id(id_col) % fold[0] == fold[1], F.lit(False))
    model = train(docs, labels.where(~out), id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
