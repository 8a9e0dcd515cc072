"""Token counts by a map-side two-tier lookup.

A text is cut into pre-tokens that no token of the vocabulary crosses. Tier one is a broadcast table of the
corpus's frequent pre-tokens and their lengths in tokens; tier two is a bounded cache in each Python worker,
filled by encoding what it lacks. No pre-token is a key of a shuffle: to make tier one, each task sums its texts up in
a summary of fixed size, and summaries are merged in a tree, FAN of them at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import map_groups, stored

#: A run of spaces with the run of others behind it. The vocabulary has no piece in which a space follows another
#: character, so no merge crosses the start of such a run.
PRE_TOKEN = re.compile(r" *[^ ]+| +")

FREQUENT = 32_768  # pre-tokens in the broadcast table
SUMMARY = 8_192  # heavy hitters in a task's summary; a merged one holds FREQUENT at most
FAN = 16  # summaries that are merged at once
TRACKED = 200_000  # pre-tokens that a task counts at once; beyond it the rare half goes
CACHED = 300_000  # pre-tokens in a worker's own cache
LONGEST = 64  # longer pre-tokens are encoded each time and never kept


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text as the library sees it: a space in front, and the space mark is a space."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " "))


class PieceCounter:
    """Counts the tokens of a sentencepiece model that keeps blanks and adds one in front."""

    def __init__(self, model_path: str, frequent: dict[str, int] | None = None, cached: int = CACHED) -> None:
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.base = {" ": 1} | (frequent or {})
        self.known, self.cached = dict(self.base), cached

    def lengths(self, units: list[str]) -> list[int]:
        # Each unit begins with a space, which the encoder adds by itself.
        return [len(x) for x in self.encoder.encode([u[1:] for u in units], num_threads=1)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        units = pre_tokens(text)
        found = list(map(self.known.get, units))
        if None not in found:
            return sum(found)
        missed = Counter(u for u, n in zip(units, found, strict=True) if n is None)
        lengths = self.lengths(list(missed))
        if len(self.known) + len(missed) > len(self.base) + self.cached:
            self.known = dict(self.base)
        self.known.update((u, n) for u, n in zip(missed, lengths, strict=True) if len(u) <= LONGEST)
        return sum(n for n in found if n is not None) + sum(n * k for n, k in zip(lengths, missed.values(), strict=True))


SUMMARY_SQL = "place long, units array<string>, counts array<long>"


def summary(place: int, seen: Counter[str], most: int) -> pa.RecordBatch:
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([[u for u, _ in top]], pa.list_(pa.string())), pa.array([[n for _, n in top]], pa.list_(pa.int64()))], ["place", "units", "counts"])


def frequent_pre_tokens(docs: DataFrame, text_col: str = "text", most: int = FREQUENT, fan: int = FAN) -> list[str]:
    """The corpus's most frequent pre-tokens. Every text counts; a summary has at most `most` pre-tokens of LONGEST signs."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(u for u in pre_tokens(text.as_py() or "") if len(u) <= LONGEST)
                if len(seen) > TRACKED:
                    seen = Counter(dict(seen.most_common(TRACKED // 2)))
        yield summary(TaskContext.get().partitionId(), seen, min(most, SUMMARY))

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for units, counts in zip(table.column("units").to_pylist(), table.column("counts").to_pylist(), strict=True):
            for u, n in zip(units, counts, strict=True):
                seen[u] += n
        yield summary(table.column("place")[0].as_py(), seen, most)

    found = stored(docs.select(F.col(text_col).alias("text")).where("text is not null and text <> ''").mapInArrow(heavy, SUMMARY_SQL), "summaries")
    left = found.count()
    while left > 1:
        left = -(-(found.agg(F.max("place")).first()[0] + 1) // fan)
        found = stored(map_groups(found.withColumn("place", F.expr(f"place div {fan}")), ["place"], merge, SUMMARY_SQL), "summaries")
    rows = found.collect()  # one summary
    return rows[0].units if rows else []


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """Tokens of each whole text as the sentencepiece model at model_path gives them.

    Returns one row per input row: the id column, n_bytes, n_tokens, over_limit (n_tokens > limit). A null text
    counts as empty (0 bytes, 0 tokens); ids may be null or repeat; other columns are ignored, whatever their
    names. An empty table gives no rows. Counts never depend on the table of frequent pre-tokens. model_path must exist on every machine.
    """
    import sentencepiece

    spark = docs.sparkSession
    units = frequent_pre_tokens(docs, text_col, frequent) if frequent else []
    encoder = sentencepiece.SentencePieceProcessor(model_file=model_path)
    lengths = [len(x) for x in encoder.encode([u[1:] for u in units], num_threads=1)] if units else []
    # Two compact columns; at most FREQUENT * LONGEST characters, so the broadcast is a few MB whatever the input.
    tier_one = spark.sparkContext.broadcast((units, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model_path, {u: n for u, n in zip(*tier_one.value, strict=True) if u != " "})
        for batch in batches:
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())), 0).cast(pa.int64())
            n_tokens = pa.array([counter.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
