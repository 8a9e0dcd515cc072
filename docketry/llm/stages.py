"""The operators as pipeline stages: documents in, the same columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import mixing, neardup, packing, quality, toxicity
from docketry.llm.common import crc_of_id
from docketry.llm.queries import byte_bpe_encoder, mix_levels
from docketry.session import bound_batches, ship, table


def _ready(spark: SparkSession) -> None:
    """Executors have the package, and batches for their workers are bounded in bytes: all stages share the executors."""
    ship(spark)
    bound_batches(spark)


def _scored(docs: DataFrame, score) -> DataFrame:  # noqa: ANN001
    """docs with the column __score; every row is scored by itself, in place, so ids may repeat or be null."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("__text"))
    return score(packed, "__row", "__text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learned from the labels of documents that are in `docs`.

    Null and empty texts are scored as texts without terms; rows that repeat are scored each; without labels of both
    classes all scores are the same. An empty table gives an empty table. Columns are those of docs, whatever their names.
    """
    _ready(spark)
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(F.coalesce(crc_of_id("doc_id") % 3 != 1, F.lit(True))))
    return _scored(docs, lambda d, i, t: toxicity.score(d, model, i, t)).where(F.col("score") < toxicity.THRESHOLD).select("__row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches the threshold; nulls, repeats, empty tables and names as in the toxicity stage."""
    _ready(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(F.coalesce(crc_of_id("doc_id") % 5 != 0, F.lit(True))))
    return _scored(docs, lambda d, i, t: quality.score(d, model, i, t)).where(F.col("score") >= quality.THRESHOLD).select("__row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component (word shingles of five): the one with the smallest id.

    Documents without an id all stay; where rows repeat an id, one row of each of its texts stays. Null and empty
    texts link with nothing.
    """
    _ready(spark)
    return neardup.without_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budget, once for each epoch that takes them; tokens are words.

    The last document of a leaf's partial epoch is cut to the words left, and its n_chars with it. Texts without words
    take nothing of the budget and come with whole epochs; null languages and sources are nodes of their own.
    """
    _ready(spark)
    mixed = mixing.mix_documents(docs, mix_levels())
    return mixed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a null or empty text is its end id alone, and each row is a document of its own."""
    _ready(spark)
    return packing.pack(docs, byte_bpe_encoder(packing.Encoder))
