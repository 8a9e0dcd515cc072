"""The corpus pipeline: documents without toxic and poor ones, one of each group of near copies, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketry.llm import stages
from docketry.llm.common import stored
from docketry.session import table

STAGES = [
    ("toxicity", stages.toxicity_stage),
    ("quality classifier", stages.quality_stage),
    ("MinHash near-dedup", stages.near_duplicate_stage),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: The classifiers have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of sf_dir; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return docs
