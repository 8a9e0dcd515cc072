"""SQL functions over the engine's own operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import text as T
from docketry.operators.grounding import case_names

#: name, parameters, the column expression over them
SCALARS = {
    "normalize_title": (["t string"], lambda t: T.normalize(t)),
    "trigram_similarity": (["a string", "b string"], lambda a, b: T.trigram_similarity(a, b)),
    "word_similarity": (["a string", "b string"], lambda a, b: T.word_similarity(a, b)),
    "name_skeleton": (["t string"], lambda t: T.skeleton(t)),
    "case_names": (["t string"], lambda t: case_names(t)),
    "find_citations": (["t string"], lambda t: C.find_citations(t)),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to this session's SQL; returns their names."""
    spark.udf.register("normalize_exact", T.fold_ascii_exact)
    return ["normalize_exact"]


def with_scalar(df, name: str, *columns: str, alias: str | None = None):  # noqa: ANN001, ANN201
    """df with a named scalar of the engine over its columns; stays a plain expression."""
    _, body = SCALARS[name]
    return df.withColumn(alias or name, body(*(F.col(c) for c in columns)))
