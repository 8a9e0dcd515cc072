"""Constraints as queries: each returns the rows, or keys, that break it. Null passes checks, as in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_violations(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; keys with a null part are all different."""
    whole = table.dropna(subset=keys)
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def orphans(table: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return table.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def domain_violations(table: DataFrame, column: str, domain: list) -> DataFrame:
    return table.where(~F.col(column).isin(domain))


def range_violations(table: DataFrame, column: str, low, high) -> DataFrame:  # noqa: ANN001
    return table.where(~F.col(column).between(low, high))


def check_violations(table: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false."""
    return table.where(~rule)


def cascade(table: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """The rows that stay after their parents in `gone` are deleted with everything below them."""
    return table.join(gone.select(F.col(gone_key).alias(key)), key, "left_anti").select(table.columns)


def set_null(table: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """All rows, with the key null where its parent is in `gone`."""
    marked = gone.select(F.col(gone_key).alias(key)).distinct().withColumn("__gone", F.lit(True))
    joined = table.join(marked, key, "left")
    return joined.withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).select(table.columns)


# The rules of the persistent model, by table.
KEYS = {
    "sources": [["name"]],
    "cases": [["slug"]],
    "case_aliases": [["case_id", "normalized"]],
    "citations": [["canonical"], ["case_id", "reporter_key"]],
    "source_documents": [["source_id", "external_id", "sha256"]],
    "opinions": [["case_id", "ordinal"]],
    "paragraphs": [["case_id", "ordinal"]],
    "briefs": [["case_id", "depth", "version"]],
}


def model_rules() -> dict[str, dict[str, Column]]:
    """Row rules of the persistent model: by table, name and condition."""
    return {
        "cases": {
            "bench_strength_positive": F.col("bench_strength") > 0,
            "verified_has_time": (F.col("verification_status") != "verified") | F.col("verified_at").isNotNull(),
            "judges_fit_bench": (F.size("judges") == F.col("bench_strength")) | F.col("bench_strength").isNull() | F.col("judges").isNull(),
        },
        "source_documents": {"ocr_quality_range": F.col("ocr_quality").between(0, 1)},
        "citing_edges": {
            "no_self_loop": F.col("citing_case_id") != F.col("cited_case_id"),
            "confidence_range": F.col("confidence").between(0, 1),
            "reviewed_has_reviewer": (F.col("review_status") != "reviewed") | F.col("reviewed_by").isNotNull(),
        },
    }


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rule, n) of every broken rule of the model among the tables given."""
    out = None
    for name, df in tables.items():
        parts = [(f"unique({', '.join(k)})", unique_violations(df, k)) for k in KEYS.get(name, []) if set(k) <= set(df.columns)]
        parts += [(rule, check_violations(df, c)) for rule, c in model_rules().get(name, {}).items()]
        for rule, broken in parts:
            row = broken.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "n")
            out = row if out is None else out.unionByName(row)
    return out.where("n > 0")
