"""Evaluation of resolved and verified queries against an expected set, with release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a release needs.
GATES = [("fake_marked_verified", "==", 0.0), ("traps_resolved", "==", 0.0), ("correct_case_rate", ">=", 0.95)]


def judged(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: whether it is a trap, and whether the result is right.

    expected: query_id, query, kind, expect (array). results: query_id, status, candidates, verification. A trap is
    failed by being resolved or verified. A real query is right if it is resolved to the first expected case, or
    found ambiguous with all expected cases among the candidates.
    """
    rows = expected.join(results.select("query_id", "status", "candidates", "verification"), "query_id", "left")
    ids = F.transform("candidates", lambda c: c["case_id"])
    trap = F.col("kind").startswith("trap_")
    many = F.size("expect") > 1
    right = F.when(many, (F.col("status") == "ambiguous") & (F.size(F.array_except("expect", ids)) == 0)).otherwise((F.col("status") == "resolved") & (ids[0] == F.col("expect")[0]))
    return rows.select(
        "query_id", "query", "kind", "status", trap.alias("trap"),
        (trap & (F.col("status") == "resolved")).alias("trap_resolved"),
        (trap & (F.col("verification") == "verified")).alias("trap_verified"),
        (~trap & F.coalesce(right, F.lit(False))).alias("right"),
    )


def metrics(rows: DataFrame) -> DataFrame:
    real, right = F.count_if(~F.col("trap")), F.count_if("right")
    return rows.agg(
        F.count(F.lit(1)).alias("queries"), real.alias("real"), F.count_if("trap").alias("traps"),
        F.count_if("trap_verified").cast("double").alias("fake_marked_verified"),
        F.count_if("trap_resolved").cast("double").alias("traps_resolved"),
        F.when(real > 0, F.round(right / real, 4)).otherwise(0.0).alias("correct_case_rate"),
    )


def gates(measured: DataFrame, rules: list[tuple[str, str, float]] = GATES) -> DataFrame:
    """(metric, op, target, value, passed) for each gate."""
    rows = measured.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(o).alias("op"), F.lit(t).alias("target"), F.col(m).cast("double").alias("value")) for m, o, t in rules))).alias("g")).select("g.*")
    passed = F.when(F.col("op") == "==", F.col("value") == F.col("target")).when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return rows.withColumn("passed", passed)


def failures(rows: DataFrame) -> DataFrame:
    """Queries that count against a gate."""
    return rows.where(F.col("trap_resolved") | F.col("trap_verified") | (~F.col("trap") & ~F.col("right")))


def report(expected: DataFrame, results: DataFrame, as_json: bool = False) -> tuple[str, int]:
    """Text or JSON of the gates for a command line, and its exit code; the result has one row per gate."""
    rows = gates(metrics(judged(expected, results))).collect()
    code = 0 if all(r.passed for r in rows) else 1
    if as_json:
        import json

        return json.dumps([r.asDict() for r in rows]), code
    return "\n".join(f"{'pass' if r.passed else 'FAIL'} {r.metric} {r.value:g} ({r.op} {r.target:g})" for r in rows), code
