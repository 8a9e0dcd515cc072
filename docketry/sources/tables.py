"""Scans and sinks: seed and evaluation files, page texts, source records, JSON rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.entities import case_violations
from docketry.operators.layout import page_lines

CASES = "case_ord int, id string, title string, year int, bench_strength int, cited_by_count int, checked_against_source boolean, aliases array<string>, citations array<string>"
EXPECTED = "query_id int, query string, kind string, expect array<string>, note string"
RECORDS = "case_id string, rec_ord int, source string, origin string, official boolean, title string, retrieved_at timestamp, decision_date date, judges array<string>, citations array<string>, url string"


class InvalidSeed(ValueError):
    """The entity table breaks its rules."""


def _yaml(text: str) -> list[dict]:
    import yaml

    data = yaml.safe_load(text) or []
    return data if isinstance(data, list) else next((v for v in data.values() if isinstance(v, list)), [])


def cases_from_yaml(spark: SparkSession, text: str, today: dt.date | None = None) -> DataFrame:
    """The entity table of a YAML seed, checked: unique ids, readable and plausible citations, each of one case only,
    one per reporter. The seed is a small file that the driver holds."""
    rows = [
        (i, r["id"], r["title"], int(r["year"]), r.get("bench_strength"), r.get("cited_by_count"), bool(r.get("checked_against_source", False)), list(r.get("aliases") or []), list(r.get("citations") or []))
        for i, r in enumerate(_yaml(text))
    ]
    cases = spark.createDataFrame(rows, CASES)
    broken = case_violations(cases, today or dt.date.today()).limit(20).collect()
    if broken:
        raise InvalidSeed("; ".join(f"{b.rule}: {b.key} ({b.detail})" for b in broken))
    return cases


def expected_from_yaml(spark: SparkSession, text: str) -> DataFrame:
    """The labelled queries of a YAML evaluation set; `expect` may be one id or a list."""
    rows = []
    for i, r in enumerate(_yaml(text)):
        expect = r.get("expect") or []
        rows.append((i, r["query"], r["kind"], [expect] if isinstance(expect, str) else list(expect), r.get("note")))
    return spark.createDataFrame(rows, EXPECTED)


def pages_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines (doc_id, page_no, line_no, raw) of text files, each a document with form feeds between pages."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return page_lines(files)


class RecordSource:
    """Where source records come from: anything that gives the records of a table of cases."""

    def records(self, cases: DataFrame) -> DataFrame:
        raise NotImplementedError


class TableRecords(RecordSource):
    """Records of a table, by case."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def records(self, cases: DataFrame) -> DataFrame:
        return self.table.join(cases.select(F.col("id").alias("case_id")), "case_id", "left_semi")


class NoRecords(RecordSource):
    """No records at all: nothing can be verified."""

    def records(self, cases: DataFrame) -> DataFrame:
        return cases.sparkSession.createDataFrame([], RECORDS)


def json_rows(rows: DataFrame, key: str, column: str = "json") -> DataFrame:
    """The key and everything else as one JSON text per row."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias(column))
