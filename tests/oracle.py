"""Comparison of a query's rows with those of its SQL on DuckDB."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def available() -> bool:
    return all(os.path.exists(f"{DATA}/{t}.parquet") for t in TABLES)


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def compare(spark, query, sql: str) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = query(spark, DATA).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    if len(got):
        want = want.astype({c: got[c].dtype for c in got.columns}, errors="ignore")
    assert rows_of(got) == rows_of(want)
