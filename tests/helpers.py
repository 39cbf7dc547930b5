"""Compare a query with its SQL on DuckDB over the same files."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())


def assert_same(spark, query, sql: str, sf_dir: str = SF) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    columns, ours = rows_of(query(spark, sf_dir))
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted("|".join(plain(r[i]) for i in at) for r in found.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
