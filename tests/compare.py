"""Run a query in Spark and its SQL twin in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows in a total order, numbers by value."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def difference(spark, query, sql: str, folder: str) -> str | None:
    """``None`` when both sides agree, else the first differences."""
    df = query(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(*oracle_rows(sql, folder))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w or [type(x) for x in g] != [type(x) for x in w]]
    return f"{len(wrong)} rows differ, e.g. {wrong[:3]}" if wrong else None
