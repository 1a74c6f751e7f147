"""Whole results of a Spark query and of SQL in DuckDB, compared as sorted rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

from pyspark.sql import DataFrame


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (int(x) if x.is_integer() else float(f"{x:.12g}"))
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted(names), rows_of(names, out.fetchall())


def check(df: DataFrame, sql: str, sf_dir: str) -> None:
    names, rows = spark_rows(df)
    want_names, want = sql_rows(sql, sf_dir)
    assert names == want_names
    assert len(rows) == len(want), (len(rows), len(want))
    wrong = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
