"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from checks.fixtures import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def difference(spark, con, name: str, sf_dir: str, queries: dict, sql: dict) -> str | None:
    """None when equal, else what differs."""
    df = queries[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in sql:
        return None if got else "no rows"
    cur = con.execute(sql[name])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not want:
        return "comparison SQL gives no rows"
    if got != want:
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; "
            f"only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
        )
    types = [type(v) for r in list(got)[:200] for v in r], [type(v) for r in list(want)[:200] for v in r]
    if Counter(t for t in types[0] if t is not type(None)).keys() != Counter(t for t in types[1] if t is not type(None)).keys():
        return f"types {set(types[0])} != {set(types[1])}"
    return None
