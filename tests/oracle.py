"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, Decimal) and value == value.to_integral_value():
        return int(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> str | None:
    """None when columns and rows agree, otherwise what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(zip(names, [str(d[1]) for d in rel.description]))
    expected, got = _rows(names, rel.fetchall()), _rows(df.columns, df.collect())
    if expected != got:
        return (
            f"rows {sum(got.values())} != {sum(expected.values())}; "
            f"only here {list((got - expected).items())[:3]}, "
            f"only there {list((expected - got).items())[:3]}, types {types}"
        )
    return None
