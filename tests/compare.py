"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        if name in TABLES:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between the two results; empty when they agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    got = rows_of(spark_df.columns, spark_df.collect())
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} != {sorted(names)}")
    if len(want) != len(got):
        problems.append(f"rows {len(got)} != {len(want)}")
    ordered = sorted(names)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not problems and bad:
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(ordered, g, w) if a != b]
        problems.append(f"{len(bad)} of {len(want)} rows differ, first: {diff}")
    elif problems and want and got:
        problems.append(f"first got {got[0]} want {want[0]}")
    return problems
