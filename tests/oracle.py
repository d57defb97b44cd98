"""Run a registered Spark query and its DuckDB oracle and compare them.

Order-insensitive: rows are compared as sorted lists of normalised tuples
with columns in name order.  Doubles must agree exactly (the library's
rounding and money sums are designed to be bit-identical to the oracle).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(float(v)))
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, int):
        return (4, str(v))
    if isinstance(v, decimal.Decimal):
        return (2, repr(float(v)))
    if isinstance(v, dt.datetime):
        return (5, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (6, v.isoformat())
    return (7, str(v))


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, sorted(rows)


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, sorted(rows)


def compare(df, con, sql):
    """Return (ok, message)."""
    scols, srows = spark_rows(df)
    dcols, drows = duck_rows(con, sql)
    if scols != dcols:
        return False, f"columns differ: spark={scols} oracle={dcols}"
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} oracle={len(drows)}"
    for i, (a, b) in enumerate(zip(srows, drows)):
        if a != b:
            return False, f"row {i} differs:\n spark ={a}\n oracle={b}"
    return True, f"{len(srows)} rows equal"
