"""Spark-vs-DuckDB comparison used by the tests and ``tools/check_oracles.py``.

Mirrors the driver's gate: same column names, same row count, and the same
order-insensitive multiset of rows (doubles compared after rounding).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, digits)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), digits)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def compare(spark_df, con, sql: str, digits: int = 6):
    """Return (ok, message)."""
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    s_n = sorted((tuple(_norm(r[i], digits) for i in si) for r in s_rows), key=_key)
    d_n = sorted((tuple(_norm(r[i], digits) for i in di) for r in d_rows), key=_key)
    if len(s_n) != len(d_n):
        return False, f"row count spark={len(s_n)} duck={len(d_n)}"
    bad = [(a, b) for a, b in zip(s_n, d_n) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ; first spark={bad[0][0]} duck={bad[0][1]} cols={order}"
    return True, f"{len(s_n)} rows match"


SPARK_TO_DUCK = {"array<double>": "DOUBLE[]", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
                 "smallint": "SMALLINT", "float": "FLOAT"}


def type_mismatches(spark_df, con, sql: str) -> list[tuple[str, str, str]]:
    """Columns whose Spark type and oracle type differ (a driver may compare schemas strictly)."""
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    out = []
    for f in spark_df.schema.fields:
        s = f.dataType.simpleString()
        if SPARK_TO_DUCK.get(s, s) != duck.get(f.name):
            out.append((f.name, s, duck.get(f.name)))
    return out
