"""Spark result vs DuckDB oracle: row count, column names and an
order-insensitive comparison of the values (columns sorted by name)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _key(row):
    return tuple((x is None, repr(type(x).__name__) if x is not None else "", repr(x)) for x in row)


def canon(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return cols, sorted(out, key=_key)


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    sc, sr = canon(s_cols, s_rows)
    dc, dr = canon(d_cols, d_rows)
    out = {"rows": (len(sr), len(dr)), "cols_match": sc == dc, "cols": (sc, dc)}
    out["values_match"] = out["cols_match"] and sr == dr
    if out["cols_match"] and not out["values_match"]:
        diffs = [(a, b) for a, b in zip(sr, dr) if a != b]
        out["first_diffs"] = diffs[:3]
    out["ok"] = out["values_match"] and len(sr) == len(dr)
    return out
