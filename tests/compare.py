"""Runs a query on Spark and its SQL on DuckDB and compares rows, as the driver does."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def differences(spark, con, sf_dir: str, query, sql: str) -> list[str]:
    """What differs: columns, types of values, row counts or rows."""
    df = query(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    rel = con.sql(sql)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    out = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    out += [f"{c}: {t} and {types[c]}" for c, t in df.dtypes if kind.get(t, types[c]) != types[c]]
    names = sorted(df.columns)
    key = lambda r: tuple(plain(r[c]) for c in names)
    a, b = sorted(map(key, got), key=repr), sorted(map(key, want), key=repr)
    if len(a) != len(b):
        out.append(f"{len(a)} rows and {len(b)}")
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b, strict=False) if x != y]
        out.append(f"{len(wrong)} rows differ: {names} {wrong[:2]}")
    return out
