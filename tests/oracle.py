"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import glob
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return float(repr(v)) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


KINDS = {
    "byte": "int", "short": "int", "integer": "int", "int": "int", "long": "int", "bigint": "int", "hugeint": "huge", "smallint": "int",
    "tinyint": "int", "double": "float", "float": "float", "varchar": "str", "string": "str", "boolean": "bool", "date": "date",
    "timestamp": "ts", "timestamp_ntz": "ts",
}


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in cursor.description}
    want = canonical(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    for f in df.schema.fields:
        mine = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if mine != kinds[f.name]:
            return f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}"
    got = canonical(df.columns, df.collect())
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first\n  spark  {bad[0][0]}\n  duckdb {bad[0][1]}\n  columns {sorted(names)}"
    return None
