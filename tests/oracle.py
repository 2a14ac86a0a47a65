"""Spark rows against DuckDB rows: names, types, and values as multisets."""

import math
from collections import Counter
from pathlib import Path

import duckdb

TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT": "float"}


def connection(folder):
    con = duckdb.connect()
    con.execute("SET threads TO 2")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(df, con, sql):
    """None, or what differs."""
    rel = con.sql(sql)
    theirs = sorted(zip(rel.columns, map(str, rel.types), strict=True))
    ours = sorted(df.dtypes)
    if [n for n, _ in ours] != [n for n, _ in theirs]:
        return f"columns {ours} and {theirs}"
    off = [(n, t, u) for (n, t), (_, u) in zip(ours, theirs, strict=True) if TYPES.get(u, u) != t]
    names = [n for n, _ in ours]
    a = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if a != b:
        return f"{sum(a.values())} rows and {sum(b.values())}; ours only {list((a - b).items())[:3]}; theirs only {list((b - a).items())[:3]}"
    return f"types {off}" if off else None
