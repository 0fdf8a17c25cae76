"""Rows of a query and of its SQL, made comparable."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.6g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return str(value) if hasattr(value, "isoformat") else value


def rows(names: list[str], values) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(v[k]) for k in order) for v in values), key=repr)


def compare(spark, con, run, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same, else what differs."""
    df = run(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    other = rows(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} {sorted(names)}"
    if mine == other:
        return ""
    odd = [(a, b) for a, b in zip(mine, other) if a != b][:2]
    return f"{len(mine)} {len(other)} rows; {str(odd)[:600]}"
