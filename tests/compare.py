"""Spark's rows against DuckDB's."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def tables(sf_dir: str):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{source}'")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def agree(df, sql: str, sf_dir: str) -> None:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    relation = tables(sf_dir).sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
