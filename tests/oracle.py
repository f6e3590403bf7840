"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb


def same(spark, sf_dir: str, query, sql: str) -> tuple[list, list]:
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(r) for r in frame.select([frame[c] for c in columns]).collect()]
    relation = connection.sql(sql)
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    theirs = [tuple(r[k] for k in at) for r in relation.fetchall()]
    return sorted(map(plain, ours), key=repr), sorted(map(plain, theirs), key=repr)


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value
