"""Order-insensitive comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def ordered(rows, columns):
    picked = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in picked) for row in rows), key=repr)


def differences(df, connection, sql: str) -> str | None:
    """None when columns, types and rows agree, else what differs."""
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = {f.name: f.dataType.simpleString() for f in df.schema}
    off = {n: (mine[n], kinds[n]) for n in names if mine[n] != kinds[n]}
    if off:
        return f"types {off}"
    expected = ordered(result.fetchall(), names)
    got = ordered(df.collect(), df.columns)
    if not expected:
        return "the expected result is empty"
    if len(got) != len(expected):
        return f"{len(got)} rows != {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]}" if wrong else None
