"""Comparison of a Spark result with the ANSI twin's, as bags of rows with columns ordered by name."""

from __future__ import annotations

import math

import duckdb

from auditframe.sources.bindings import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(_value(v) for v in value)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in data), key=repr)


_FAMILIES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
}


def difference(df, connection: duckdb.DuckDBPyConnection, oracle: str) -> str | None:
    """What differs, or None."""
    relation = connection.sql(oracle)
    types = {c: str(t) for c, t in zip(relation.columns, relation.types, strict=True)}
    expected_types = {c: _FAMILIES.get(t, t) for c, t in df.dtypes}
    if types != expected_types:
        wrong = {c: (expected_types.get(c), types.get(c)) for c in types.keys() | expected_types.keys()}
        return f"columns differ (Spark, ANSI): { {c: t for c, t in wrong.items() if t[0] != t[1]} }"
    got = rows(df.columns, df.collect())
    expected = rows(relation.columns, relation.fetchall())
    if got == expected:
        return None
    extra = [r for r in got if r not in set(expected)][:2] if len(got) < 20000 else []
    missing = [r for r in expected if r not in set(got)][:2] if len(got) < 20000 else []
    return f"{len(got)} rows against {len(expected)}; only Spark {str(extra)[:600]}; only ANSI {str(missing)[:600]}"
