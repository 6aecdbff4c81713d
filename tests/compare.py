"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return f"bool:{value}"
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if value is None else f"{type(value).__name__}:{value}"


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


_KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    found = con.execute(sql)
    expected_columns = {d[0]: str(d[1]) for d in found.description}
    expected = canonical(list(expected_columns), found.fetchall())
    actual_columns = {f.name: _KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if sorted(actual_columns) != sorted(expected_columns):
        return [f"columns {sorted(actual_columns)} != {sorted(expected_columns)}"]
    for name, kind in actual_columns.items():
        if kind != expected_columns[name].split("(")[0].replace("VARCHAR", "VARCHAR"):
            problems.append(f"type of {name}: {kind} != {expected_columns[name]}")
    if len(actual) != len(expected):
        problems.append(f"rows {len(actual)} != {len(expected)}")
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    if bad:
        problems.append(f"{len(bad)} rows differ, first: {bad[0]}")
    return problems
