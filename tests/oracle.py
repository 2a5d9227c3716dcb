"""Run a registered query on Spark and its SQL on DuckDB, and compare everything."""

from __future__ import annotations

import collections
import glob
import math
import os

import duckdb

SPARK_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, table) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_plain(row[i]) for i in order) for row in table)


def differences(df, db, sql: str, limit: int = 3) -> list[str]:
    """What differs between the Spark result and the SQL result; empty when nothing does."""
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    types = {d[0]: SPARK_TYPES.get(str(d[1]), str(d[1])) for d in answer.description}
    found = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    mine = dict(df.dtypes)
    found += [f"type of {n}: {mine[n]} != {types[n]}" for n in names if mine[n] != types[n]]
    expected = rows_of(names, answer.fetchall())
    actual = rows_of(df.columns, df.collect())
    if sum(actual.values()) != sum(expected.values()):
        found.append(f"rows {sum(actual.values())} != {sum(expected.values())}")
    if actual != expected:
        found.append(
            f"only in Spark {list((actual - expected).items())[:limit]}, "
            f"only in SQL {list((expected - actual).items())[:limit]} ({sorted(names)})"
        )
    return found
