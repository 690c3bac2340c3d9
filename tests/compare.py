"""Compare a Spark frame with a DuckDB statement over the same parquet tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, types, row counts and values agree (doubles to 1e-9)."""
    relation = con.sql(sql)
    names, types = list(relation.columns), [str(t) for t in relation.types]
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns: only spark {sorted(set(df.columns) - set(names))}, only sql {sorted(set(names) - set(df.columns))}"]
    spark_types = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    for name, kind in zip(names, types):
        if spark_types[name] != kind:
            found.append(f"type of {name}: spark {spark_types[name]}, sql {kind}")
    order = sorted(names)
    place = [names.index(n) for n in order]
    expected = _sorted([tuple(_plain(r[i]) for i in place) for r in relation.fetchall()])
    actual = _sorted([tuple(_plain(x) for x in r) for r in df.select(*[f"`{n}`" for n in order]).collect()])
    if len(expected) != len(actual):
        found.append(f"rows: spark {len(actual)}, sql {len(expected)}")
        return found
    bad = 0
    for left, right in zip(actual, expected):
        for name, x, y in zip(order, left, right):
            same = x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))
            if not same:
                bad += 1
                if bad <= 3:
                    found.append(f"{name}: spark {x!r}, sql {y!r} in {left}")
                break
    if bad > 3:
        found.append(f"{bad} rows differ")
    return found
