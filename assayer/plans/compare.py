"""Run registered queries next to their SQL and compare the rows."""

from __future__ import annotations

import math
import time

from assayer.plans.adapters import TABLES


def duckdb_connection(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, connection, query, sql, sf_dir) -> dict:
    started = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - started
    result = {"rows": len(got), "seconds": round(seconds, 2)}
    if sql is None:
        return {**result, "match": None}
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    left, right = rows_of(df.columns, got), rows_of(names, want)
    result["match"] = sorted(df.columns) == sorted(names) and left == right
    if not result["match"]:
        result["columns"] = (sorted(df.columns), sorted(names))
        result["counts"] = (len(left), len(right))
        only_left = [r for r in left if r not in set(right)][:3] if len(left) < 200000 else None
        only_right = [r for r in right if r not in set(left)][:3] if len(right) < 200000 else None
        result["only_spark"], result["only_sql"] = only_left, only_right
    return result
