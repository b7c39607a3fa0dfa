"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of_spark(df):
    names = sorted(df.columns)
    rows = [tuple(_plain(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=repr)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    rows = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    return names, sorted(rows, key=repr)


def differences(df, con, sql, limit=3):
    """An empty list if both give the same rows."""
    spark_names, spark_rows = rows_of_spark(df)
    sql_names, sql_rows = rows_of_sql(con, sql)
    if spark_names != sql_names:
        return [f"columns: {spark_names} != {sql_names}"]
    if spark_rows == sql_rows:
        return []
    left, right = set(map(repr, spark_rows)), set(map(repr, sql_rows))
    out = [f"{len(spark_rows)} rows != {len(sql_rows)} rows; columns {spark_names}"]
    out += [f"spark only: {r}" for r in sorted(left - right)[:limit]]
    out += [f"sql only:   {r}" for r in sorted(right - left)[:limit]]
    return out
