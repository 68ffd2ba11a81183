"""Comparing a Spark result with DuckDB's."""

from __future__ import annotations

import math


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same_rows(df, con, sql) -> int:
    """Fail unless both have the same columns, kinds of type and rows; the number of rows."""
    mine = sorted(df.columns)
    theirs = con.sql(sql)
    assert sorted(theirs.columns) == mine
    kinds = dict(zip(theirs.columns, map(str, theirs.types), strict=True))
    spark = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: spark.get(t, t) for c, t in df.dtypes} == kinds
    a = sorted((tuple(plain(r[c]) for c in mine) for r in df.collect()), key=repr)
    place = [theirs.columns.index(c) for c in mine]
    b = sorted((tuple(plain(r[i]) for i in place) for r in theirs.fetchall()), key=repr)
    assert a == b
    return len(a)
