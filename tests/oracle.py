"""Holds a query's rows against its SQL, columns by name, rows in any order."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns, found):
    return sorted(repr(tuple(plain(r[c]) for c in columns)) for r in found)


def sql_rows(sql):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = db.sql(sql)
    columns = sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    return columns, sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def check(spark, query, sql):
    df = query(spark, DATA)
    columns, wanted = sql_rows(sql)
    assert sorted(df.columns) == columns
    assert rows(columns, df.collect()) == wanted
