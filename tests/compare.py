"""Runs a query and its SQL on the same tables and compares them as bags of rows."""

import datetime as dt
import decimal
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def tables(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def bag(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


def spark_rows(df):
    names = sorted(df.columns)
    return names, bag([r[n] for n in names] for r in df.collect())


def sql_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, bag([r[i] for i in at] for r in found.fetchall())
