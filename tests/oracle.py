"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime
import decimal
import glob
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def differences(spark, query, sql, folder):
    """Rows that only one of the two has, as (from Spark, from SQL)."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    df = query(spark, folder)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted("|".join(plain(row[names.index(c)]) for c in order) for row in cursor.fetchall())
    ours = sorted("|".join(plain(row[c]) for c in order) for row in df.collect())
    if ours == theirs:
        return [], []
    return [x for x in ours if x not in set(theirs)] or ours[:3], [x for x in theirs if x not in set(ours)] or theirs[:3]
