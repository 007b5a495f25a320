"""Run a query and its SQL and compare the rows, whatever their order."""

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None:
        return repr(value)
    return str(value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(t[i]) for i in order) for t in tuples)


def compare(spark, con, query, sql, sf_dir):
    """A message about the first difference, or None."""
    got = query(spark, sf_dir)
    found = got.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    if sorted(got.columns) != sorted(names):
        return f"columns {got.columns} != {names}"
    a, b = rows(got.columns, found), rows(names, wanted)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"got {str(x)[:400]}\nsql {str(y)[:400]}"
    return None
