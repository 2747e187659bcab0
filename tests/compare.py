"""Runs a query and its SQL over the same tables and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def tables(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(y)) for k, y in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def difference(plan, sql: str, spark, folder: str, con=None) -> str | None:
    """What differs, or None."""
    df = plan(spark, folder)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    rel = (con or tables(folder)).sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    other = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if repr(a) != repr(b) and not all(p == q or float in (type(p), type(q)) and {type(p), type(q)} <= {int, float} and math.isclose(p, q, rel_tol=1e-8) for p, q in zip(a, b, strict=True))]
    return f"{len(bad)} rows, first {str(bad[0])[:700]} ({names})" if bad else None
