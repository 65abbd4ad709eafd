"""Registered queries against their DuckDB SQL on the smallest scale factor."""

import datetime
import math
import os

import duckdb
import pandas as pd
import pytest

from driver_queries import QUERIES, SQL
from driver_queries.roles import DRIVER_TABLES

SLOW = {"scan_warehouse_tables", "stream_warehouse_tables"}


def norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        return (1, str(int(v))) if v.is_integer() else (1, repr(v))
    if isinstance(v, datetime.datetime):
        return (1, v.isoformat())
    if isinstance(v, datetime.date):
        return (1, v.isoformat() + "T00:00:00")
    if hasattr(v, "to_pydatetime"):
        return norm(v.to_pydatetime())
    return (1, str(v))


def canon(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_sql(spark, sf_small, con, name):
    got = canon(QUERIES[name](spark, sf_small).toPandas())
    want = canon(con.execute(SQL[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]
