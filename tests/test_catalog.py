"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import decimal
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from sparkkb import catalog

from .conftest import DATA

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5)
    if isinstance(x, datetime.datetime):
        return str(pd.Timestamp(x).tz_localize(None))
    return x


def test_sql_is_for_known_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in SQL:
        found = duck.execute(SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in sorted(columns)]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
