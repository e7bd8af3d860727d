"""Every registered query of the core at the smallest scale against the SQL that states its result."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tz is None else v.tz_convert("UTC").tz_localize(None))
    return "null" if v is None or v is pd.NaT or v is pd.NA else str(v)


def _rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_states(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)
