"""Every query runs, has a stable schema and, where there is SQL, gives what DuckDB gives."""

import datetime
import decimal
import math
import os

import pytest

from tidemill.plans import catalogue

DATA = os.environ.get("TIDEMILL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(DATA):
        if t.endswith(".parquet"):
            p = f"{DATA}/{t}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{t}") else "")
            c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        at = [[d[0] for d in got.description].index(c) for c in cols]
        assert sorted(d[0] for d in got.description) == cols
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
