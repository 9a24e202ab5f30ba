import os

import pytest

from tidemill.llm import queries as Q

DATA = os.environ.get("TIDEMILL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {"p4_found": ["event_seq", "bar_id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name in Q.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for t in ("bars", "legal_events"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, rows)) == sorted(want)
    if name == "p7_ids":
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
