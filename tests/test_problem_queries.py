"""The general problems' queries against brute force on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

import pytest

from tidemill.operators import timestamps as S
from tidemill.plans import core_problems as Q
from tidemill.session import shared_dir

DATA = os.environ.get("TIDEMILL_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def parsed(event, field):
    zones = {r["jurisdiction"]: r for r in rows("jurisdictions")}
    z = zones.get(event["jurisdiction"], {})
    return S.parse_instant(event[field], z.get("time_zone"), z.get("date_order"))


def test_parameters_as_known(spark):
    from datetime import UTC, datetime

    params = [p for p in rows("dynamics_params") if p["sigma_eps"] is not None and p["timestamp"] and p["recorded_at"]]
    want = []
    for e in rows("legal_events"):
        us = parsed(e, "known_at")
        if us is None or e["assessment_created_at"] is None:
            continue
        t = max(datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us), e["assessment_created_at"])
        for symbol, weight in e["pair_exposures"] or []:
            own = [p for p in params if weight and (p["feed_id"], p["symbol"]) == (e["feed_id"], symbol) and p["timestamp"] <= t and p["recorded_at"] <= t and p["timestamp"] >= t - timedelta(days=10)]
            if own:
                want.append((e["event_seq"], max(own, key=lambda p: (p["timestamp"], p["recorded_at"], -p["param_id"]))["param_id"]))
    assert sorted(tuple(r) for r in Q.p1_found(spark, DATA).collect()) == sorted(want) and want


def test_instants(spark):
    want = [(e["event_seq"], f, parsed(e, f)) for e in rows("legal_events") for f in Q.TIME_FIELDS]
    want = sorted(w for w in want if w[2] is not None)
    assert sorted(tuple(r) for r in Q.p6_found(spark, DATA).collect()) == want
    # a second run finds every text in the kept dictionary and adds nothing
    kept = f"{Q.instants(spark)}/v{S.GRAMMAR_VERSION}"
    before = S._committed(spark, kept)
    assert sorted(tuple(r) for r in Q.p6_found(spark, DATA).collect()) == want and before and S._committed(spark, kept) == before


def test_two_writers_at_a_time(spark):
    path = f"{shared_dir(spark)}/two-writers"
    texts = [f"2024-03-{d:02d} 12:00" for d in range(1, 29)] + ["never", None]
    keys = spark.createDataFrame([(t, "Europe/Berlin", None) for t in texts if t], "raw string, zone string, date_order string")
    with ThreadPoolExecutor(3) as pool:
        for d in pool.map(lambda i: S.extend_dictionary(keys.limit(20 + 4 * i), path), range(3)):
            d.count()
    # both of two batches may hold a key: rows are not doubled
    batches = S._committed(spark, f"{path}/v{S.GRAMMAR_VERSION}")
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    spark.read.parquet(batches[0]).write.parquet(f"{path}/v{S.GRAMMAR_VERSION}/again")
    whole = S.extend_dictionary(keys, path)
    assert whole.count() == whole.select("raw").distinct().count() == 29
    got = S.normalise_timestamps(keys, "raw", "zone", "date_order", dictionary=path)
    assert got.count() == 29 and got.where("instant_us IS NULL").count() == 1
    assert not [f for f in fs.listStatus(p(f"{path}/v{S.GRAMMAR_VERSION}")) if f.getPath().getName().startswith("_")]
    # what broke off is not read
    keys.write.parquet(f"{path}/v{S.GRAMMAR_VERSION}/_left")
    assert S.read_dictionary(spark, path).count() == 29
