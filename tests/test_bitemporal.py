import random
from datetime import datetime, timedelta

from tidemill.operators.bitemporal import attributes_as_known

T0 = datetime(2024, 1, 1)
H = 3_600_000_000


def brute(facts, key, v, r, horizon):
    ok = [f for f in facts if key is not None and f[0] == key and v and r and f[1] and f[2] and f[1] <= v and f[2] <= r and (v - f[1]) / timedelta(microseconds=1) <= horizon]
    return max(ok, key=lambda f: (f[1], f[2], -f[3]))[3] if ok else None


def test_random_points_against_brute_force(spark):
    rnd = random.Random(1)
    hour = lambda n: T0 + timedelta(hours=n)
    facts, n = [], 0
    for key in ("a", "b", "hot", "hot", "hot", None):
        for _ in range(60):
            n += 1
            v = rnd.choice([None, *[hour(rnd.randrange(0, 400))] * 12])
            r = None if v is None else v + timedelta(hours=rnd.choice([-3, 0, 1, 2, 5, 30, 90]))
            facts.append((key, v, r, n))
            if rnd.random() < 0.2:
                n += 1
                facts.append((key, v, r, n))  # an exact copy under another rank
    events = [(i, rnd.choice(["a", "b", "hot", "none", None]), rnd.choice([None, *[hour(rnd.randrange(-20, 500))] * 9]), rnd.choice([None, *[hour(rnd.randrange(-20, 700))] * 9])) for i in range(500)]
    events += events[:20]
    f = spark.createDataFrame(facts, "key string, valid timestamp, seen timestamp, rank int")
    e = spark.createDataFrame(events, "rank int, key string, v timestamp, r timestamp")
    for horizon in (24 * H, 100 * H):
        got = attributes_as_known(e, f, ["key"], "v", "r", "valid", "seen", "rank", ["rank", "valid"], horizon, how="left")
        assert got.columns == ["rank", "key", "v", "r", "known_rank", "known_valid"]
        want = sorted(((i, brute(facts, k, v, r, horizon)) for i, k, v, r in events), key=str)
        assert sorted(((x["rank"], x.known_rank) for x in got.collect()), key=str) == want
        inner = attributes_as_known(e, f, ["key"], "v", "r", "valid", "seen", "rank", ["rank"], horizon)
        assert inner.count() == sum(w is not None for _, w in want)


def test_horizon_is_included_and_the_future_never_matters(spark):
    f = spark.createDataFrame([("a", T0, T0, 1)], "key string, valid timestamp, seen timestamp, rank int")
    e = spark.createDataFrame([(1, "a", T0 + timedelta(hours=10)), (2, "a", T0 + timedelta(hours=10, microseconds=1)), (3, "a", T0), (4, "a", T0 - timedelta(microseconds=1))], "id int, key string, t timestamp")
    look = lambda facts: {r.id for r in attributes_as_known(e, facts, ["key"], "t", "t", "valid", "seen", "rank", ["rank"], 10 * H).where("known_rank = 1").collect()}
    assert look(f) == {1, 3}
    later = spark.createDataFrame([("a", T0 + timedelta(hours=5), T0 + timedelta(days=9), 2), ("a", T0 + timedelta(days=8), T0 + timedelta(days=8), 3)], f.schema)
    assert look(f.unionAll(later)) == {1, 3}


def test_empty_tables(spark):
    f = spark.createDataFrame([], "key string, valid timestamp, seen timestamp, rank int")
    e = spark.createDataFrame([(1, "a", T0)], "id int, key string, t timestamp")
    args = (["key"], "t", "t", "valid", "seen", "rank", ["rank"], 10 * H)
    assert attributes_as_known(e, f, *args).count() == 0
    assert [r.known_rank for r in attributes_as_known(e, f, *args, how="left").collect()] == [None]
    assert attributes_as_known(e.limit(0), f, *args, how="left").count() == 0


def test_session_zone_does_not_matter(spark):
    f = spark.createDataFrame([("a", T0, T0, 1)], "key string, valid timestamp, seen timestamp, rank int")
    e = spark.createDataFrame([(1, "a", T0 + timedelta(hours=1))], "id int, key string, t timestamp")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert attributes_as_known(e, f, ["key"], "t", "t", "valid", "seen", "rank", ["rank", "valid"], 10 * H).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
