"""Numbers that must not drift, overflow or depend on how rows arrive."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import dynamics as D
from tidemill.operators import intervals as I
from tidemill.operators import joins as J
from tidemill.operators import sequential as Q
from tidemill.operators import series as S


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, k, v) for k, v in enumerate(values)], "key string, k long, v double")


def test_recursive_average_of_a_long_segment(spark):
    rnd = random.Random(1)
    values = [None if rnd.random() < 0.1 else rnd.random() for _ in range(7000)]
    a, state, want = 1 - 2 ** (-1 / 2), 3.0, []
    for v in values:
        state = (1 - a) * state + a * (v or 0.0)
        want.append(state)
    got = [r.s for r in S.ewma_recursive(series(spark, values), ["key"], "v", 2.0, 3.0, "s").orderBy("k").collect()]  # 3,500 half lives
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_trailing_sums_lose_nothing(spark):
    rnd = random.Random(2)
    values = [rnd.gauss(0, 1) * 10 ** rnd.randrange(-6, 3) for _ in range(1000)]
    values[100], values[500] = 1e15, math.nan  # a spike and a bad row leave the sums with the window
    for n in (1, 7, 100):
        got = [r.s for r in S.trailing_sums(series(spark, values), ["key"], {"s": F.col("v")}, n).orderBy("k").collect()]
        for i, g in enumerate(got):
            part = values[max(0, i - n + 1) : i + 1]
            if any(math.isnan(v) for v in part):
                assert math.isnan(g)
            elif 1e15 not in part:
                assert g == pytest.approx(math.fsum(part), rel=1e-9, abs=1e-12)
    assert S.trailing_sums(series(spark, []), ["key"], {"s": F.col("v")}, 5).collect() == []


def test_first_of_equal_positions_is_always_the_same(spark):
    rows = [("a", 1, float(i), None) for i in range(50)] + [("b", 2, 0.0, {"x": 1})]
    got = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "key string, p long, v double, m map<string,int>").repartition(3)
        got.add(tuple(sorted((r.key, r.v) for r in S.keep_first(df, ["key"], "p").collect())))
    assert len(got) == 1


def test_panel_takes_one_value_of_a_name(spark):
    rows = [(1, "x", 1.0), (1, "y", 2.0), (2, "x", 3.0)]
    df = spark.createDataFrame(rows, "t long, name string, v double")
    assert [tuple(r) for r in J.panel(df, "t", "name", ["x", "y"], "v").collect()] == [(1, 1.0, 2.0)]
    with pytest.raises(Exception, match="several values of a name at 2"):
        J.panel(df.unionAll(spark.createDataFrame([(2, "x", 3.0)], df.schema)), "t", "name", ["x", "y"], "v").collect()


def test_a_new_coupling_is_a_new_configuration():
    r = D.Replayer(2)
    quiet, wild = np.zeros((2, 2)), np.full((2, 2), 50.0)
    x, zero, some = np.array([1.0, 1.0]), np.zeros(2), np.full(2, 1e-4)
    r.row(x, zero, some, some, quiet, 60.0, True)
    assert not r.row(x, zero, some, some, wild, 60.0, False)[1]
    assert r.row(x, zero, some, some, wild, 60.0, False)[1]  # the row before brought a coupling that grows without bound


def test_open_entries_by_component(spark):
    rnd = random.Random(4)
    rows = [("a", s, s // 80, rnd.randrange(3), rnd.random() < 0.9, rnd.randrange(1, 12)) for s in range(200)]
    df = spark.createDataFrame(rows, "key string, source_index long, segment_id long, component long, eligible boolean, horizon long")
    for r in I.overlap_counts(df, ["key"], {"same": ["component"]}).collect():
        open_ = [q for q in rows if q[4] and q[2] == r.segment_id and q[1] < r.source_index <= q[1] + q[5]]
        assert r.active == len(open_) and r.same == sum(q[3] == r.component for q in open_)


def test_chain(spark):
    rows = [(f"f{i % 3}", i, hashlib.sha256(str(i).encode()).hexdigest() if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "feed string, i long, h string").repartition(4)
    chain = Q.hash_chain(df, ["feed"], "i", "h")
    last = {}
    for r in sorted(chain.collect(), key=lambda r: r.i):
        assert r.prev == last.get(r.feed, "0" * 64) and r.link == hashlib.sha256((r.prev + (r.h or "")).encode()).hexdigest()
        last[r.feed] = r.link
    ok = Q.check_chain(chain, ["feed"], "i", "h")
    assert ok.where("bound AND joined").count() == 60
    altered = Q.check_chain(chain.withColumn("h", F.expr("IF(i = 7, 'x', h)")), ["feed"], "i", "h")
    assert [r.i for r in altered.where("NOT bound").collect()] == [7] and altered.where("NOT joined").count() == 0
    missing = Q.check_chain(chain.where("i <> 9"), ["feed"], "i", "h")
    assert [r.i for r in missing.where("NOT joined").collect()] == [12] and missing.where("NOT bound").count() == 0
    assert Q.hash_chain(df.limit(0), ["feed"], "i", "h").collect() == []


def test_slots_change_nothing(spark):
    """A series cut into slots of time has the edges and the lookups of the whole series."""
    rnd = random.Random(6)
    rows = [(f, k, 60, rnd.random()) for f in ("a", "b") for k in sorted(rnd.sample(range(-40, 300), 260))]
    s = spark.createDataFrame(rows, "key string, k long, step long, x double")
    want = sorted(tuple(r) for r in S.with_edges(s, ["key"]).select("key", "k", "ret", "contiguous", "two_step", "segment_id").collect())
    segment, last = {}, {}
    for f, k, _, x in rows:
        segment[f] = segment.get(f, -1) + (last.get(f, (None,))[0] != k - 1)
        got = next(w for w in want if w[:2] == (f, k))
        assert got[5] == segment[f] and got[3] == (last.get(f, (None,))[0] == k - 1)
        last[f] = (k, x)
    for slot in (2, 7, 100):
        assert sorted(tuple(r) for r in S.with_edges(s, ["key"], slot).select("key", "k", "ret", "contiguous", "two_step", "segment_id").collect()) == want
    left = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 400)]), i) for i in range(200)], "key string, t long, i long")
    right = spark.createDataFrame([(rnd.choice(["a", "b", None]), rnd.choice([None, *range(0, 400, 3)]), rnd.randrange(3), i) for i in range(90)], "key string, at long, rank long, v long")
    for forward in (False, True):
        for age in (None, 20.0):
            look = lambda slot: sorted((tuple(r) for r in J.asof(left, right, ["key"], "t", "at", ["v"], ["rank", "v"], max_age=age, forward=forward, slot=slot).collect()), key=str)  # noqa: E731, B023
            whole = look(None)
            assert len(whole) == 200 and all(look(slot) == whole for slot in (1.0, 30.0, 1e6))


def test_rows_are_numbered_over_all_parts(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(40)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = sorted((r.n, r.a, r.b) for r in Q.numbered(df, ["a", "b"], "n").collect())
    assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])) and [n for n, _, _ in got] == list(range(1, 3001))
    assert Q.numbered(df.limit(0), ["a", "b"], "n").collect() == []
