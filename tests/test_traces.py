"""Small hand-traced cases and brute-force comparisons of the ordered operators."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemill.operators import intervals as I
from tidemill.operators import joins as J
from tidemill.operators import scoring as C
from tidemill.operators import series as S

ENTRY = "key string, source_index long, segment_id long, component long, eligible boolean, horizon long"


def entries(spark, src, seg=None, comp=None, ok=None, h=1):
    n = len(src)
    return spark.createDataFrame([("a", s, (seg or [0] * n)[i], (comp or [0] * n)[i], (ok or [True] * n)[i], h) for i, s in enumerate(src)], ENTRY)


def column(df, c):
    return [r[c] for r in df.orderBy("source_index").collect()]


def test_gap_mask(spark):
    s = spark.createDataFrame([("a", k, 60, 0.0) for k in (0, 1, 2, 8, 9)], "key string, k long, step long, x double")
    e = S.with_edges(s, ["key"]).orderBy("k").collect()
    assert [r.contiguous for r in e] == [False, True, True, False, True]
    assert [r.segment_id for r in e] == [0, 0, 0, 1, 1] and [r.two_step for r in e] == [False, False, True, False, False]
    assert [r.ret for r in e] == [None, 0.0, 0.0, None, 0.0]


def test_acceptance(spark):
    assert column(I.greedy_accept(entries(spark, [0, 1, 2], comp=[0, 1, 0], h=10), ["key"]), "accepted") == [True, False, False]
    four = entries(spark, [0, 1, 2, 3], comp=[0, 1, 0, 1], h=3)
    assert column(I.greedy_accept(four, ["key"], ["component"]), "accepted") == [True, True, False, False]
    assert column(I.greedy_accept(four, ["key"]), "accepted") == [True, False, False, False]
    assert I.greedy_accept(four.limit(0), ["key"]).collect() == []


def test_overlaps_and_episodes(spark):
    o = I.overlap_counts(entries(spark, [0, 1, 2], h=2), ["key"])
    assert column(o, "active") == [0, 1, 2] and column(o, "overlap") == [0, 1, 1]
    e = entries(spark, range(7), seg=[0] * 6 + [1], comp=[0, 0, 1, 1, 0, 0, 0], ok=[True] * 4 + [False] + [True] * 2)
    ep = column(I.episodes(e, ["key"]), "episode")
    assert ep == [0, 0, 1, 1, -1, 2, 3]


def test_greedy_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(k, s, s // 60, s % 3, rnd.random() < 0.8, rnd.randrange(1, 9)) for k in ("a", "b") for s in sorted(rnd.sample(range(240), 150))]
    got = {(r.key, r.source_index): r.accepted for r in I.greedy_accept(spark.createDataFrame(rows, ENTRY).repartition(3), ["key"]).collect()}
    open_until = {}
    for k, s, g, _, ok, h in rows:
        if ok:
            want = s > open_until.get((k, g), -1)
            if want:
                open_until[k, g] = s + h
            assert got.pop((k, s)) == want
    assert not got


def test_purge_against_brute_force(spark):
    rnd = random.Random(7)
    make = lambda n: [("a" if rnd.random() < 0.5 else None, s, s + rnd.randrange(30)) for s in (rnd.randrange(900) for _ in range(n))]
    train, held = make(500), [("a", 400, 460), ("a", 455, 470), ("a", 700, 701), (None, 100, 130)]
    df = lambda x: spark.createDataFrame([(i, *r) for i, r in enumerate(x)], "id int, key string, s long, t long")
    got = {r.id: r.overlaps for r in J.overlaps_any(df(train), df(held), ["key"], "s", "t").collect()}
    assert got == {i: any(k == q and a <= d and c <= b for q, c, d in held) for i, (k, a, b) in enumerate(train)}
    assert sorted((r.s, r.t) for r in J.merge_intervals(df(held), ["key"], "s", "t").where("key = 'a'").collect()) == [(400, 470), (700, 701)]
    assert not any(r.overlaps for r in J.overlaps_any(df(train), df(held).limit(0), ["key"], "s", "t").collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 30)), max_size=25), st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 30)), max_size=25), st.sampled_from([None, 0, 4]), st.booleans())
def test_asof_against_brute_force(spark, left, right, age, forward):
    l = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(left)], "id int, key string, t long")
    r = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(right)], "n int, key string, u long")
    got = {x.id: x.n for x in J.asof(l, r, ["key"], "t", "u", ["n"], ["n"], age, forward).collect()}
    want = {}
    for i, (k, t) in enumerate(left):
        ok = [(u, n) for n, (q, u) in enumerate(right) if q == k and (u > t if forward else u <= t)]
        best = (min(ok) if forward else max(ok)) if ok else None
        want[i] = best[1] if best and (age is None or abs(t - best[0]) <= age) else None
    assert got == want


def test_holm_stops_at_the_first_failure(spark):
    t = spark.createDataFrame([("f", "a", 0.001), ("f", "b", 0.03), ("f", "c", 0.02), ("f", "d", 0.04)], "family string, id string, p double")
    got = {r.id: (r["rank"], r.rejected) for r in C.holm(t, ["family"], "id", "p", 0.05).collect()}
    assert got == {"a": (1, True), "c": (2, False), "b": (3, False), "d": (4, False)}


def test_averages_do_not_overflow_over_many_half_lives(spark):
    rows = [("a", k * 7, 86_400, float(k % 5) if k % 11 else None) for k in range(600)]
    s = spark.createDataFrame(rows, "key string, k long, step long, x double")
    got = {r.k: r.m for r in S.ewma_wall(s, ["key"], "x", 86_400.0, "m").collect()}
    num = den = last = 0.0
    for _, k, _, x in rows:
        f = 2.0 ** -(k - last)
        num, den, last = num * f + (x or 0.0), den * f + (x is not None), k
        if den:
            assert got[k] == pytest.approx(num / den, rel=1e-9)
        else:
            assert got[k] is None


def test_fallback_tiers(spark):
    train = spark.createDataFrame([("x", "p", i % 3) for i in range(30)] + [("y", "p", 0)] * 5, "a string, b string, y int")
    target = spark.createDataFrame([("x", "p"), ("y", "p"), ("z", "q"), (None, None)], "a string, b string")
    got = {(r.a, r.b): (r.tier, round(r.p_0, 6)) for r in C.climatology(train, target, [["a", "b"], ["b"], []], "y", 3).collect()}
    assert got == {("x", "p"): (0, round(11 / 33, 6)), ("y", "p"): (1, round(16 / 38, 6)), ("z", "q"): (2, round(16 / 38, 6)), (None, None): (2, round(16 / 38, 6))}
    none = C.climatology(train.limit(0), target, [["a"], []], "y", 3).collect()
    assert all(round(r.p_1, 6) == round(1 / 3, 6) for r in none) and len(none) == 4
