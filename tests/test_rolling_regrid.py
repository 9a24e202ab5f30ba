import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from tidemill.operators.regrid import regular_grid
from tidemill.operators.rolling import distinct_times_per_day, latest_per_day, rolling_totals

T0 = datetime(2024, 1, 1)


def test_rolling_against_brute_force(spark):
    rnd = random.Random(2)
    days = {k: sorted(rnd.sample(range(90), 25)) for k in ("a", "b", None)}
    rows = [(k, date(2024, 1, 1) + timedelta(d), rnd.choice([None, rnd.randrange(100)]), "extra") for k, ds in days.items() for d in ds]
    df = spark.createDataFrame([*rows, ("a", None, 5, "no day")], "key string, day date, value long, total_7 string")
    got = {(r.key, r.day): r for r in rolling_totals(df.select("key", "day", "value"), ["key"], "day", "value").collect()}
    val = {(k, d): v or 0 for k, d, v, _ in rows}
    assert len(got) == sum(ds[-1] - ds[0] + 1 for ds in days.values())
    for (k, d), r in got.items():
        for n in (7, 30):
            want = sum(val.get((k, d - timedelta(i)), 0) for i in range(n))
            assert r[f"total_{n}"] == want and math.isclose(r[f"avg_{n}"], want / n)
        assert r.active == ((k, d) in val) and r.value == val.get((k, d), 0)


def test_daily_values(spark):
    rows = [("a", T0, T0, 2, 10), ("a", T0, T0, 1, 20), ("a", T0 + timedelta(hours=1), None, 3, 30), ("b", T0, None, 4, None), ("a", None, T0, 5, 50)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seen timestamp, id int, v long")
    assert sorted((r.key, r.value) for r in latest_per_day(df, ["key"], "ts", "seen", "id", "v").where("key = 'a'").collect()) == [("a", 20)]
    assert latest_per_day(df, ["key"], "ts", "seen", "id", "v").where("key = 'b'").first().value is None
    assert sorted((r.key, r.value) for r in distinct_times_per_day(df, ["key"], "ts", "v").collect()) == [("a", 2)]
    assert rolling_totals(df.limit(0).selectExpr("key", "date(ts) AS day", "v"), ["key"], "day", "v").count() == 0


def readings(spark, rows):
    return spark.createDataFrame(rows, "key string, ts timestamp, y double, step int, support string")


def test_grid_marks_missing_periods(spark):
    s = lambda n: T0 + timedelta(seconds=n)
    rows = [("a", s(0), 1.0, 60, ""), ("a", s(59.999999), 3.0, 60, ""), ("a", s(60), 2.0, 60, ""), ("a", s(305), 4.0, 60, ""), ("a", s(130), None, 60, ""), ("a", None, 1.0, 60, ""), ("b", s(5), 1.0, 60, ""), ("c", s(5), 1.0, 0, ""), (None, s(5), 1.0, 60, "")]
    df = readings(spark, rows + rows[:1])
    t = int((T0 - datetime(1970, 1, 1)).total_seconds())
    for extent in ("series", "day"):
        got = {(r.key, r.period_start - t): r for r in regular_grid(df, ["key"], "ts", "y", "step", extent=extent).collect()}
        assert {k: (r.n_readings, r.missing) for k, r in got.items()} == {("a", 0): (3, False), ("a", 60): (1, False), ("a", 120): (0, True), ("a", 180): (0, True), ("a", 240): (0, True), ("a", 300): (1, False), ("b", 0): (1, False)}
        assert all(r.estimate is None for r in got.values() if not r.supported)
    assert regular_grid(df.limit(0), ["key"], "ts", "y", "step").count() == 0


def test_marks_come_from_the_kernel(spark):
    """What tells a missing period is the support that the kernel gives it, in the plan too."""
    s = lambda n: T0 + timedelta(seconds=n)
    df = readings(spark, [("a", s(0), 1.0, 60, ""), ("a", s(30), 2.0, 60, ""), ("a", s(70), math.inf, 60, ""), ("a", s(190), 1.0, 60, "")])
    got = {r.period_start: r for r in regular_grid(df, ["key"], "ts", "y", "step").collect()}
    own = [got[k].own_support for k in sorted(got)]
    assert own[0] == pytest.approx((15 / 16 + 1) ** 2 / ((15 / 16) ** 2 + 1)) and own[1] == pytest.approx(1) and own[2] == 0 and own[3] == pytest.approx(1)
    assert [got[k].missing for k in sorted(got)] == [False, False, True, False]
    marks = regular_grid(df, ["key"], "ts", "y", "step", extent="day").where("missing").select("key", "period_start")
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert "AS oq" in plan and "pow(" in plan.lower()
    with pytest.raises(ValueError):
        regular_grid(df, ["key"], "ts", "y", "step", bandwidth=0.5)


def test_days_are_apart(spark):
    rows = [("a", T0 + timedelta(hours=h), 1.0, 3600, "") for h in (1, 3, 30, 33)]
    got = regular_grid(readings(spark, rows), ["key"], "ts", "y", "step", extent="day").where("missing").count()
    whole = [r.period_start for r in regular_grid(readings(spark, rows), ["key"], "ts", "y", "step").orderBy("period_start").collect()]
    assert len(set(whole)) == len(whole) == 33 and set(np.diff(whole)) == {3600}
    assert got == 1 + 2
    assert regular_grid(readings(spark, rows), ["key"], "ts", "y", "step").where("missing").count() == 33 - 4  # periods 1 to 33, four of them with a reading


def test_estimate_is_the_weighted_local_line(spark):
    rnd = random.Random(3)
    rows = [("a", T0 + timedelta(seconds=rnd.random() * 3000), rnd.gauss(0, 1), 60, "") for _ in range(80)]
    line = [("b", T0 + timedelta(seconds=25 * i), 2.0 + 0.01 * 25 * i, 60, "") for i in range(80)]
    t = (T0 - datetime(1970, 1, 1)).total_seconds()
    for r in regular_grid(readings(spark, rows + line + [("a", T0 + timedelta(seconds=70), math.inf, 60, "")]), ["key"], "ts", "y", "step").collect():
        m = r.period_start - t + 30
        if r.key == "b" and r.supported:
            assert r.estimate == pytest.approx(2.0 + 0.01 * m, abs=1e-7)
        if r.key == "a" and r.supported:
            w = [(1 - ((ts - T0).total_seconds() - m) ** 2 / 120**2, (ts - T0).total_seconds() - m, y) for k, ts, y, *_ in rows if abs((ts - T0).total_seconds() - m) < 120]
            s0, s1, s2 = (sum(a * d**p for a, d, _ in w) for p in (0, 1, 2))
            t0, t1 = (sum(a * d**p * y for a, d, y in w) for p in (0, 1))
            assert r.estimate == pytest.approx((t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1), rel=1e-6, abs=1e-6)
            assert r.support == pytest.approx(s0**2 / sum(a * a for a, *_ in w), rel=1e-6)
