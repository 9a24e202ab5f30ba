import math
import random
from datetime import datetime, timedelta

import numpy as np

from tidemill.operators.faults import counted, flag_faults, middle, sizes, source_faults, spikes, stuck, usual

T0 = datetime(2024, 1, 1)


def walk(n, seed=0):
    rnd, x, out = random.Random(seed), 0.0, []
    for _ in range(n):
        x += rnd.gauss(0, 1e-3)
        out.append(round(math.exp(x), 5))
    return out


def rows_of(key, values, first_id=0):
    return [(key, T0 + timedelta(minutes=i), v, first_id + i) for i, v in enumerate(values)]


def test_planted_faults_are_found_and_moves_are_not(spark):
    v = walk(600)
    v[400:] = [x * 1.05 for x in v[400:]]  # a lasting move
    for i, f in {100: 1.1, 150: 0.93, 200: 1.08, 201: 1.081, 202: 1.079}.items():
        v[i] *= f
    v[300:312] = [v[300]] * 12
    v[50], v[60], v[70], v[80] = 0.0, -1.0, float("nan"), v[80] * 100
    want = {100: "spike", 150: "spike", 200: "spike", 201: "spike", 202: "spike", 50: "impossible", 60: "impossible", 70: "impossible", 80: "impossible"} | {i: "stuck" for i in range(301, 312)}
    rows = rows_of("a", v)
    again = [("a", rows[i][1], rows[i][2], 10_000 + i) for i in (100, 305)]  # delivered again
    rows += [*again, ("a", None, 1.0, 5000), ("a", T0, None, 5001), (None, T0, -1.0, 5002), *rows_of("b", [5.0, 5.0, 9.0], 6000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v double, id long").withColumnRenamed("key", "fault_key")
    expected = want | {10_100: "spike", 10_305: "stuck"}
    for cut in (200_000, 150):  # whole, and cut in slots
        got = {r.id: r.fault for r in flag_faults(df, ["fault_key"], "ts", "v", "id", rows_a_slot=cut).collect()}
        assert got == expected
    assert flag_faults(df.limit(0), ["fault_key"], "ts", "v", "id").count() == 0


def behaviour(x):
    return usual(*sizes(x, np.ones(len(x), dtype=bool)))


def test_four_readings_off_are_a_level_and_not_a_spike():
    x = np.log(walk(300, 5))
    x[100:104] += 0.05
    assert not spikes(x, 10, behaviour(x)).any()
    x[102:104] -= 0.05
    assert np.flatnonzero(spikes(x, 10, behaviour(x))).tolist() == [100, 101]


def test_runs():
    x = np.array([1.0, 1, 1, 1, 2, 2, 3])
    assert stuck(x, 3).tolist() == [False, True, True, True, False, False, False]
    assert not stuck(x, 4).any() and len(stuck(x[:0], 3)) == 0
    assert source_faults(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64), 0.0, 10, 9, 2).tolist() == []


def test_later_rows_of_other_sources_do_not_matter(spark):
    v = walk(200, 7)
    v[50] *= 1.1
    df = spark.createDataFrame(rows_of("a", v), "key string, ts timestamp, v double, id long")
    wild = spark.createDataFrame(rows_of("b", [x * (1 + i % 2) for i, x in enumerate(walk(200, 8))], 1000), df.schema)
    assert [r.id for r in flag_faults(df.unionAll(wild), ["key"], "ts", "v", "id").where("key = 'a'").collect()] == [50]


def test_counts_merge_into_the_median():
    rnd = np.random.default_rng(0)
    a = rnd.lognormal(0, 3, 5001)
    whole = counted(a)
    parts = [counted(x) for x in np.array_split(a, 7)]
    bins = np.unique(np.concatenate([b for b, _ in parts]))
    n = np.array([sum(int(c[b == k].sum()) for b, c in parts) for k in bins])
    assert bins.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist()
    assert abs(middle(*whole) / np.median(a) - 1) < 0.02 and middle(*counted(np.zeros(5))) == 0 == middle(*counted(np.zeros(0)))
    assert middle(*counted(np.array([0.0, 0.0, 0.0, 5.0]))) == 0


def test_slots_flag_what_the_whole_source_flags(spark):
    """Levels, scales and the number of readings are the source's, however it is cut."""
    rnd = random.Random(2)
    two = [100 + rnd.gauss(0, 0.05) for _ in range(1600)] + [280 + rnd.gauss(0, 2.0) for _ in range(1100)]  # two levels, and two ways to move
    one = walk(900, 3)
    for v in (two, one):
        for i in range(37, len(v), 97):
            v[i] *= 1.0 + rnd.choice([-1, 1]) * rnd.choice([0.002, 0.01, 0.2])
        v[500:520] = [v[500]] * 20
    times = sorted(rnd.sample(range(20_000), 2000)) + sorted(rnd.sample(range(500_000, 501_000), 700))  # a burst after a hole
    rows = [("two", T0 + timedelta(seconds=t), v, i) for i, (t, v) in enumerate(zip(times, two))] + rows_of("one", one, 10_000) + rows_of("few", [1.0, 1.0, -1.0], 20_000)
    rows += [(k, t, v, i + 50_000) for k, t, v, i in rows[::53]]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v double, id long")
    want = {r.id: r.fault for r in flag_faults(df, ["key"], "ts", "v", "id").collect()}
    kinds = [f for i, f in want.items() if i < 2700]
    assert kinds.count("impossible") > 1000 and {"spike", "stuck"} <= set(want.values()) and 20_002 in want
    for cut in (1000, 300, 60):
        assert {r.id: r.fault for r in flag_faults(df, ["key"], "ts", "v", "id", rows_a_slot=cut).collect()} == want, cut
