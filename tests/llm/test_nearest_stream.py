import random
from datetime import datetime, timedelta

import numpy as np

from tidemill.llm.nearest_stream import best_candidates, nearest, pair_by_nearest_time, pair_tables, replay

T0 = datetime(2024, 1, 1)
SECOND = 1_000_000


def as_stream(spark, df, path, parts=3):
    df.repartition(parts).write.parquet(f"file://{path}")
    return spark.readStream.schema(df.schema).parquet(f"file://{path}")


def pair(spark, left, right, tmp_path, tolerance, **more):
    l, r = as_stream(spark, left, tmp_path / "l"), as_stream(spark, right, tmp_path / "r")
    return best_candidates(replay(pair_by_nearest_time(l, r, ["key"], "t", "lid", "ts", "rid", tolerance, **more)), ["key"], "lid", "rid")


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    at = lambda span: rnd.choice([None, *[T0 + timedelta(seconds=rnd.randrange(span))] * 12])
    left = [(rnd.choice(["a", "b", None, "only left"]), at(4000), i, 1.0) for i in range(150)]
    right = [(rnd.choice(["a", "a", "a", "b", None, "only right"]), at(4000), i, 2.0) for i in range(400)]
    right += [(k, t, i + 1000, y) for k, t, i, y in right[:80]]  # the same times again
    l = spark.createDataFrame(left, "key string, t timestamp, lid long, rid double")
    r = spark.createDataFrame(right, "key string, ts timestamp, rid long, lid double")
    tol = 20
    want = []
    for k, t, i, _ in left:
        ok = [(abs((ts - t).total_seconds()), ts, j) for q, ts, j, _ in right if k is not None and q == k and t and ts and abs((ts - t).total_seconds()) <= tol]
        if ok:
            d, ts, j = min(ok)
            want.append((k, i, j, int((ts - t).total_seconds()) * SECOND))
    got = pair(spark, l, r, tmp_path, tol * SECOND, slot_us=500 * SECOND)  # many slots
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and len(want) > 30
    for batches in (1, 7):
        got = best_candidates(pair_tables(l, r, ["key"], "t", "lid", "ts", "rid", tol * SECOND, batches=batches), ["key"], "lid", "rid")
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_tables_stream_with_little_state(spark):
    """Twelve batches: what waits and what can still be reached is all that is kept."""
    rnd = random.Random(9)
    right = [(f"s{i % 4}", T0 + timedelta(seconds=7 * (i // 4)), i) for i in range(6000)]
    left = [(f"s{i % 4}", T0 + timedelta(seconds=rnd.randrange(10_500)), i) for i in range(200)]
    rnd.shuffle(right)
    l, r = spark.createDataFrame(left, "key string, t timestamp, lid long"), spark.createDataFrame(right, "key string, ts timestamp, rid long")
    kept, emitted, provider = [], [], []

    def watch(progress, q):
        rows = spark.read.format("statestore").load(progress).selectExpr("coalesce(sum(length(value.groupState.left_us) + length(value.groupState.right_us)), 0) AS n").first()["n"]
        kept.append(rows // 8)
        provider.append(q.lastProgress.stateOperators[0].customMetrics)
        emitted.append(q.lastProgress.batchId)

    got = best_candidates(pair_tables(l, r, ["key"], "t", "lid", "ts", "rid", 60 * SECOND, watch=watch), ["key"], "lid", "rid").collect()
    assert len(got) == 200 and all(abs(x.gap_us) <= 3_500_000 for x in got)
    assert len(kept) == 13 and max(kept) < 6200 / 10 and kept[0] > 0 and kept[-1] == 0
    assert any("rocksdb" in k for k in provider[0])


def test_ties_and_bounds():
    r_us, r_id = np.array([0, 10, 10, 20, 30]), np.array([5, 1, 2, 3, 4])
    pick, near = nearest(np.array([15, 10, 25, 36, -5, 41]), r_us, r_id, 10)
    assert r_id[pick].tolist()[:5] == [1, 1, 3, 4, 5]  # earlier of equal distance, smallest id of equal time
    assert near.tolist() == [True, True, True, True, True, False]


def test_empty_sides(spark, tmp_path):
    l = spark.createDataFrame([("a", T0, 1)], "key string, t timestamp, lid long")
    r = spark.createDataFrame([("a", T0, 1)], "key string, ts timestamp, rid long")
    assert pair(spark, l.limit(0), r, tmp_path / "1", SECOND).count() == 0
    assert pair(spark, l, r.limit(0), tmp_path / "2", SECOND).count() == 0
    assert pair(spark, l, r, tmp_path / "3", SECOND).count() == 1
    tables = lambda a, b: pair_tables(a, b, ["key"], "t", "lid", "ts", "rid", SECOND).count()
    assert tables(l.limit(0), r) == 0 == tables(l, r.limit(0)) == tables(l.limit(0), r.limit(0)) and tables(l, r) == 1


def test_many_batches_emit_and_evict(spark, tmp_path):
    """File by file, in order of time: the watermark emits early rows before the end."""
    import time

    for i in range(4):
        base = T0 + timedelta(hours=i)
        spark.createDataFrame([("a", base, i)], "key string, t timestamp, lid long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/l")
        spark.createDataFrame([("a", base + timedelta(seconds=s), 10 * i + s) for s in range(3)], "key string, ts timestamp, rid long").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/r")
        time.sleep(0.05)
    l = spark.readStream.schema("key string, t timestamp, lid long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/l")
    r = spark.readStream.schema("key string, ts timestamp, rid long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/r")
    plan = pair_by_nearest_time(l, r, ["key"], "t", "lid", "ts", "rid", 60 * SECOND, delay="0 seconds")
    found = best_candidates(replay(plan), ["key"], "lid", "rid")
    assert sorted((x.lid, x.rid) for x in found.collect()) == [(i, 10 * i) for i in range(4)]
