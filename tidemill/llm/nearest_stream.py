"""Problem 4: records of two streams paired by nearest time.

A stateful streaming join: per entity both sides are buffered, a left row is emitted
once the watermark has passed its time plus the tolerance, and candidates that no row
can still reach are evicted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.session import fresh_path

LEFT, RIGHT, HEARTBEAT = 0, 1, 2

_KEPT = ("left_us", "left_id", "left_of", "right_us", "right_id", "right_of")
_STATE = T.StructType([*(T.StructField(n, T.BinaryType()) for n in _KEPT), T.StructField("entities", T.StringType())])
_OUT = ("entity", "left_us", "left_id", "right_us", "right_id")


@dataclass
class Pairing:
    """A streaming plan and the folder whose rows tell it that its sources have ended."""

    plan: DataFrame
    heartbeats: str

    def finish(self, spark: SparkSession) -> None:
        """No more rows will come: let the watermark pass every waiting one."""
        spark.sql("SELECT timestamp'2260-01-01 00:00:00' AS ts").coalesce(1).write.mode("append").parquet(self.heartbeats)


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def nearest(left_us: np.ndarray, right_us: np.ndarray, right_id: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left time the position of its right row (and whether there is one).

    ``right`` is sorted by (us, id).  Nearest first, then the earlier time, then the
    smallest id.
    """
    n = len(right_us)
    at = np.searchsorted(right_us, left_us, side="right")
    before = np.clip(np.searchsorted(right_us, right_us[np.clip(at - 1, 0, n - 1)], side="left"), 0, n - 1)
    after = np.clip(at, 0, n - 1)
    far = np.int64(1) << 62
    d_before = np.where(at > 0, left_us - right_us[before], far)
    d_after = np.where(at < n, right_us[after] - left_us, far)
    pick = np.where(d_before <= d_after, before, after)
    return pick, np.minimum(d_before, d_after) <= tolerance


def _pairing(tolerance: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What happens to a bucket of entities when rows come or its time has come."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts: list[list[np.ndarray]] = [[] for _ in _KEPT]
        names: list[str] = []
        if state.exists:
            kept = state.get
            for p, b in zip(parts, kept):
                p.append(np.frombuffer(b, dtype=np.int64))
            names = json.loads(kept[-1])
        number = {n: i for i, n in enumerate(names)}
        for c in chunks:
            side, us, ident = c["side"].to_numpy(), c["us"].to_numpy(dtype=np.int64), c["id"].to_numpy(dtype=np.int64)
            code, met = pd.factorize(c["entity"])
            of = np.array([number.setdefault(n, len(number)) for n in met], dtype=np.int64)[code] if len(met) else code.astype(np.int64)
            for base, s in ((0, LEFT), (3, RIGHT)):
                some = side == s
                for p, v in zip(parts[base : base + 3], (us, ident, of)):
                    p.append(v[some])
        names = list(number)
        lu, li, lo, ru, ri, ro = (np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for p in parts)
        watermark = state.getCurrentWatermarkMs() * 1000
        due = lu + tolerance < watermark
        if due.any() and len(ru):
            by = np.lexsort((ri, ru, ro))
            ru, ri, ro = ru[by], ri[by], ro[by]
            found = []
            order = np.flatnonzero(due)
            order = order[np.argsort(lo[order], kind="stable")]
            for some in np.split(order, np.flatnonzero(np.diff(lo[order])) + 1):  # entity by entity
                e = lo[some[0]]
                a, b = np.searchsorted(ro, e), np.searchsorted(ro, e, side="right")
                if a < b:
                    pick, near = nearest(lu[some], ru[a:b], ri[a:b], tolerance)
                    found.append((some[near], a + pick[near]))
            if found:
                left, right = (np.concatenate([f[i] for f in found]) for i in range(2))
                if len(left):
                    yield pd.DataFrame({"entity": [names[e] for e in lo[left]], "left_us": lu[left], "left_id": li[left], "right_us": ru[right], "right_id": ri[right]})[list(_OUT)]
        lu, li, lo = lu[~due], li[~due], lo[~due]
        # later left rows are not before the watermark, and only waiting ones of the same entity may be
        first = np.full(len(names), watermark, dtype=np.int64)
        np.minimum.at(first, lo, lu)
        stay = ru >= first[ro] - tolerance
        ru, ri, ro = ru[stay], ri[stay], ro[stay]
        if len(lu) or len(ru):
            alive, code = np.unique(np.concatenate([lo, ro]), return_inverse=True)
            lo, ro = code[: len(lo)].astype(np.int64), code[len(lo) :].astype(np.int64)
            state.update((*(a.tobytes() for a in (lu, li, lo, ru, ri, ro)), json.dumps([names[i] for i in alive.tolist()])))
            wake = int(lu.min() if len(lu) else ru.max()) + tolerance
            state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return step


def pair_by_nearest_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    left_id: str,
    right_ts: str,
    right_id: str,
    tolerance_us: int,
    delay: str = "0 seconds",
    slot_us: int = 86_400_000_000,
    buckets: int | None = None,
) -> Pairing:
    """The streaming plan: candidates (k0.., left_us, left_id, right_us, right_id).

    ``left`` and ``right`` are streaming frames with integer ids that are unique per
    left row and entity.  Rows with a null key or time find no partner; rows later than
    ``delay`` behind the watermark are late and dropped, as the stream's owner chose.

    An entity is cut into slots of ``slot_us``, so that one that holds a third of all
    rows is spread over tasks; a left row goes to every slot its tolerance reaches and
    yields at most one candidate in each: :func:`best_candidates` picks among them.  The
    state of many slots of entities lies in one bucket (four times as many ``buckets`` as the
    session has shuffle partitions), because waking a group costs more than its few rows.
    """
    kn = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, ts: str, ident: str, tag: int) -> DataFrame:
        d = df.select(*(F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, kn)), F.col(f"`{ts}`").alias("ts"), F.col(f"`{ident}`").cast("long").alias("id"))
        d = d.where(" AND ".join(f"{c} IS NOT NULL" for c in (*kn, "ts")))
        # the event time only moves the watermark: kept within what Python's nanoseconds can hold
        inside = F.expr("greatest(timestamp'1700-01-01', least(timestamp'2250-01-01', ts))")
        return d.withColumns({"us": F.unix_micros("ts"), "side": F.lit(tag), "ts": inside})

    floor_div = lambda e: f"cast(floor(({e}) / {float(slot_us)}D) as bigint)"
    lt = side(left, left_ts, left_id, LEFT)
    lt = lt.withColumn("slot", F.explode(F.sequence(F.expr(floor_div(f"us - {tolerance_us}")), F.expr(floor_div(f"us + {tolerance_us}")))))
    rt = side(right, right_ts, right_id, RIGHT).withColumn("slot", F.expr(floor_div("us")))
    beats = fresh_path(left.sparkSession, "heartbeats")
    fs, p = _file_system(left.sparkSession, beats)
    fs.mkdirs(p)
    beat = left.sparkSession.readStream.schema("ts timestamp").parquet(beats).select(*(F.lit(None).cast("string").alias(n) for n in kn), "ts", F.lit(0).cast("long").alias("id"), F.unix_micros("ts").alias("us"), F.lit(HEARTBEAT).alias("side"), F.lit(0).cast("long").alias("slot"))
    cols = [*kn, "slot", "ts", "us", "id", "side"]
    both = lt.select(*cols).unionAll(rt.select(*cols)).unionAll(beat.select(*cols)).withWatermark("ts", delay)
    entity = F.when(F.col("side") != HEARTBEAT, F.to_json(F.array(*kn, F.col("slot").cast("string"))))
    n = buckets or 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select(F.pmod(F.xxhash64(*kn, "slot"), F.lit(n)).alias("bucket"), entity.alias("entity"), "ts", "us", "id", "side")
    schema = T.StructType([T.StructField("entity", T.StringType()), *(T.StructField(c, T.LongType()) for c in _OUT[1:])])
    got = both.groupBy("bucket").applyInPandasWithState(_pairing(tolerance_us), schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    names = F.from_json("entity", "array<string>")
    plan = got.select(*(names[i].alias(n) for i, n in enumerate(kn)), *_OUT[1:])
    return Pairing(plan, beats)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that a query takes with it when it starts."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def pair_tables(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    left_id: str,
    right_ts: str,
    right_id: str,
    tolerance_us: int,
    batches: int = 12,
    watch: Callable[[str, StreamingQuery], None] | None = None,
) -> DataFrame:
    """The candidates of :func:`pair_by_nearest_time` for two tables, streamed in the order of
    their times.

    Both sides are written once into slices of time with about equally many rows.  A slice
    comes into the stream's folder when the batch of the one before it is done, so each
    batch moves the watermark on: what waited is emitted, and candidates that are out of
    reach are evicted.  Rows of a later slice are later than every watermark before it, so
    none is late, whatever the order they arrived in.  State is kept in RocksDB, outside the
    heap, and with the progress in the shared folder.  ``watch`` is called after each batch
    with the folder of progress and the query.
    """
    spark = left.sparkSession
    kn = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, ts: str, ident: str, is_left: bool) -> DataFrame:
        d = df.select(*(F.col(f"`{k}`").cast("string").alias(n) for k, n in zip(keys, kn)), F.col(f"`{ts}`").cast("timestamp").alias("at"), F.col(f"`{ident}`").cast("long").alias("row_id"), F.lit(is_left).alias("is_left"))
        return d.where(" AND ".join(f"{c} IS NOT NULL" for c in (*kn, "at")))

    both = side(left, left_ts, left_id, True).unionAll(side(right, right_ts, right_id, False))
    steps = ",".join(f"{i / batches}D" for i in range(1, batches))
    cuts = both.agg(F.expr(f"percentile_approx(unix_micros(at), array({steps}))").alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))  # rows of equal times are in one slice
    part = F.lit(0)
    for c in cuts:
        part = part + (F.unix_micros("at") > c).cast("int")
    staged, arrived = fresh_path(spark, "slices"), fresh_path(spark, "arrived")
    both.withColumn("part", part).write.partitionBy("part").parquet(staged)
    fs, root = _file_system(spark, staged)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(new_path(arrived))
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in kn), T.StructField("at", T.TimestampType()), T.StructField("row_id", T.LongType()), T.StructField("is_left", T.BooleanType())])
    stream = lambda: spark.readStream.schema(schema).parquet(f"{arrived}/*")
    pairing = pair_by_nearest_time(stream().where("is_left"), stream().where("NOT is_left"), kn, "at", "row_id", "at", "row_id", tolerance_us)
    out, progress = fresh_path(spark, "paired"), fresh_path(spark, "paired-progress")
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true", spark__sql__streaming__noDataMicroBatches__enabled="false"):
        q = pairing.plan.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").start()
    try:
        for i in range(len(cuts) + 1):
            if fs.exists(new_path(f"{staged}/part={i}")):
                fs.rename(new_path(f"{staged}/part={i}"), new_path(f"{arrived}/{i:06d}"))
                q.processAllAvailable()
                if watch:
                    watch(progress, q)
        for _ in range(2):  # the first moves the watermark past everything, the second lets it act
            pairing.finish(spark)
            q.processAllAvailable()
        if watch:
            watch(progress, q)
    finally:
        q.stop()
        for p in (progress, staged, arrived, pairing.heartbeats):
            fs.delete(new_path(p), True)
    return spark.read.schema(pairing.plan.schema).parquet(out)


def best_candidates(found: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """One row per paired left row: keys, ``left_id``, ``right_id``, ``gap_us`` (right minus left)."""
    kn = [f"k{i}" for i in range(len(keys))]
    best = F.min(F.struct(F.abs(F.col("right_us") - F.col("left_us")).alias("d"), "right_us", "right_id"))
    one = found.groupBy(*kn, "left_id", "left_us").agg(best.alias("b"))
    return one.select(*(F.col(n).alias(k) for n, k in zip(kn, keys)), F.col("left_id").alias(left_id), F.col("b.right_id").alias(right_id), (F.col("b.right_us") - F.col("left_us")).alias("gap_us"))


def replay(pairing: Pairing) -> DataFrame:
    """Run a bounded stream to its end into the shared folder and read what it emitted.

    Unless the sources bound their batches, everything available is one batch, so no row
    can be late whatever the order of arrival.  When the sources are exhausted a heartbeat
    carries the watermark past their end, and the same query goes on to emit what still
    waits.  State and progress are kept in the shared folder while it runs, so a lost
    executor's tasks start again.
    """
    stream = pairing.plan
    spark = stream.sparkSession
    out, progress = fresh_path(spark, "paired"), fresh_path(spark, "paired-progress")

    def run() -> None:
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    pairing.finish(spark)
    run()
    fs, p = _file_system(spark, progress)
    fs.delete(p, True)
    return spark.read.schema(stream.schema).parquet(out)
