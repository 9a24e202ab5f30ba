"""Structured Streaming forms, replayed over the available files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.base import KEYS, Registry
from tidemill.session import fresh_path
from tidemill.streaming import series_stream as R

query = Registry()


def _stream(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).select(*columns).schema).parquet(path + "*")  # a pattern may also name a single file


def ending(stream: DataFrame, ts: str, beats: str) -> DataFrame:
    """The stream with one more source: a row there has nothing but a time, far ahead, and says
    that no more rows will come."""
    spark = stream.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(beats)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    beat = spark.readStream.schema(f"{ts} timestamp").parquet(beats)
    return stream.unionByName(beat, allowMissingColumns=True)


def run(stream: DataFrame, name: str, beats: str) -> DataFrame:
    """Run to the end of what is available, then tell the watermark that it was the end; into
    the shared folder.  Returns what came out, without the row that told it."""
    spark = stream.sparkSession
    out, progress = fresh_path(spark, name), fresh_path(spark, f"{name}-progress")
    for last in (False, True):
        if last:
            spark.sql("SELECT timestamp'2260-01-01 00:00:00' AS timestamp").coalesce(1).write.mode("append").parquet(beats)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).where("feed_id IS NOT NULL")


@query("""SELECT feed_id, symbol, (timestamp AT TIME ZONE 'UTC')::DATE AS day, count(close) AS n, min(close) AS low, max(close) AS high FROM bars WHERE close IS NOT NULL GROUP BY ALL""")
def stream_daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Daily count and range of each series."""
    bars = _stream(spark, d, "bars", [*KEYS, "timestamp", "close"]).where("close IS NOT NULL")
    beats = fresh_path(spark, "rollup-end")
    return run(R.daily_rollup(ending(bars, "timestamp", beats), KEYS, "timestamp", "close", "0 seconds"), "rollup", beats).select(*KEYS, "day", "n", "low", "high")


@query("""WITH b AS (SELECT feed_id, symbol, timestamp AS t, CASE WHEN timestamp - lag(timestamp) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM bars WHERE close IS NOT NULL WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY timestamp, bar_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY feed_id, symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM b)
SELECT feed_id, symbol, epoch_us(min(t)) AS start_us, epoch_us(max(t)) + 14400000000 AS end_us, count(*) AS n FROM s GROUP BY feed_id, symbol, i""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of readings at most four hours apart."""
    bars = _stream(spark, d, "bars", [*KEYS, "timestamp", "close"]).where("close IS NOT NULL")
    beats = fresh_path(spark, "sessions-end")
    s = run(R.sessions(ending(bars, "timestamp", beats), KEYS, "timestamp", "4 hours", "0 seconds"), "sessions", beats)
    return s.select(*KEYS, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
