"""The general problems' queries over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.bitemporal import attributes_as_known
from tidemill.operators.faults import flag_faults
from tidemill.operators.regrid import regular_grid
from tidemill.operators.rolling import distinct_times_per_day, latest_per_day, rolling_totals
from tidemill.operators.timestamps import normalise_timestamps
from tidemill.plans.base import rd
from tidemill.session import shared_dir, table

SERIES = ["feed_id", "symbol"]
TIME_FIELDS = ["published_at", "known_at", "sealed_before_market_data_through"]
TEN_DAYS_US = 10 * 86_400_000_000


def _with_zone(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "jurisdictions").select("jurisdiction", "time_zone", "date_order")
    return events.join(zones, "jurisdiction", "left")


def instants(spark: SparkSession) -> str:
    """Where the instants of time texts are kept: each text is parsed by the first run that meets it."""
    return f"{shared_dir(spark)}/instants"


def exposed_pairs(events: DataFrame) -> DataFrame:
    """One row per event and pair with an exposure other than 0: column ``symbol``."""
    keep = [c for c in events.columns if c != "pair_exposures"]
    pairs = F.map_keys(F.map_filter("pair_exposures", lambda _, v: v.isNotNull() & (v != 0)))
    return events.select(*keep, F.explode(pairs).alias("symbol"))


def p1_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record and exposed pair with the sigma_eps available at its time."""
    ev = table(spark, sf_dir, "legal_events").select("event_seq", "jurisdiction", "known_at", "assessment_created_at", "pair_exposures", "feed_id")
    ev = normalise_timestamps(_with_zone(ev, spark, sf_dir), "known_at", "time_zone", "date_order", "known_us", instants(spark))
    ev = ev.where(F.col("known_us").isNotNull() & F.col("assessment_created_at").isNotNull())
    ev = ev.withColumn("t", F.greatest(F.timestamp_micros("known_us"), F.col("assessment_created_at")))
    ev = exposed_pairs(ev.select("event_seq", "feed_id", "pair_exposures", "t"))
    params = table(spark, sf_dir, "dynamics_params").where("sigma_eps IS NOT NULL").select("param_id", *SERIES, "timestamp", "recorded_at", "sigma_eps")
    return attributes_as_known(ev, params, SERIES, "t", "t", "timestamp", "recorded_at", "param_id", ["param_id", "sigma_eps"], TEN_DAYS_US, prefix="")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_known(spark, sf_dir).select("event_seq", "param_id")


def p2_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7- and 30-day totals of both measures for each series and day."""
    valid = latest_per_day(table(spark, sf_dir, "dynamics_params"), SERIES, "timestamp", "recorded_at", "param_id", "n_valid_window")
    close = distinct_times_per_day(table(spark, sf_dir, "bars"), SERIES, "timestamp", "close")
    named = lambda d, n: d.select(F.lit(n).alias("measure"), *SERIES, "day", F.col("value").cast("long").alias("value"))
    return rolling_totals(named(valid, "n_valid_window").unionAll(named(close, "close")), ["measure", *SERIES], "day", "value", (7, 30))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = p2_rolling(spark, sf_dir).where("active AND 60 * total_7 < 7 * total_30")
    return cases.select("measure", *SERIES, F.date_format("day", "yyyy-MM-dd").alias("day"))


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "bars").where("close IS NOT NULL").select(*SERIES, "timestamp", "close")
    return bars.join(table(spark, sf_dir, "series").select(*SERIES, "bar_seconds"), SERIES)


def p3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular series of each source, from its first to its last reading."""
    g = regular_grid(_readings(spark, sf_dir), SERIES, "timestamp", "close", "bar_seconds")
    return g.withColumns({c: rd(c, 6) for c in ("own_support", "estimate", "support")})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regular_grid(_readings(spark, sf_dir), SERIES, "timestamp", "close", "bar_seconds", extent="day")
    return grid.where("missing").select(*SERIES, "period_start")


def p5_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every faulty bar with the kind of its fault."""
    bars = table(spark, sf_dir, "bars").select("bar_id", *SERIES, "timestamp", "close")
    return flag_faults(bars, SERIES, "timestamp", "close", "bar_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_faults(spark, sf_dir).select("bar_id")


def p6_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three time texts of every record, each with its instant or none."""
    ev = table(spark, sf_dir, "legal_events").select("event_seq", "jurisdiction", *TIME_FIELDS)
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in TIME_FIELDS)))
    rows = ev.select("event_seq", "jurisdiction", fields.alias("f")).select("event_seq", "jurisdiction", "f.field", "f.raw")
    return normalise_timestamps(_with_zone(rows, spark, sf_dir), "raw", "time_zone", "date_order", dictionary=instants(spark))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_instants(spark, sf_dir).where("instant_us IS NOT NULL").select("event_seq", "field", "instant_us")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p5_found, p6_found, p1_known, p2_rolling, p3_grid, p5_faults, p6_instants)}

_DAILY = """
WITH daily AS (
  SELECT 'n_valid_window' AS measure, feed_id, symbol, day, coalesce(nv, 0) AS value FROM (
    SELECT feed_id, symbol, (timestamp AT TIME ZONE 'UTC')::DATE AS day, n_valid_window AS nv,
      row_number() OVER (PARTITION BY feed_id, symbol, (timestamp AT TIME ZONE 'UTC')::DATE ORDER BY recorded_at DESC, param_id) AS rn
    FROM dynamics_params) WHERE rn = 1
  UNION ALL
  SELECT 'close', feed_id, symbol, (timestamp AT TIME ZONE 'UTC')::DATE, count(DISTINCT timestamp)
  FROM bars WHERE close IS NOT NULL GROUP BY ALL),
spans AS (SELECT measure, feed_id, symbol, min(day) AS a, max(day) AS b FROM daily GROUP BY ALL),
calendar AS (SELECT measure, feed_id, symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM spans),
dense AS (
  SELECT c.*, coalesce(d.value, 0) AS value, d.measure IS NOT NULL AS active
  FROM calendar c LEFT JOIN daily d USING (measure, feed_id, symbol, day)),
rolled AS (
  SELECT *, CAST(sum(value) OVER w7 AS BIGINT) AS total_7, CAST(sum(value) OVER w30 AS BIGINT) AS total_30 FROM dense
  WINDOW w7 AS (PARTITION BY measure, feed_id, symbol ORDER BY day ROWS 6 PRECEDING),
    w30 AS (PARTITION BY measure, feed_id, symbol ORDER BY day ROWS 29 PRECEDING))
"""

ORACLES = {
    "p2_found": _DAILY + "SELECT measure, feed_id, symbol, strftime(day, '%Y-%m-%d') AS day FROM rolled WHERE active AND 60 * total_7 < 7 * total_30",
    "p2_rolling": _DAILY + "SELECT measure, feed_id, symbol, day, CAST(value AS BIGINT) AS value, active, total_7, total_30, total_7 / 7.0::DOUBLE AS avg_7, total_30 / 30.0::DOUBLE AS avg_30 FROM rolled",
    "p3_grid": """
WITH r AS (
  SELECT b.feed_id, b.symbol, s.bar_seconds::BIGINT AS step_s, epoch_us(b.timestamp) // (s.bar_seconds::BIGINT * 1000000) AS p,
    epoch_us(b.timestamp) / (s.bar_seconds * 1000000.0::DOUBLE) AS x, b.close AS y
  FROM bars b JOIN series s USING (feed_id, symbol) WHERE close IS NOT NULL),
e AS (SELECT *, unnest(range(least(p, ceil(x - 2.5)::BIGINT), greatest(p, floor(x + 1.5)::BIGINT) + 1)) AS g FROM r),
k AS (SELECT *, x - 0.5 - g AS d, greatest(0.0::DOUBLE, 1 - pow((x - 0.5 - g) / 2.0::DOUBLE, 2)) AS w FROM e),
f AS (SELECT *, CASE WHEN isfinite(y) THEN w ELSE 0 END AS v, CASE WHEN isfinite(y) THEN y ELSE 0 END AS z, CASE WHEN g = p THEN w ELSE 0 END AS o FROM k),
m AS (
  SELECT feed_id, symbol, step_s, g, count(*) FILTER (g = p) AS n, sum(o) AS o0, sum(o * o) AS oq, sum(v) AS s0, sum(v * d) AS s1, sum(v * d * d) AS s2,
    sum(v * z) AS t0, sum(v * d * z) AS t1, sum(v * v) AS q FROM f GROUP BY ALL),
span AS (SELECT feed_id, symbol, step_s, min(g) FILTER (n > 0) AS a, max(g) FILTER (n > 0) AS b FROM m GROUP BY ALL),
cal AS (SELECT feed_id, symbol, step_s, unnest(range(a, b + 1)) AS g FROM span),
u AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(CASE WHEN oq > 0 THEN o0 * o0 / oq END, 0) AS own, coalesce(CASE WHEN q > 0 THEN s0 * s0 / q END, 0) AS sup, s0, s1, s2, t0, t1, s0 * s2 - s1 * s1 AS det
  FROM cal c LEFT JOIN m USING (feed_id, symbol, step_s, g))
SELECT feed_id, symbol, step_s, g * step_s AS period_start, n AS n_readings, round(own, 6) + 0.0 AS own_support, n = 0 AS missing,
  round(CASE WHEN sup < 1.5 THEN NULL WHEN s0 > 0 AND det > 1e-9 * s0 * s0 THEN (t0 * s2 - t1 * s1) / det WHEN s0 > 0 THEN t0 / s0 END, 6) + 0.0 AS estimate,
  round(sup, 6) + 0.0 AS support, sup >= 1.5 AS supported FROM u""",
    "p3_found": """
WITH r AS (
  SELECT DISTINCT b.feed_id, b.symbol, s.bar_seconds::BIGINT AS step,
    epoch_us(b.timestamp) // (s.bar_seconds::BIGINT * 1000000) AS p, epoch_us(b.timestamp) // 86400000000 AS d
  FROM bars b JOIN series s USING (feed_id, symbol) WHERE close IS NOT NULL),
n AS (SELECT *, lead(p) OVER (PARTITION BY feed_id, symbol, d ORDER BY p) AS nx FROM r)
SELECT feed_id, symbol, unnest(range(p + 1, nx)) * step AS period_start FROM n WHERE nx > p + 1""",
}
