"""Ingestion and ordered series queries."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import series as S
from tidemill.plans.base import EDGES, GRID, KEYS, WEEK_US, Registry, edges, grid, rd
from tidemill.session import materialize, table

query = Registry()
PAYLOAD = ["open", "high", "low", "close", "volume"]

_DAYS = "CAST(k * step // 86400 AS BIGINT)"


@query("SELECT bar_id, feed_id, symbol, epoch_us(timestamp) AS us, close FROM bars QUALIFY row_number() OVER (PARTITION BY feed_id, symbol, timestamp ORDER BY bar_id) = 1")
def dedupe_keep_first(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bars").select("bar_id", *KEYS, "timestamp", "close")
    return S.keep_first(b, [*KEYS, "timestamp"], "bar_id").select("bar_id", *KEYS, F.unix_micros("timestamp").alias("us"), "close")


@query("""
WITH r AS (SELECT *, row_number() OVER w AS rn, first(open) OVER w AS fo, first(high) OVER w AS fh, first(low) OVER w AS fl, first(close) OVER w AS fc, first(volume) OVER w AS fv
  FROM bars WINDOW w AS (PARTITION BY feed_id, symbol, timestamp ORDER BY bar_id))
SELECT feed_id, symbol, count(*) AS n_rows, count(*) FILTER (rn > 1) AS n_duplicates,
  count(*) FILTER (rn > 1 AND NOT (open IS NOT DISTINCT FROM fo AND high IS NOT DISTINCT FROM fh AND low IS NOT DISTINCT FROM fl AND close IS NOT DISTINCT FROM fc AND volume IS NOT DISTINCT FROM fv)) AS n_conflicts
FROM r GROUP BY ALL""")
def duplicate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_report(table(spark, d, "bars"), [*KEYS, "timestamp"], KEYS, PAYLOAD, "bar_id")


@query("SELECT bar_id, open, high, low, close FROM bars WHERE high < greatest(open, close, low) OR low > least(open, close, high)")
def ohlc_violations(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "bars").select("bar_id", "open", "high", "low", "close")
    return b.where("high < greatest(open, close, low) OR low > least(open, close, high)")


@query("""
WITH c AS (SELECT count(*) AS n_rows, count(*) FILTER (close IS NULL) AS a, count(*) FILTER (NOT (close > 0)) AS b, count(*) FILTER (NOT (volume >= 0)) AS c,
  count(*) FILTER (NOT (timestamp >= TIMESTAMPTZ '2015-01-01 00:00:00+00' AND timestamp < TIMESTAMPTZ '2025-01-01 00:00:00+00')) AS d, count(*) FILTER (NOT (epoch_us(timestamp) % 60000000 = 0)) AS e FROM bars)
SELECT unnest(['close_present', 'close_positive', 'volume_not_negative', 'time_in_range', 'minute_aligned']) AS rule, unnest([a, b, c, d, e]) AS violations, n_rows FROM c""")
def constraint_report(spark: SparkSession, d: str) -> DataFrame:
    return S.constraints(table(spark, d, "bars").select("timestamp", "close", "volume"), {
        "close_present": "close IS NOT NULL", "close_positive": "close > 0", "volume_not_negative": "volume >= 0",
        "time_in_range": "timestamp >= '2015-01-01' AND timestamp < '2025-01-01'", "minute_aligned": "unix_micros(timestamp) % 60000000 = 0",
    })


@query(f"WITH {GRID} SELECT feed_id, symbol, step, k, close, CAST(n AS BIGINT) AS n FROM g")
def bars_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).select(*KEYS, "step", "k", "close", "n")


@query("SELECT bar_id, feed_id, symbol, close FROM bars WHERE timestamp >= TIMESTAMPTZ '2024-10-07 00:00:00+00' AND timestamp < TIMESTAMPTZ '2024-10-14 00:00:00+00'")
def scan_time_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bars").where("timestamp >= timestamp'2024-10-07' AND timestamp < timestamp'2024-10-14'").select("bar_id", *KEYS, "close")


@query("""
WITH r AS (SELECT feed_id, symbol, timestamp, bar_id, close, row_number() OVER (PARTITION BY feed_id, symbol ORDER BY timestamp DESC, bar_id DESC) AS rn FROM bars WHERE close IS NOT NULL)
SELECT feed_id, symbol, bar_id, close FROM r WHERE rn <= 50""")
def latest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last 50 readings of each series."""
    w = W.partitionBy(*KEYS).orderBy(F.col("timestamp").desc(), F.col("bar_id").desc())
    b = table(spark, d, "bars").where("close IS NOT NULL").select(*KEYS, "timestamp", "bar_id", "close")
    return b.withColumn("rn", F.row_number().over(w)).where("rn <= 50").select(*KEYS, "bar_id", "close")


@query(f"WITH {EDGES} SELECT feed_id, symbol, k, round(ret, 9) + 0.0 AS ret FROM e")
def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(*KEYS, "k", rd("ret").alias("ret"))


@query(f"WITH {EDGES} SELECT feed_id, symbol, k, contiguous, two_step, NOT contiguous AS post_gap FROM e")
def gap_flags(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select(*KEYS, "k", "contiguous", "two_step", (~F.col("contiguous")).alias("post_gap"))


@query(f"""
WITH {EDGES}, v AS (SELECT *, ret / step AS v FROM e)
SELECT feed_id, symbol, k, round(v * 1e6, 6) + 0.0 AS v, round(CASE WHEN two_step THEN (v - lag(v) OVER (PARTITION BY feed_id, symbol ORDER BY k)) / step END * 1e9, 6) + 0.0 AS a FROM v""")
def kinematics(spark: SparkSession, d: str) -> DataFrame:
    return S.kinematics(edges(spark, d), KEYS).select(*KEYS, "k", rd(F.col("v") * 1e6, 6).alias("v"), rd(F.col("a") * 1e9, 6).alias("a"))


@query(f"WITH {EDGES} SELECT feed_id, symbol, segment_id, min(k) AS first_k, max(k) AS last_k, count(*) AS n FROM e GROUP BY ALL")
def segment_ranges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy(*KEYS, "segment_id").agg(F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.count(F.lit(1)).alias("n"))


_EWMA = """
w AS (SELECT *, pow(2.0, (k - min(k) OVER (PARTITION BY feed_id, symbol)) * step / 86400.0) AS q FROM e),
m AS (SELECT *, sum(q * x) OVER a / sum(q) OVER a AS x_eq FROM w WINDOW a AS (PARTITION BY feed_id, symbol ORDER BY k ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {EDGES}, {_EWMA} SELECT feed_id, symbol, k, round(x_eq, 8) + 0.0 AS x_eq, round(x - x_eq, 8) + 0.0 AS displacement FROM m")
def ewma_wall_clock(spark: SparkSession, d: str) -> DataFrame:
    """Equilibrium price, half life one day, and the displacement from it."""
    m = S.ewma_wall(grid(spark, d), KEYS, "x", 86_400.0, "x_eq")
    return m.select(*KEYS, "k", rd("x_eq", 8).alias("x_eq"), rd(F.col("x") - F.col("x_eq"), 8).alias("displacement"))


@query(f"""
WITH {EDGES}, i AS (SELECT *, row_number() OVER s AS i FROM e WINDOW s AS (PARTITION BY feed_id, symbol, segment_id ORDER BY k)),
r AS (SELECT *, sum(pow(pow(2.0, -1 / 1440.0), -i) * coalesce(ret * ret, 0)) OVER (PARTITION BY feed_id, symbol, segment_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM i)
SELECT feed_id, symbol, k, round(1e8 * pow(pow(2.0, -1 / 1440.0), i) * (1e-8 + (1 - pow(2.0, -1 / 1440.0)) * s), 6) + 0.0 AS variance FROM r""")
def ewma_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Recursive variance of returns, half life 1440 rows, anew at each gap."""
    e = edges(spark, d).withColumn("r2", F.col("ret") * F.col("ret"))
    v = S.ewma_recursive(e, [*KEYS, "segment_id"], "r2", 1440.0, 1e-8, "variance")
    return v.select(*KEYS, "k", rd(F.col("variance") * 1e8, 6).alias("variance"))


@query(f"""
WITH {EDGES} SELECT feed_id, symbol, k, round(1e6 * sum(coalesce(ret * ret, 0)) OVER (PARTITION BY feed_id, symbol ORDER BY k ROWS 499 PRECEDING), 3) + 0.0 AS sum_500,
  round(1e6 * sum(coalesce(ret * ret, 0)) OVER (PARTITION BY feed_id, symbol ORDER BY k ROWS 19 PRECEDING), 3) + 0.0 AS sum_20 FROM e""")
def trailing_sums(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    for n in (500, 20):
        e = S.trailing_sums(e, KEYS, {f"sum_{n}": F.col("ret") * F.col("ret")}, n)
    return e.select(*KEYS, "k", *(rd(F.col(f"sum_{n}") * 1e6, 3).alias(f"sum_{n}") for n in (500, 20)))


@query(f"""
WITH {EDGES}, {_EWMA}, l AS (SELECT *, lag(x - x_eq) OVER w AS d1, lag(ret) OVER w AS r1, CASE WHEN two_step THEN ret - lag(ret) OVER w END AS y FROM m WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k)),
o AS (SELECT *, y IS NOT NULL AND d1 IS NOT NULL AND r1 IS NOT NULL AS ok FROM l),
t AS (SELECT feed_id, symbol, k, count(*) FILTER (ok) OVER w AS n, sum(d1 * d1) FILTER (ok) OVER w AS s11, sum(r1 * r1) FILTER (ok) OVER w AS s22, sum(d1 * r1) FILTER (ok) OVER w AS s12, sum(d1 * y) FILTER (ok) OVER w AS s1y, sum(r1 * y) FILTER (ok) OVER w AS s2y
  FROM o WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k ROWS 299 PRECEDING))
SELECT feed_id, symbol, k, CAST(n AS BIGINT) AS n_valid, round(CASE WHEN good THEN (s1y * s22 - s2y * s12) / det END, 5) + 0.0 AS b1, round(CASE WHEN good THEN (s2y * s11 - s1y * s12) / det END, 5) + 0.0 AS b2, round(CASE WHEN good THEN s2y / s22 END, 5) + 0.0 AS b2_only
FROM (SELECT *, s11 * s22 - s12 * s12 AS det, n >= 100 AND s11 * s22 - s12 * s12 > 0 AND s11 > 0 AND s22 > 0 AS good FROM t)""")
def rolling_ols(spark: SparkSession, d: str) -> DataFrame:
    """Second difference on displacement and first difference, over 300 rows."""
    w = S.ordered(KEYS)
    m = S.ewma_wall(edges(spark, d), KEYS, "x", 86_400.0, "x_eq")
    m = m.withColumns({"d1": F.lag(F.col("x") - F.col("x_eq")).over(w), "r1": F.lag("ret").over(w), "y": F.when(F.col("two_step"), F.col("ret") - F.lag("ret").over(w))})
    o = S.rolling_ols(m, KEYS, "y", "d1", "r1", 300, 100)
    return o.select(*KEYS, "k", F.round("n_valid").cast("long").alias("n_valid"), *(rd(c, 5).alias(c) for c in ("b1", "b2", "b2_only")))


@query(f"""
WITH {EDGES}, v AS (SELECT *, row_number() OVER (PARTITION BY feed_id, symbol ORDER BY k) AS i FROM e WHERE ret IS NOT NULL)
SELECT feed_id, symbol, k, count(*) OVER w AS n, round(1e6 * sum(ret) OVER w, 2) + 0.0 AS s1, round(1e6 * sum(ret * ret) OVER w, 2) + 0.0 AS s2 FROM v WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY i ROWS 99 PRECEDING)""")
def valid_sample_window(spark: SparkSession, d: str) -> DataFrame:
    """Moments of the last 100 valid samples, whatever gaps lie between."""
    v = edges(spark, d).where("ret IS NOT NULL")
    n = F.count(F.lit(1)).over(S.ordered(KEYS).rowsBetween(-99, 0))
    v = S.trailing_sums(v.withColumn("n", n), KEYS, {"s1": F.col("ret"), "s2": F.col("ret") * F.col("ret")}, 100)
    return v.select(*KEYS, "k", "n", *(rd(F.col(c) * 1e6, 2).alias(c) for c in ("s1", "s2")))


@query(f"""
WITH {EDGES}, f AS (SELECT *, last(ret IGNORE NULLS) OVER (PARTITION BY feed_id, symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS held FROM e)
SELECT feed_id, symbol, k, round(1e4 * abs(held), 6) + 0.0 AS volatility, round(CASE WHEN held <> 0 THEN greatest(0.1, least(10.0, 1e-8 / (held * held))) END, 6) + 0.0 AS mass FROM f""")
def mass_clip(spark: SparkSession, d: str) -> DataFrame:
    """Volatility held across gaps and the clipped equipartition mass (1e-4)² / σ²."""
    held = F.last("ret", ignorenulls=True).over(S.ordered(KEYS).rowsBetween(W.unboundedPreceding, 0))
    f = edges(spark, d).withColumn("held", held)
    mass = S.clip(F.expr("CASE WHEN held <> 0 THEN 1e-8D / (held * held) END"), 0.1, 10.0)
    return f.select(*KEYS, "k", rd(F.abs("held") * 1e4, 6).alias("volatility"), rd(mass, 6).alias("mass"))


_HOW = "CAST((k * step // 3600 + 72) % 168 AS INTEGER)"


@query(f"""
WITH {EDGES}, h AS (SELECT *, {_HOW} AS how, abs(ret) AS r FROM e WHERE ret IS NOT NULL),
p AS (SELECT *, count(*) OVER b AS nb, avg(r) OVER b AS mb, count(*) OVER a AS na, avg(r) OVER a AS ma FROM h
  WINDOW b AS (PARTITION BY feed_id, symbol, how ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY feed_id, symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feed_id, symbol, k, how, round(CASE WHEN nb >= 5 AND na >= 50 AND ma > 0 THEN greatest(0.1, least(10.0, mb / ma)) ELSE 1.0 END, 7) + 0.0 AS season FROM p""")
def seasonality(spark: SparkSession, d: str) -> DataFrame:
    """Strictly prior mean of the hour of week against the prior overall mean."""
    h = edges(spark, d).where("ret IS NOT NULL").select(*KEYS, "k", S.hour_of_week().alias("how"), F.abs("ret").alias("r"))
    past = lambda keys: S.ordered(keys).rowsBetween(W.unboundedPreceding, -1)
    b, a = past([*KEYS, "how"]), past(KEYS)
    h = h.withColumns({"nb": F.count("r").over(b), "mb": F.avg("r").over(b), "na": F.count("r").over(a), "ma": F.avg("r").over(a)})
    season = F.when(F.expr("nb >= 5 AND na >= 50 AND ma > 0"), S.clip(F.expr("try_divide(mb, ma)"), 0.1, 10.0)).otherwise(1.0)
    return h.select(*KEYS, "k", "how", rd(season, 7).alias("season"))


@query(f"""
WITH {EDGES}, h AS (SELECT feed_id, symbol, {_HOW} AS how, avg(abs(ret)) AS m FROM e WHERE ret IS NOT NULL GROUP BY ALL),
b AS (SELECT feed_id, symbol, avg(m) AS mm FROM h GROUP BY ALL)
SELECT h.feed_id, h.symbol, h.how, round(m / mm, 7) + 0.0 AS profile FROM h JOIN b USING (feed_id, symbol) WHERE mm > 0""")
def seasonal_profile(spark: SparkSession, d: str) -> DataFrame:
    h = edges(spark, d).where("ret IS NOT NULL").groupBy(*KEYS, S.hour_of_week().alias("how")).agg(F.avg(F.abs("ret")).alias("m"))
    h = h.withColumn("mm", F.avg("m").over(W.partitionBy(*KEYS))).where("mm > 0")  # at most 168 rows a series
    return h.select(*KEYS, "how", rd(F.col("m") / F.col("mm"), 7).alias("profile"))


@query(f"""
WITH {EDGES}, l AS (SELECT *, {", ".join(f"CASE WHEN k - lag(k, {n}) OVER w = {n} THEN lag(ret, {n}) OVER w END AS l{n}" for n in (1, 2, 3))} FROM e WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k))
SELECT feed_id, symbol, lag, pairs, round(acf, 7) + 0.0 AS acf FROM (
  {" UNION ALL ".join(f"SELECT feed_id, symbol, {n} AS lag, count(*) FILTER (ret IS NOT NULL AND l{n} IS NOT NULL) AS pairs, CASE WHEN count(*) FILTER (ret IS NOT NULL AND l{n} IS NOT NULL) >= 200 THEN corr(ret, l{n}) END AS acf FROM l GROUP BY feed_id, symbol" for n in (1, 2, 3))})""")
def acf_gap_aware(spark: SparkSession, d: str) -> DataFrame:
    a = S.acf_gap_aware(edges(spark, d), KEYS, "ret", (1, 2, 3), 200)
    return a.select(*KEYS, "lag", "pairs", rd("acf", 7).alias("acf"))


@query(f"""
WITH {EDGES} SELECT feed_id, symbol, count(ret) AS n, round(1e4 * avg(ret), 6) + 0.0 AS mean, round(1e4 * stddev_samp(ret), 6) + 0.0 AS std, round(1e4 * stddev_pop(ret), 6) + 0.0 AS std_pop,
  round(skewness(ret), 5) + 0.0 AS skew, round(kurtosis(ret), 5) + 0.0 AS kurtosis FROM e WHERE ret IS NOT NULL GROUP BY ALL HAVING count(ret) > 10""")
def moments_bias_corrected(spark: SparkSession, d: str) -> DataFrame:
    m = S.moments(edges(spark, d), KEYS, "ret").where("n > 10")
    return m.select(*KEYS, "n", *(rd(F.col(c) * 1e4, 6).alias(c) for c in ("mean", "std", "std_pop")), rd("skew", 5).alias("skew"), rd("kurtosis", 5).alias("kurtosis"))


@query(f"""
WITH {EDGES} SELECT feed_id, symbol, {", ".join(f"round(1e4 * quantile_cont(ret, {p / 100}), 6) + 0.0 AS p{p}" for p in (5, 25, 50, 75, 95))} FROM e WHERE ret IS NOT NULL GROUP BY ALL""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    ps = (5, 25, 50, 75, 95)
    a = edges(spark, d).where("ret IS NOT NULL").groupBy(*KEYS).agg(F.percentile("ret", [p / 100 for p in ps]).alias("q"))
    return a.select(*KEYS, *(rd(F.col("q")[i] * 1e4, 6).alias(f"p{p}") for i, p in enumerate(ps)))


@query(f"""
WITH {EDGES}, l AS (SELECT *, lag(ret) OVER (PARTITION BY feed_id, symbol ORDER BY k) AS r1 FROM e),
b AS (SELECT feed_id, symbol, sum(ret * r1) / sum(r1 * r1) AS beta FROM l WHERE two_step GROUP BY ALL HAVING sum(r1 * r1) > 0)
SELECT feed_id, symbol, count(*) AS n, round(beta, 7) + 0.0 AS beta, round(1 - sum((ret - beta * r1) * (ret - beta * r1)) / sum(ret * ret), 7) + 0.0 AS r2 FROM l JOIN b USING (feed_id, symbol) WHERE two_step GROUP BY feed_id, symbol, beta HAVING sum(ret * ret) > 0""")
def r2_uncentered(spark: SparkSession, d: str) -> DataFrame:
    """R² of the return on the return before, from one pass of moments."""
    l = edges(spark, d).withColumn("r1", F.lag("ret").over(S.ordered(KEYS))).where("two_step")
    m = l.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("ret * r1")).alias("xy"), F.sum(F.expr("r1 * r1")).alias("xx"), F.sum(F.expr("ret * ret")).alias("yy"))
    m = m.where("xx > 0 AND yy > 0")
    return m.select(*KEYS, "n", rd(F.expr("xy / xx"), 7).alias("beta"), rd(F.expr("xy * xy / (xx * yy)"), 7).alias("r2"))


@query(f"""
WITH {EDGES}, {_EWMA}, l AS (SELECT *, lag(x - x_eq) OVER w AS d1, lag(ret) OVER w AS r1, CASE WHEN two_step THEN ret - lag(ret) OVER w END AS y FROM m WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k)),
s AS (SELECT feed_id, symbol, count(*) AS n, sum(d1 * d1) AS s11, sum(r1 * r1) AS s22, sum(d1 * r1) AS s12, sum(d1 * y) AS s1y, sum(r1 * y) AS s2y, sum(y * y) AS syy FROM l WHERE y IS NOT NULL AND d1 IS NOT NULL AND r1 IS NOT NULL GROUP BY ALL),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s WHERE n >= 100 AND syy > 0 AND s22 > 0 AND s11 * s22 - s12 * s12 > 0)
SELECT feed_id, symbol, n, round(1e6 * (syy - b1 * s1y - b2 * s2y), 5) + 0.0 AS sse, round((b1 * s1y + b2 * s2y) / syy, 6) + 0.0 AS r2, round(s2y * s2y / (s22 * syy), 6) + 0.0 AS r2_damping,
  round((b1 * s1y + b2 * s2y) / syy - s2y * s2y / (s22 * syy), 6) + 0.0 AS r2_spring FROM b""")
def incremental_r2(spark: SparkSession, d: str) -> DataFrame:
    """Squared error and uncentred R² of the second difference on displacement (spring) and
    first difference (damping), of damping alone, and what the spring adds to it."""
    w = S.ordered(KEYS)
    m = S.ewma_wall(edges(spark, d), KEYS, "x", 86_400.0, "x_eq")
    m = m.select(*KEYS, F.lag(F.col("x") - F.col("x_eq")).over(w).alias("d1"), F.lag("ret").over(w).alias("r1"), F.when(F.col("two_step"), F.col("ret") - F.lag("ret").over(w)).alias("y"))
    t = lambda a, b, n: F.sum(F.col(a) * F.col(b)).alias(n)
    s = m.dropna(subset=["d1", "r1", "y"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), t("d1", "d1", "s11"), t("r1", "r1", "s22"), t("d1", "r1", "s12"), t("d1", "y", "s1y"), t("r1", "y", "s2y"), t("y", "y", "syy"))
    s = s.withColumn("det", F.expr("s11 * s22 - s12 * s12")).where("n >= 100 AND syy > 0 AND s22 > 0 AND det > 0")
    s = s.withColumns({"by": F.expr("((s1y * s22 - s2y * s12) * s1y + (s2y * s11 - s1y * s12) * s2y) / det"), "damping": F.expr("s2y * s2y / (s22 * syy)")})
    return s.select(*KEYS, "n", rd(F.expr("1e6 * (syy - by)"), 5).alias("sse"), rd(F.expr("by / syy"), 6).alias("r2"), rd("damping", 6).alias("r2_damping"), rd(F.expr("by / syy - damping"), 6).alias("r2_spring"))


#: Degrees of freedom and scales of the likelihood grid, both in equal steps of their logarithm.
NUS, SCALES = [round(1.05 * 1.06**i, 6) for i in range(68)], [round(0.25 * 1.085**i, 6) for i in range(25)]
_COARSE = 8


@query(f"""
WITH {EDGES}, v AS (SELECT feed_id, symbol, stddev_pop(ret) AS sd FROM e WHERE ret IS NOT NULL GROUP BY ALL HAVING stddev_pop(ret) > 0), z AS (SELECT e.feed_id, e.symbol, pow(ret / sd, 2) AS z2 FROM e JOIN v USING (feed_id, symbol) WHERE ret IS NOT NULL),
p AS (SELECT unnest({NUS})::DOUBLE AS nu), s AS (SELECT unnest({SCALES})::DOUBLE AS sc),
l AS (SELECT feed_id, symbol, nu, sc, count(*) * (lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * ln(nu * pi()) - ln(sc)) - (nu + 1) / 2 * sum(ln(1 + z2 / (sc * sc * nu))) AS ll FROM z, p, s GROUP BY feed_id, symbol, nu, sc)
SELECT feed_id, symbol, nu, sc AS scale FROM l QUALIFY row_number() OVER (PARTITION BY feed_id, symbol ORDER BY ll DESC, nu, sc) = 1""")
def student_t_grid(spark: SparkSession, d: str) -> DataFrame:
    """Student-t fit of standardised returns: the cell of largest likelihood of 68 degrees of
    freedom and 25 scales.

    First a coarse grid over all of it, then the cells around the best one so far, which
    differ by series, until no series moves: the likelihood has one peak.  Each is one aggregate of the rows;
    rows are never multiplied by the grid, and a cell's constants are added afterwards.
    """
    e = edges(spark, d).where("ret IS NOT NULL").select(*KEYS, "ret")
    sd = e.groupBy(*KEYS).agg(F.stddev_pop("ret").alias("sd")).where("sd > 0")
    z = materialize(e.join(sd, KEYS).select(*KEYS, F.pow(F.col("ret") / F.col("sd"), 2).alias("z2")), "returns")  # read five times
    constant = [math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in NUS]
    coarse = [(i, j) for i in range(0, len(NUS), _COARSE) for j in range(0, len(SCALES), 4)]
    out = T.StructType([*(z.schema[k] for k in KEYS), T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])

    def around(i: int, j: int, wide: int, tall: int) -> list[tuple[int, int]]:
        inside = lambda v, n: min(max(v, 0), n - 1)
        return [(inside(i + a * wide, len(NUS)), inside(j + b * tall, len(SCALES))) for a in range(-2, 3) for b in range(-2, 3)]

    def best(rows: DataFrame, q: list[Column], shape: tuple[int, int] | None) -> DataFrame:
        keys = [*KEYS, "i", "j"] if shape else KEYS
        s = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.ln(1 + F.col("z2") / v)) for v in q)).alias("l"))

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = []
                for r in b.to_pylist():
                    cells = around(r["i"], r["j"], *shape) if shape else coarse
                    got.append(max((r["n"] * (constant[i] - math.log(SCALES[j])) - (NUS[i] + 1) / 2 * l, -i, -j) for (i, j), l in zip(cells, r["l"])))
                yield pa.RecordBatch.from_arrays([b["feed_id"], b["symbol"], pa.array([-g[1] for g in got], pa.int64()), pa.array([-g[2] for g in got], pa.int64())], out.names)

        return materialize(s.mapInArrow(choose, out), "cells")  # a row a series

    found = best(z, [F.lit(SCALES[j] * SCALES[j] * NUS[i]) for i, j in coarse], None)
    nu, scale = (F.array(*map(F.lit, v)) for v in (NUS, SCALES))
    shape, before = (3, 2), None
    for _ in range(len(NUS) + len(SCALES)):  # as many steps as the grid is wide; a few are enough
        if before is not None and found.join(before, [*KEYS, "i", "j"], "left_anti").isEmpty():
            break
        before = found if shape == (1, 1) else None
        move = lambda c, n, w: F.array(*(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + a * w)).cast("int") + 1 for a in range(-2, 3)))
        near = found.select(*KEYS, "i", "j", move("i", len(NUS), shape[0]).alias("ci"), move("j", len(SCALES), shape[1]).alias("cj"))
        near = near.select(*KEYS, "i", "j", F.transform("ci", lambda c: F.element_at(nu, c)).alias("ci"), F.transform("cj", lambda c: F.element_at(scale, c)).alias("cj"))
        q = [F.col("cj")[b] * F.col("cj")[b] * F.col("ci")[a] for a in range(5) for b in range(5)]
        found, shape = best(z.join(near, KEYS), q, shape), (1, 1)
    return found.select(*KEYS, F.element_at(nu, (F.col("i") + 1).cast("int")).alias("nu"), F.element_at(scale, (F.col("j") + 1).cast("int")).alias("scale"))


@query(f"""
WITH {EDGES}, i AS (SELECT feed_id, symbol, k, row_number() OVER (PARTITION BY feed_id, symbol ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY feed_id, symbol) AS n FROM g),
j AS (SELECT unnest(range(25)) AS j), t AS (SELECT DISTINCT feed_id, symbol, n, CAST(floor(j * (n - 1) / 24.0) AS BIGINT) AS i FROM (SELECT DISTINCT feed_id, symbol, n FROM i), j)
SELECT feed_id, symbol, k FROM i JOIN t USING (feed_id, symbol, n, i)""")
def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    """25 evenly placed rows of each series."""
    return S.even_positions(grid(spark, d).select(*KEYS, "k"), KEYS, "k", 25)


@query(f"WITH {GRID} SELECT feed_id, symbol, k, close FROM g QUALIFY (row_number() OVER (PARTITION BY feed_id, symbol ORDER BY k) - 1) % 7 = 0")
def stride_subsample(spark: SparkSession, d: str) -> DataFrame:
    g = grid(spark, d).withColumn("i", F.row_number().over(S.ordered(KEYS)) - 1)
    return g.where("pmod(i, 7) = 0").select(*KEYS, "k", "close")


@query(f"WITH {EDGES} SELECT feed_id, symbol, {_DAYS} AS day, count(*) AS n, count(ret) AS n_ret, round(1e4 * sum(abs(ret)), 5) + 0.0 AS path, max(close) AS high, min(close) AS low FROM e GROUP BY ALL")
def daily_rollup(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("cast(floor(k * step / 86400) as bigint)").alias("day")
    return edges(spark, d).groupBy(*KEYS, day).agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("n_ret"), rd(F.sum(F.abs("ret")) * 1e4, 5).alias("path"), F.max("close").alias("high"), F.min("close").alias("low"))


@query(f"WITH {GRID} SELECT feed_id, symbol, {_DAYS} AS day, arg_max(close, k) AS last_close, arg_min(close, k) AS first_close, max(k) AS last_k FROM g GROUP BY ALL")
def first_last_per_day(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("cast(floor(k * step / 86400) as bigint)").alias("day")
    return grid(spark, d).groupBy(*KEYS, day).agg(F.max_by("close", "k").alias("last_close"), F.min_by("close", "k").alias("first_close"), F.max("k").alias("last_k"))


@query(f"""
WITH {EDGES} SELECT feed_id, symbol, CASE WHEN NOT contiguous THEN 'post_gap_reset_skip' WHEN NOT next_ok THEN 'pre_gap_skip' WHEN abs(ret) < 1e-5 THEN 'quiet' ELSE 'scored' END AS reason, count(*) AS n
FROM (SELECT *, coalesce(lead(contiguous) OVER (PARTITION BY feed_id, symbol ORDER BY k), false) AS next_ok FROM e) GROUP BY ALL""")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reason codes, the first that fits, counted from the rows."""
    e = edges(spark, d).withColumn("next_ok", F.coalesce(F.lead("contiguous").over(S.ordered(KEYS)), F.lit(False)))
    reason = F.when(~F.col("contiguous"), "post_gap_reset_skip").when(~F.col("next_ok"), "pre_gap_skip").when(F.abs("ret") < 1e-5, "quiet").otherwise("scored")
    return e.groupBy(*KEYS, reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {EDGES}, l AS (SELECT *, lag(ret) OVER (PARTITION BY feed_id, symbol ORDER BY k) AS r1 FROM e),
p AS (SELECT *, CASE WHEN two_step THEN ret - 0.1 * r1 END AS eps, {_HOW} AS how FROM l),
v AS (SELECT *, sqrt(avg(eps * eps) OVER (PARTITION BY feed_id, symbol ORDER BY k ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)) AS sd, avg(abs(ret)) OVER (PARTITION BY feed_id, symbol, how) / nullif(avg(abs(ret)) OVER (PARTITION BY feed_id, symbol), 0) AS season FROM p)
SELECT feed_id, symbol, k, round(CASE WHEN sd > 0 AND season > 0 THEN eps / (sd * sqrt(season)) END, 5) + 0.0 AS z FROM v""")
def innovations(spark: SparkSession, d: str) -> DataFrame:
    """Residuals standardised by the scale before them and the root of their season."""
    e = edges(spark, d).withColumn("r1", F.lag("ret").over(S.ordered(KEYS))).withColumns({"eps": F.when(F.col("two_step"), F.col("ret") - 0.1 * F.col("r1")), "how": S.hour_of_week()})
    sd = F.sqrt(F.avg(F.col("eps") * F.col("eps")).over(S.ordered(KEYS).rowsBetween(-50, -1)))
    # the seasons of a series are at most 168 rows: aggregated, then joined back
    h = e.where("ret IS NOT NULL").groupBy(*KEYS, "how").agg(F.sum(F.abs("ret")).alias("s"), F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*KEYS)
    h = h.select(*KEYS, "how", F.expr("s / c").alias("mh"), (F.sum("s").over(w) / F.sum("c").over(w)).alias("m"))
    h = h.select(*KEYS, "how", F.when(F.col("m") > 0, F.col("mh") / F.col("m")).alias("season"))
    e = e.withColumn("sd", sd).join(h, [*KEYS, "how"], "left")
    return e.select(*KEYS, "k", rd(F.when(F.expr("sd > 0 AND season > 0"), F.col("eps") / (F.col("sd") * F.sqrt("season"))), 5).alias("z"))


@query(f"""
WITH {GRID}, h AS (SELECT symbol, CAST(k * step // 14400 AS BIGINT) AS h, feed_id, arg_max(close, k) AS close FROM g GROUP BY ALL),
p AS (SELECT symbol, h, median(close) AS close FROM h GROUP BY ALL), b AS (SELECT h AS bound FROM p WHERE symbol = 'EURUSD' ORDER BY h DESC LIMIT 1 OFFSET 59),
j AS (SELECT h, max(close) FILTER (symbol = 'EURUSD') AS EURUSD, max(close) FILTER (symbol = 'USDJPY') AS USDJPY FROM p, b WHERE h >= bound GROUP BY h)
SELECT h, EURUSD, USDJPY FROM j WHERE EURUSD IS NOT NULL AND USDJPY IS NOT NULL""")
def latest_common(spark: SparkSession, d: str) -> DataFrame:
    """The last 60 instants of the first symbol bound the scan, then the panel is inner."""
    h = F.expr("cast(floor(k * step / 14400) as bigint)").alias("h")
    p = grid(spark, d).where("symbol IN ('EURUSD', 'USDJPY')").groupBy(*KEYS, h).agg(F.max_by("close", "k").alias("close")).groupBy("symbol", "h").agg(F.median("close").alias("close"))
    last = p.where("symbol = 'EURUSD'").orderBy(F.col("h").desc()).limit(60).agg(F.min("h").alias("bound"), F.count(F.lit(1)).alias("n")).where("n = 60")
    from tidemill.operators.joins import panel

    return panel(p.join(F.broadcast(last), F.lit(True)).where("h >= bound"), "h", "symbol", ["EURUSD", "USDJPY"], "close")


@query("""
WITH i AS (SELECT unnest(range(900)) AS i), r AS (SELECT i, CASE WHEN i >= 500 THEN i + 1 ELSE i END AS t, (i * 7919 % 1000 - 500) / 1e6 AS a, (i * 104729 % 1000 - 500) / 1e6 AS b FROM i),
x AS (SELECT t, sum(a) OVER (ORDER BY i) AS ea, sum(b) OVER (ORDER BY i) AS gb FROM r)
SELECT t, round(ea, 9) + 0.0 AS EURUSD, round(gb, 9) + 0.0 AS GBPUSD, round(ea - gb, 9) + 0.0 AS EURGBP FROM x""")
def synthetic_panel(spark: SparkSession, d: str) -> DataFrame:
    """900 rows of a closed triangle with one gap at row 500, from a rule."""
    r = spark.range(900).select(F.col("id").alias("i"), F.expr("IF(id >= 500, id + 1, id)").alias("t"), F.expr("(id * 7919 % 1000 - 500) / 1e6D").alias("a"), F.expr("(id * 104729 % 1000 - 500) / 1e6D").alias("b"))
    w = W.partitionBy(F.lit(0)).orderBy("i").rowsBetween(W.unboundedPreceding, 0)  # 900 rows whatever the data
    x = r.select("t", F.sum("a").over(w).alias("ea"), F.sum("b").over(w).alias("gb"))
    return x.select("t", rd("ea").alias("EURUSD"), rd("gb").alias("GBPUSD"), rd(F.col("ea") - F.col("gb")).alias("EURGBP"))


@query(f"""
WITH {EDGES}, p AS (SELECT feed_id, symbol, timestamp FROM dynamics_params WHERE kappa IS NOT NULL GROUP BY ALL),
a AS (SELECT e.*, lead(e.contiguous) OVER (PARTITION BY e.feed_id, e.symbol ORDER BY e.k) AS nx, e.k * e.step * 1000000 - epoch_us(p.timestamp) AS age
  FROM e ASOF LEFT JOIN p ON e.feed_id = p.feed_id AND e.symbol = p.symbol AND make_timestamptz(e.k * e.step * 1000000) >= p.timestamp)
SELECT feed_id, symbol, k, CASE WHEN NOT contiguous THEN 'post_gap_reset_skip' WHEN NOT coalesce(nx, false) THEN 'pre_gap_skip' WHEN age IS NULL OR age > 129600000000 THEN 'stale_coupling_skip'
  WHEN k % 5 = 0 THEN 'selected' ELSE 'eligible_unselected' END AS reason FROM a""")
def candidate_reasons(spark: SparkSession, d: str) -> DataFrame:
    """A reason for every row: gap behind it, gap ahead, parameters over 36 hours old, else
    whether the stride selects it."""
    from tidemill.operators.joins import asof

    e = edges(spark, d).withColumns({"nx": F.lead("contiguous").over(S.ordered(KEYS)), "us": F.col("k") * F.col("step") * 1_000_000})
    p = table(spark, d, "dynamics_params").where("kappa IS NOT NULL").select(*KEYS, F.unix_micros("timestamp").alias("t"))
    a = asof(e.select(*KEYS, "k", "contiguous", "nx", "us"), p, KEYS, "us", "t", ["t"], max_age=129_600_000_000.0, slot=WEEK_US)
    reason = F.when(~F.col("contiguous"), "post_gap_reset_skip").when(~F.coalesce("nx", F.lit(False)), "pre_gap_skip").when(F.col("t").isNull(), "stale_coupling_skip")
    return a.select(*KEYS, "k", reason.when(F.expr("k % 5 = 0"), "selected").otherwise("eligible_unselected").alias("reason"))
