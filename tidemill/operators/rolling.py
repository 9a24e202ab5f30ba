"""Problem 2: totals and averages over trailing calendar days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def densify_days(daily: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """One row per entity and calendar day from its first to its last day.

    ``daily`` has at most one row per entity and day.  The calendar of each entity is
    laid out next to its rows: every row brings the days up to the next one, whose
    ``value`` is 0 and ``active`` false, so no second read and no join is needed.
    """
    w = W.partitionBy(*keys).orderBy(day)
    d = daily.where(F.col(day).isNotNull()).withColumn("__next", F.lead(day).over(w))
    days = F.sequence(F.col(day), F.coalesce(F.date_sub("__next", 1), F.col(day)))
    return d.select(*keys, value, F.posexplode(days).alias("__i", day)).select(
        *keys, day, F.when(F.col("__i") == 0, F.coalesce(F.col(value), F.lit(0).cast(daily.schema[value].dataType))).otherwise(F.lit(0)).cast(daily.schema[value].dataType).alias(value), (F.col("__i") == 0).alias("active")
    )


def rolling_totals(daily: DataFrame, keys: Sequence[str], day: str, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and averages of ``value`` over the trailing ``periods`` of calendar days.

    Output: keys, day, value, ``active`` (the day has a row), and for each period n
    ``total_n`` and ``avg_n`` (the total divided by n: days without rows count as days
    with 0, those before the entity's first row too).  Null values count as 0, null keys
    form an entity of their own, rows without a day are left out, an empty table gives
    an empty result.
    """
    dense = densify_days(daily, keys, day, value)
    w = W.partitionBy(*keys).orderBy(day)
    out = dense
    for n in periods:
        out = out.withColumn(f"total_{n}", F.sum(value).over(w.rowsBetween(1 - n, 0)))
    return out.withColumns({f"avg_{n}": F.col(f"total_{n}") / F.lit(float(n)) for n in periods})


def utc_day(us: str) -> Column:
    """UTC date of a column of microseconds, whatever the session's time zone."""
    return F.date_from_unix_date(F.expr(f"cast(({us} - pmod({us}, 86400000000)) div 86400000000 as int)"))


def latest_per_day(rows: DataFrame, keys: Sequence[str], ts: str, recorded: str, rank: str, value: str) -> DataFrame:
    """Per entity and UTC day the ``value`` of the row recorded last (then smallest ``rank``)."""
    best = F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(recorded), -F.col(rank)))
    r = rows.where(F.col(ts).isNotNull()).withColumn("__us", F.unix_micros(ts))
    return r.groupBy(*keys, utc_day("__us").alias("day")).agg(best["v"].alias("value"))


def distinct_times_per_day(rows: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Per entity and UTC day the number of distinct ``ts`` with a non-null ``value``."""
    r = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    once = r.select(*keys, F.unix_micros(ts).alias("__us")).distinct()
    return once.groupBy(*keys, utc_day("__us").alias("day")).agg(F.count(F.lit(1)).alias("value"))
