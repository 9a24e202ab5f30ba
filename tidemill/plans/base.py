"""What the queries share: tables on the regular grid, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import series as S
from tidemill.session import table

KEYS = ["feed_id", "symbol"]
#: Length of the slots into which lookups by time cut a series.
WEEK_US = 7 * 86_400_000_000

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL of the same result where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def rd(c: Column | str, digits: int = 9) -> Column:
    """Rounded for comparison between engines, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def grid(spark: SparkSession, d: str) -> DataFrame:
    """feed_id, symbol, step, k, close, volume, n, x."""
    return S.grid_bars(table(spark, d, "bars"), table(spark, d, "series"), KEYS)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """The grid with ret, contiguous, two_step and segment_id."""
    return S.with_edges(grid(spark, d), KEYS)


GRID = """
raw AS (
  SELECT b.feed_id, b.symbol, s.bar_seconds::BIGINT AS step, epoch_us(b.timestamp) // (s.bar_seconds::BIGINT * 1000000) AS k, b.timestamp, b.bar_id, b.close, b.volume
  FROM bars b JOIN series s USING (feed_id, symbol) WHERE b.close > 0 AND b.close < 'infinity'::DOUBLE),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_id, symbol, k ORDER BY timestamp DESC, bar_id) AS rn, count(*) OVER (PARTITION BY feed_id, symbol, k) AS n FROM raw),
g AS (SELECT feed_id, symbol, step, k, close, volume, n, ln(close) AS x FROM ranked WHERE rn = 1)"""

EDGES = (
    GRID
    + """,
e0 AS (SELECT *, coalesce(k - lag(k) OVER w = 1, false) AS contiguous, x - lag(x) OVER w AS dx FROM g WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k)),
e AS (
  SELECT * EXCLUDE dx, CASE WHEN contiguous THEN dx END AS ret, contiguous AND coalesce(lag(contiguous) OVER w, false) AS two_step,
    CAST(sum(CASE WHEN contiguous THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id, symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS segment_id
  FROM e0 WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k))"""
)
