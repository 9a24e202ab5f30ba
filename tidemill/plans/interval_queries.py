"""Entries with horizons: purging, clusters, episodes, acceptance, turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import intervals as I
from tidemill.operators import joins as J
from tidemill.plans.base import EDGES, KEYS, Registry, edges, rd

query = Registry()

#: Every bar is an entry; horizon, component and eligibility follow from its number.
_ENTRIES = (
    EDGES
    + """,
en AS (SELECT feed_id, symbol, k AS source_index, segment_id, (k * 7) % 5 + 1 AS horizon, (k // 6) % 2 AS component, (k // 3) % 5 <> 0 AS eligible, coalesce(ret, 0) AS w1, CASE WHEN k % 2 = 0 THEN 0.5 ELSE -0.25 END::DOUBLE AS w2 FROM e)"""
)


def entries(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    return e.select(
        *KEYS, F.col("k").alias("source_index"), "segment_id", F.expr("(k * 7) % 5 + 1").alias("horizon"), F.expr("(k div 6) % 2").alias("component"),
        F.expr("(k div 3) % 5 <> 0").alias("eligible"), F.coalesce("ret", F.lit(0.0)).alias("w1"), F.expr("IF(k % 2 = 0, 0.5D, -0.25D)").alias("w2"),
    )


def signature() -> Column:
    """Component and weights to six places, as one key."""
    return F.concat_ws("|", F.col("component").cast("string"), F.round(F.col("w2") * 1e6).cast("long").cast("string"))


#: The last fifth of each series is held out.
_SPLIT = (
    _ENTRIES
    + """,
sp AS (SELECT *, source_index + horizon AS target_end, max(source_index) OVER (PARTITION BY feed_id, symbol) AS hi, min(source_index) OVER (PARTITION BY feed_id, symbol) AS lo FROM en),
s AS (SELECT * EXCLUDE (hi, lo), source_index >= hi - (hi - lo) // 5 AS held FROM sp)"""
)


def _split(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy(*KEYS)
    e = entries(spark, d).withColumns({"target_end": F.expr("source_index + horizon"), "hi": F.max("source_index").over(w), "lo": F.min("source_index").over(w)})
    return e.withColumn("held", F.expr("source_index >= hi - (hi - lo) div 5")).drop("hi", "lo")


def _intervals(df: DataFrame, widen: int = 0) -> DataFrame:
    return df.withColumns({"s": F.col("source_index") - widen, "t": F.col("target_end") + widen})


@query(f"""WITH {_SPLIT} SELECT feed_id, symbol, segment_id, source_index, EXISTS (SELECT 1 FROM s h WHERE h.held AND h.feed_id = s.feed_id AND h.symbol = s.symbol AND h.segment_id = s.segment_id AND s.source_index <= h.target_end AND h.source_index <= s.target_end) AS purged FROM s WHERE NOT held""")
def overlap_purge(spark: SparkSession, d: str) -> DataFrame:
    """Training entries whose interval meets a held-out one of the same segment."""
    s = _intervals(_split(spark, d))
    r = J.overlaps_any(s.where("NOT held"), s.where("held"), [*KEYS, "segment_id"], "s", "t", "purged")
    return r.select(*KEYS, "segment_id", "source_index", "purged")


@query(f"""WITH {_SPLIT} SELECT feed_id, symbol, source_index, EXISTS (SELECT 1 FROM s h WHERE h.held AND h.feed_id = s.feed_id AND h.symbol = s.symbol AND s.source_index <= h.target_end + 20 AND h.source_index - 20 <= s.target_end) AS purged FROM s WHERE NOT held""")
def embargo_purge(spark: SparkSession, d: str) -> DataFrame:
    """The same over whole series, held-out intervals widened by 20 on both sides."""
    s = _split(spark, d)
    r = J.overlaps_any(_intervals(s.where("NOT held")), _intervals(s.where("held"), 20), KEYS, "s", "t", "purged")
    return r.select(*KEYS, "source_index", "purged")


@query(f"""WITH {_SPLIT}, p AS (SELECT *, EXISTS (SELECT 1 FROM s h WHERE h.held AND h.feed_id = s.feed_id AND h.symbol = s.symbol AND s.source_index <= h.target_end AND h.source_index <= s.target_end) AS a,
  EXISTS (SELECT 1 FROM s h WHERE h.held AND h.feed_id = s.feed_id AND h.symbol = s.symbol AND s.source_index <= h.target_end + 20 AND h.source_index - 20 <= s.target_end) AS b FROM s WHERE NOT held)
SELECT feed_id, symbol, count(*) AS total, count(*) FILTER (a) AS purged, count(*) FILTER (b AND NOT a) AS embargoed, count(*) FILTER (NOT b) AS remaining FROM p GROUP BY ALL""")
def purge_summary(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    r = J.overlaps_any(_intervals(s.where("NOT held")), _intervals(s.where("held")), KEYS, "s", "t", "a")
    r = J.overlaps_any(r, _intervals(s.where("held"), 20), KEYS, "s", "t", "b")
    n = lambda c, a: F.count_if(F.expr(c)).alias(a)
    return r.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total"), n("a", "purged"), n("b AND NOT a", "embargoed"), n("NOT b", "remaining"))


@query(f"""WITH {_SPLIT}, r AS (SELECT *, max(target_end) OVER (PARTITION BY feed_id, symbol ORDER BY source_index, target_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE eligible),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR source_index > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, symbol ORDER BY source_index, target_end ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT feed_id, symbol, min(source_index) AS s, max(target_end) AS t FROM i GROUP BY feed_id, symbol, island""")
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    return J.merge_intervals(_intervals(_split(spark, d)).where("eligible"), KEYS, "s", "t")


@query(f"""WITH {_ENTRIES}, l AS (SELECT *, CASE WHEN segment_id = lag(segment_id) OVER w THEN 0 ELSE 1 END AS nr FROM en WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY source_index)),
a AS (SELECT *, sum(nr) OVER (PARTITION BY feed_id, symbol ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS run FROM l),
b AS (SELECT *, max(source_index + horizon) OVER (PARTITION BY feed_id, symbol, run ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a)
SELECT feed_id, symbol, source_index, CAST(sum(CASE WHEN reach IS NULL OR source_index > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, symbol ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS cluster FROM b""")
def target_clusters(spark: SparkSession, d: str) -> DataFrame:
    return I.target_clusters(entries(spark, d), KEYS).select(*KEYS, "source_index", "cluster")


_EPISODES = (
    _ENTRIES
    + """,
ep0 AS (SELECT *, CASE WHEN eligible AND NOT coalesce(lag(eligible) OVER w AND lag(component) OVER w = component AND lag(segment_id) OVER w = segment_id AND source_index - lag(source_index) OVER w <= 2, false) THEN 1 ELSE 0 END AS nw FROM en WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY source_index)),
ep AS (SELECT *, CASE WHEN eligible THEN CAST(sum(nw) OVER (PARTITION BY feed_id, symbol ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 ELSE -1 END AS episode FROM ep0)"""
)


@query(f"WITH {_EPISODES} SELECT feed_id, symbol, source_index, episode FROM ep")
def episodes(spark: SparkSession, d: str) -> DataFrame:
    return I.episodes(entries(spark, d), KEYS, 1).select(*KEYS, "source_index", "episode")


@query(f"WITH {_EPISODES} SELECT feed_id, symbol, episode, min(source_index) AS first_index, count(*) AS n FROM ep WHERE eligible GROUP BY ALL")
def first_per_episode(spark: SparkSession, d: str) -> DataFrame:
    e = I.episodes(entries(spark, d), KEYS, 1).where("eligible")
    return e.groupBy(*KEYS, "episode").agg(F.min("source_index").alias("first_index"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ENTRIES} SELECT a.feed_id, a.symbol, a.source_index, count(b.source_index) AS active, coalesce(max(b.source_index + b.horizon) - a.source_index, 0) AS overlap,
  count(b.source_index) FILTER (b.component = a.component) AS same_component, count(b.source_index) FILTER (b.component = a.component AND b.w2 = a.w2) AS same_basket
FROM en a LEFT JOIN en b ON b.eligible AND a.feed_id = b.feed_id AND a.symbol = b.symbol AND a.segment_id = b.segment_id AND b.source_index < a.source_index AND b.source_index + b.horizon >= a.source_index
WHERE a.eligible GROUP BY a.feed_id, a.symbol, a.source_index""")
def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open entries at each entry: all, those of its component, those of its basket."""
    e = entries(spark, d).withColumn("basket", signature())
    c = I.overlap_counts(e, KEYS, {"same_component": ["component"], "same_basket": ["basket"]})
    return c.select(*KEYS, "source_index", *(F.col(n).cast("long").alias(n) for n in ("active", "overlap", "same_component", "same_basket")))


_GREEDY = """
o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY source_index) AS i FROM en WHERE eligible),
t AS (
  SELECT {by}, i, source_index, horizon, true AS accepted, source_index + horizon AS open_until FROM o WHERE i = 1
  UNION ALL
  SELECT {oby}, o.i, o.source_index, o.horizon, o.source_index > t.open_until, CASE WHEN o.source_index > t.open_until THEN o.source_index + o.horizon ELSE t.open_until END
  FROM t JOIN o ON {on} AND o.i = t.i + 1)
SELECT feed_id, symbol, source_index, accepted FROM t"""


def _greedy_sql(by: list[str]) -> str:
    return "WITH RECURSIVE " + _ENTRIES.lstrip() + "," + _GREEDY.format(by=", ".join(by), oby=", ".join(f"o.{c}" for c in by), on=" AND ".join(f"o.{c} = t.{c}" for c in by))


@query(_greedy_sql(["feed_id", "symbol", "segment_id"]))
def greedy_global(spark: SparkSession, d: str) -> DataFrame:
    """Entries that start after the last accepted one of the segment has ended."""
    return I.greedy_accept(entries(spark, d), KEYS).select(*KEYS, "source_index", "accepted")


@query(_greedy_sql(["feed_id", "symbol", "segment_id", "component"]))
def greedy_component(spark: SparkSession, d: str) -> DataFrame:
    return I.greedy_accept(entries(spark, d), KEYS, ["component"]).select(*KEYS, "source_index", "accepted")


@query(f"""WITH {_ENTRIES} SELECT feed_id, symbol, source_index, round(CASE WHEN segment_id = lag(segment_id) OVER w THEN abs(w1 - lag(w1) OVER w) + abs(w2 - lag(w2) OVER w) ELSE 0 END, 8) + 0.0 AS turnover
FROM en WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY source_index)""")
def turnover_candidate(spark: SparkSession, d: str) -> DataFrame:
    return I.turnover(entries(spark, d), KEYS, ["w1", "w2"]).select(*KEYS, "source_index", rd("turnover", 8).alias("turnover"))


@query(_greedy_sql(["feed_id", "symbol", "segment_id"]).replace("SELECT feed_id, symbol, source_index, accepted FROM t", """
SELECT feed_id, symbol, source_index, round(abs(w1 - lag(w1) OVER w) + abs(w2 - lag(w2) OVER w), 8) + 0.0 AS turnover FROM t JOIN en USING (feed_id, symbol, segment_id, source_index) WHERE accepted WINDOW w AS (PARTITION BY feed_id, symbol, segment_id ORDER BY source_index)"""))
def turnover_accepted(spark: SparkSession, d: str) -> DataFrame:
    a = I.greedy_accept(entries(spark, d), KEYS)
    return I.accepted_turnover(a, KEYS, ["w1", "w2"]).select(*KEYS, "source_index", rd("turnover", 8).alias("turnover"))


@query(f"""WITH {_EPISODES}, c AS (SELECT a.feed_id, a.symbol, a.source_index, a.episode, count(b.source_index) AS active
FROM ep a LEFT JOIN ep b ON b.eligible AND a.feed_id = b.feed_id AND a.symbol = b.symbol AND a.segment_id = b.segment_id AND b.source_index < a.source_index AND b.source_index + b.horizon >= a.source_index WHERE a.eligible GROUP BY ALL)
SELECT feed_id, symbol, count(*) AS eligible, count(DISTINCT episode) AS n_episodes, max(active) + 1 AS max_concurrent, round(100.0 * count(*) FILTER (active > 0) / count(*), 6) + 0.0 AS pct_overlap FROM c GROUP BY ALL""")
def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    e = I.overlap_counts(I.episodes(entries(spark, d), KEYS, 1), KEYS)
    return e.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("eligible"), F.count_distinct("episode").alias("n_episodes"), (F.max("active") + 1).cast("long").alias("max_concurrent"), rd(100.0 * F.count_if(F.col("active") > 0) / F.count(F.lit(1)), 6).alias("pct_overlap"))


@query(f"WITH {_ENTRIES} SELECT feed_id, symbol, source_index, concat_ws('|', component, CAST(round(w2 * 1000000) AS BIGINT)) AS signature FROM en")
def basket_signature(spark: SparkSession, d: str) -> DataFrame:
    """Component and weights to six places, as one key."""
    return entries(spark, d).select(*KEYS, "source_index", signature().alias("signature"))


_CLUSTERS = (
    _ENTRIES
    + """,
c0 AS (SELECT *, CASE WHEN segment_id = lag(segment_id) OVER w THEN 0 ELSE 1 END AS nr FROM en WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY source_index)),
c1 AS (SELECT *, sum(nr) OVER (PARTITION BY feed_id, symbol ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS run FROM c0),
c2 AS (SELECT *, max(source_index + horizon) OVER (PARTITION BY feed_id, symbol, run ORDER BY source_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c1),
cl AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR source_index > reach THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, symbol ORDER BY source_index ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS cluster FROM c2)"""
)


@query(f"WITH {_CLUSTERS} SELECT feed_id, symbol, segment_id, cluster, min(source_index) AS representative, count(*) AS n FROM cl WHERE eligible GROUP BY ALL")
def cluster_representative(spark: SparkSession, d: str) -> DataFrame:
    """The first eligible entry of each (segment, cluster)."""
    c = I.target_clusters(entries(spark, d), KEYS).where("eligible")
    return c.groupBy(*KEYS, "segment_id", "cluster").agg(F.min("source_index").alias("representative"), F.count(F.lit(1)).alias("n"))


@query(_greedy_sql(["feed_id", "symbol", "segment_id"]).replace("\nSELECT feed_id, symbol, source_index, accepted FROM t", """,
ep0 AS (SELECT *, CASE WHEN eligible AND NOT coalesce(lag(eligible) OVER w AND lag(component) OVER w = component AND lag(segment_id) OVER w = segment_id AND source_index - lag(source_index) OVER w <= 2, false) THEN 1 ELSE 0 END AS nw FROM en WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY source_index))
SELECT feed_id, symbol, count(*) FILTER (eligible) AS every_row, sum(nw)::BIGINT AS first_per_episode, (SELECT count(*) FROM t WHERE t.accepted AND t.feed_id = ep0.feed_id AND t.symbol = ep0.symbol) AS non_overlapping FROM ep0 GROUP BY feed_id, symbol"""))
def policy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entries that each policy takes: all, the first of an episode, no overlaps."""
    e = entries(spark, d)
    n = I.episodes(e, KEYS, 1).groupBy(*KEYS).agg(F.count_if("eligible").alias("every_row"), F.count_distinct(F.when(F.col("eligible"), F.col("episode"))).alias("first_per_episode"))
    g = I.greedy_accept(e, KEYS).groupBy(*KEYS).agg(F.count_if("accepted").alias("non_overlapping"))
    return n.join(g, KEYS, "left").fillna(0, ["non_overlapping"])
