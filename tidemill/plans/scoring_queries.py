"""Forecast scores, climatologies, baselines, multiplicity and document-like checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators import joins as J
from tidemill.operators import scoring as C
from tidemill.operators import sequential as Q
from tidemill.operators import series as S
from tidemill.plans.base import EDGES, KEYS, Registry, edges, rd
from tidemill.session import table

query = Registry()

#: Forecasts made from the bar's number, labels from the next return: 0 neutral, 1 up, 2 down.
_FORECASTS = (
    EDGES
    + """,
f0 AS (SELECT *, CASE WHEN lead(contiguous) OVER w THEN lead(ret) OVER w END AS nxt FROM e WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k)),
f AS (
  SELECT feed_id, symbol, step, k, CASE WHEN nxt > 1e-4 THEN 1 WHEN nxt < -1e-4 THEN 2 ELSE 0 END AS y, CASE WHEN nxt > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS up, (k % 7 + 1) / 9.0::DOUBLE AS p,
    (k % 5 + 1) / 10.0::DOUBLE AS p0, (9 - k % 5) / 20.0::DOUBLE AS p1, (9 - k % 5) / 20.0::DOUBLE AS p2, CAST(k * step // 86400 AS BIGINT) AS day, CAST(k * step // 3600 % 24 // 6 AS BIGINT) AS session,
    CASE WHEN abs(ret) >= 4e-4 THEN 3 WHEN abs(ret) >= 2e-4 THEN 2 WHEN abs(ret) >= 1e-4 THEN 1 ELSE 0 END AS level FROM f0 WHERE nxt IS NOT NULL)"""
)


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    w = S.ordered(KEYS)
    e = edges(spark, d).withColumn("nxt", F.when(F.lead("contiguous").over(w), F.lead("ret").over(w))).where("nxt IS NOT NULL")
    return e.select(
        *KEYS, "step", "k", F.expr("CASE WHEN nxt > 1e-4D THEN 1 WHEN nxt < -1e-4D THEN 2 ELSE 0 END").alias("y"), F.expr("IF(nxt > 0, 1D, 0D)").alias("up"), F.expr("(k % 7 + 1) / 9D").alias("p"),
        F.expr("(k % 5 + 1) / 10D").alias("p0"), F.expr("(9 - k % 5) / 20D").alias("p1"), F.expr("(9 - k % 5) / 20D").alias("p2"),
        F.expr("k * step div 86400").alias("day"), F.expr("(k * step div 3600) % 24 div 6").alias("session"),
        F.expr("CASE WHEN abs(ret) >= 4e-4D THEN 3 WHEN abs(ret) >= 2e-4D THEN 2 WHEN abs(ret) >= 1e-4D THEN 1 ELSE 0 END").alias("level"),
    )


def _p3() -> list:
    return [F.col("p0"), F.col("p1"), F.col("p2")]


@query(f"WITH {_FORECASTS} SELECT feed_id, symbol, count(*) AS n, round(avg((p - up) * (p - up)), 8) + 0.0 AS brier, round(avg(-(up * ln(p) + (1 - up) * ln(1 - p))), 8) + 0.0 AS log_loss FROM f GROUP BY ALL")
def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    p, y = F.col("p"), F.col("up")
    return forecasts(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), rd(C.brier(p, y), 8).alias("brier"), rd(C.log_loss(p, y), 8).alias("log_loss"))


@query(f"""WITH {_FORECASTS} SELECT feed_id, symbol, count(*) AS n, round(avg(pow(p0 - (y = 0)::INT, 2) + pow(p1 - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2)), 8) + 0.0 AS brier,
  round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 8) + 0.0 AS log_loss, round(avg((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y)::INT), 8) + 0.0 AS top1 FROM f GROUP BY ALL""")
def multiclass_scores(spark: SparkSession, d: str) -> DataFrame:
    ps, y = _p3(), F.col("y")
    return forecasts(spark, d).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), rd(C.multiclass_brier(ps, y), 8).alias("brier"), rd(C.multiclass_log_loss(ps, y), 8).alias("log_loss"), rd(C.top1(ps, y), 8).alias("top1"))


@query(f"""WITH {_FORECASTS}, b AS (SELECT feed_id, symbol, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(up) AS my FROM f GROUP BY ALL)
SELECT feed_id, symbol, round(sum(n * abs(mp - my)) / sum(n), 8) + 0.0 AS ece FROM b GROUP BY ALL""")
def ece(spark: SparkSession, d: str) -> DataFrame:
    return C.calibration_error(forecasts(spark, d), KEYS, "p", "up").select(*KEYS, rd("ece", 8).alias("ece"))


@query(f"""WITH {_FORECASTS}, c AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (y = 0) OVER w AS n0, count(*) FILTER (y = 1) OVER w AS n1, count(*) FILTER (y = 2) OVER w AS n2
FROM f WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feed_id, symbol, k, {", ".join(f"round((n{c} + 1) / (n + 3.0::DOUBLE), 9) + 0.0 AS prior_{c}" for c in range(3))} FROM c""")
def laplace_running_prior(spark: SparkSession, d: str) -> DataFrame:
    r = C.laplace_prior(forecasts(spark, d), KEYS, "k", "y", 3)
    return r.select(*KEYS, "k", *(rd(f"prior_{c}").alias(f"prior_{c}") for c in range(3)))


@query(f"WITH {_FORECASTS} SELECT feed_id, symbol, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1, count(*) FILTER (y = 2) AS c2 FROM f GROUP BY ALL")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).groupBy(*KEYS).agg(*(F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(3)))


_SPLIT = _FORECASTS + ", b AS (SELECT max(day) - 14 AS split FROM f), tr AS (SELECT f.* FROM f, b WHERE (k + 2) * step <= split * 86400), oo AS (SELECT f.* FROM f, b WHERE day >= split)"

_CLIM = (
    _SPLIT
    + """,
t0 AS (SELECT level, symbol, session, count(*) AS n, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2 FROM tr GROUP BY level, symbol, session),
t1 AS (SELECT level, symbol, sum(n) AS n, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2 FROM t0 GROUP BY level, symbol),
t2 AS (SELECT level, sum(n) AS n, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2 FROM t0 GROUP BY level),
t3 AS (SELECT sum(n) AS n, sum(n0) AS n0, sum(n1) AS n1, sum(n2) AS n2 FROM t0),
cl AS (SELECT oo.*, CASE WHEN t0.n >= 20 THEN 0 WHEN t1.n >= 20 THEN 1 WHEN t2.n >= 20 THEN 2 ELSE 3 END AS tier, """
    + ", ".join(f"CASE WHEN t0.n >= 20 THEN (t0.n{c} + 1) / (t0.n + 3.0::DOUBLE) WHEN t1.n >= 20 THEN (t1.n{c} + 1) / (t1.n + 3.0::DOUBLE) WHEN t2.n >= 20 THEN (t2.n{c} + 1) / (t2.n + 3.0::DOUBLE) ELSE (coalesce(t3.n{c}, 0) + 1) / (coalesce(t3.n, 0) + 3.0::DOUBLE) END AS p_{c}" for c in range(3))
    + """ FROM oo LEFT JOIN t0 ON oo.level = t0.level AND oo.symbol = t0.symbol AND oo.session = t0.session LEFT JOIN t1 ON oo.level = t1.level AND oo.symbol = t1.symbol LEFT JOIN t2 ON oo.level = t2.level LEFT JOIN t3 ON true)"""
)


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The last two weeks are scored; every forecast whose outcome, the next bar, ends before
    they begin trains."""
    f = forecasts(spark, d)
    split = f.agg((F.max("day") - 14).alias("split"))  # one row
    f = f.join(F.broadcast(split), F.lit(True))
    return f.where("(k + 2) * step <= split * 86400").drop("split"), f.where("day >= split").drop("split")


@query(f"WITH {_CLIM} SELECT feed_id, symbol, k, tier, round(p_0, 9) + 0.0 AS p_0, round(p_1, 9) + 0.0 AS p_1, round(p_2, 9) + 0.0 AS p_2 FROM cl")
def climatology_3class(spark: SparkSession, d: str) -> DataFrame:
    tr, oo = _parts(spark, d)
    c = C.climatology(tr, oo, [["level", "symbol", "session"], ["level", "symbol"], ["level"], []], "y", 3)
    return c.select(*KEYS, "k", "tier", *(rd(f"p_{i}").alias(f"p_{i}") for i in range(3)))


@query(f"""WITH {_CLIM} SELECT symbol, count(*) AS n, round(avg(pow(p_0 - (y = 0)::INT, 2) + pow(p_1 - (y = 1)::INT, 2) + pow(p_2 - (y = 2)::INT, 2)), 8) + 0.0 AS base_brier,
  round(avg(pow(p_0 - (y = 0)::INT, 2) + pow(p_1 - (y = 1)::INT, 2) + pow(p_2 - (y = 2)::INT, 2)) - avg(pow(p0 - (y = 0)::INT, 2) + pow(p1 - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2)), 8) + 0.0 AS improvement FROM cl GROUP BY symbol""")
def model_minus_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Brier of the climatology, and how far the forecasts improve on it."""
    tr, oo = _parts(spark, d)
    c = C.climatology(tr, oo, [["level", "symbol", "session"], ["level", "symbol"], ["level"], []], "y", 3)
    base = C.multiclass_brier([F.col(f"p_{i}") for i in range(3)], F.col("y"))
    return c.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(base, 8).alias("base_brier"), rd(base - C.multiclass_brier(_p3(), F.col("y")), 8).alias("improvement"))


@query(f"WITH {_SPLIT} SELECT symbol, round(avg(up), 9) + 0.0 AS prior, mode(y) AS modal FROM (SELECT symbol, up, y FROM tr) GROUP BY symbol".replace("mode(y) AS modal", "CASE WHEN count(*) FILTER (y = 0) >= count(*) FILTER (y = 1) AND count(*) FILTER (y = 0) >= count(*) FILTER (y = 2) THEN 0 WHEN count(*) FILTER (y = 1) >= count(*) FILTER (y = 2) THEN 1 ELSE 2 END AS modal"))
def class_prior_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Frozen training prior and modal class (the smallest of equals) of each symbol."""
    tr, _ = _parts(spark, d)
    n = [F.count_if(F.col("y") == c) for c in range(3)]
    modal = F.array_position(F.array(*n), F.greatest(*n)) - 1
    return tr.groupBy("symbol").agg(rd(F.avg("up")).alias("prior"), modal.cast("int").alias("modal"))


@query(f"""WITH {_FORECASTS} SELECT day, count(*) AS n, round(avg((p - up) * (p - up)), 8) + 0.0 AS brier, round(avg((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END = y)::INT), 8) + 0.0 AS top1 FROM f GROUP BY day""")
def daily_scores(spark: SparkSession, d: str) -> DataFrame:
    return forecasts(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"), rd(C.brier(F.col("p"), F.col("up")), 8).alias("brier"), rd(C.top1(_p3(), F.col("y")), 8).alias("top1"))


_TESTS = _FORECASTS + ", pv AS (SELECT feed_id, symbol, round(exp(-abs(sum(CASE WHEN up > 0 THEN 1 ELSE -1 END)) / sqrt(count(*)::DOUBLE) * 2), 12) AS pv FROM f GROUP BY ALL)"


def _tests(spark: SparkSession, d: str) -> DataFrame:
    a = forecasts(spark, d).groupBy(*KEYS).agg(F.sum(F.expr("IF(up > 0, 1, -1)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return a.select(*KEYS, F.round(F.exp(-F.abs("s") / F.sqrt("n") * 2), 12).alias("pv"))


@query(f"""WITH {_TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY pv, symbol) AS rank, count(*) OVER (PARTITION BY feed_id) AS m FROM pv)
SELECT feed_id, symbol, rank, min(CASE WHEN pv <= 0.05 / (m - rank + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY rank ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM r""")
def holm(spark: SparkSession, d: str) -> DataFrame:
    """Holm's step-down over the symbols of each feed."""
    return C.holm(_tests(spark, d), ["feed_id"], "symbol", "pv", 0.05).select(*KEYS, F.col("rank").cast("long").alias("rank"), "rejected")


@query(f"WITH {_TESTS} SELECT feed_id, symbol, pv <= 0.05 / count(*) OVER (PARTITION BY feed_id) AS rejected FROM pv")
def bonferroni(spark: SparkSession, d: str) -> DataFrame:
    return _tests(spark, d).select(*KEYS, (F.col("pv") <= F.lit(0.05) / F.count(F.lit(1)).over(W.partitionBy("feed_id"))).alias("rejected"))


@query(f"""WITH {_FORECASTS}, c AS (SELECT symbol, session, count(*) AS n, round(0.25 - avg((p - up) * (p - up)), 8) AS gain FROM f GROUP BY ALL)
SELECT symbol, count(*) FILTER (n >= 30) AS evaluated, count(*) FILTER (n < 30) AS insufficient, count(*) FILTER (n >= 30 AND gain > 0) AS passed, round(min(gain), 8) + 0.0 AS worst, round(median(gain), 7) + 0.0 AS median_gain FROM c GROUP BY symbol""")
def robustness_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each symbol that pass, and their worst and median gain."""
    c = forecasts(spark, d).groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("n"), F.round(0.25 - C.brier(F.col("p"), F.col("up")), 8).alias("gain"))
    n = lambda e, a: F.count_if(F.expr(e)).alias(a)
    return c.groupBy("symbol").agg(n("n >= 30", "evaluated"), n("n < 30", "insufficient"), n("n >= 30 AND gain > 0", "passed"), rd(F.min("gain"), 8).alias("worst"), rd(F.median("gain"), 7).alias("median_gain"))


@query(f"""WITH {_FORECASTS}, c AS (SELECT symbol, feed_id, count(*) AS n FROM f GROUP BY ALL) SELECT symbol, sum(n)::BIGINT AS n, round(max(n) / sum(n)::DOUBLE, 8) + 0.0 AS largest_share, CASE WHEN sum(n) < 200 THEN 'inconclusive' WHEN max(n) / sum(n)::DOUBLE > 0.4 THEN 'concentrated' ELSE 'spread' END AS verdict FROM c GROUP BY symbol""")
def concentration(spark: SparkSession, d: str) -> DataFrame:
    """Largest feed's share of each symbol's rows against the limit."""
    c = forecasts(spark, d).groupBy("symbol", "feed_id").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    share = F.col("m") / F.col("n")
    return c.select("symbol", "n", rd(share, 8).alias("largest_share"), F.when(F.col("n") < 200, "inconclusive").when(share > 0.4, "concentrated").otherwise("spread").alias("verdict"))


_SPANS = EDGES + ", sg AS (SELECT feed_id, symbol, segment_id, min(k) * max(step) AS s, (max(k) + 1) * max(step) AS t FROM e GROUP BY ALL)"


@query(f"""WITH {_SPANS} SELECT a.symbol, a.feed_id, a.segment_id, EXISTS (SELECT 1 FROM sg b WHERE b.symbol = a.symbol AND b.feed_id = 'fd-prime' AND a.s < b.t AND b.s < a.t) AS overlaps_prime FROM sg a WHERE a.feed_id <> 'fd-prime'""")
def holdout_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Half-open overlap of each segment with those of the main feed."""
    s = edges(spark, d).groupBy(*KEYS, "segment_id").agg((F.min("k") * F.max("step")).alias("s"), ((F.max("k") + 1) * F.max("step") - 1).alias("t"))
    r = J.overlaps_any(s.where("feed_id <> 'fd-prime'"), s.where("feed_id = 'fd-prime'"), ["symbol"], "s", "t", "overlaps_prime")
    return r.select("symbol", "feed_id", "segment_id", "overlaps_prime")


_CHAIN = """WITH RECURSIVE c AS (SELECT feed_id, event_seq, sha256(concat_ws('|', event_id, assessment_sha256)) AS h, row_number() OVER (PARTITION BY feed_id ORDER BY event_seq) AS i FROM legal_events),
l AS (
  SELECT feed_id, event_seq, i, h, repeat('0', 64) AS prev, sha256(concat(repeat('0', 64), h)) AS link FROM c WHERE i = 1
  UNION ALL
  SELECT c.feed_id, c.event_seq, c.i, c.h, l.link, sha256(concat(l.link, c.h)) FROM l JOIN c ON c.feed_id = l.feed_id AND c.i = l.i + 1)
"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "legal_events").select("feed_id", "event_seq", F.sha2(F.concat_ws("|", "event_id", "assessment_sha256"), 256).alias("h"))
    return Q.hash_chain(e, ["feed_id"], "event_seq", "h")


@query(_CHAIN + "SELECT feed_id, event_seq, prev, link FROM l")
def audit_links(spark: SparkSession, d: str) -> DataFrame:
    """Each record's hash bound to the link before it in its feed; the first to zeros."""
    return _chain(spark, d).drop("h")


@query(_CHAIN + """, t AS (SELECT *, CASE WHEN event_seq % 17 = 3 THEN sha256('other') ELSE h END AS now FROM l)
SELECT feed_id, count(*) AS n, count(*) FILTER (sha256(concat(prev, now)) <> link) AS unbound, count(*) FILTER (prev <> before) AS unjoined
FROM (SELECT *, coalesce(lag(link) OVER (PARTITION BY feed_id ORDER BY event_seq), repeat('0', 64)) AS before FROM t) GROUP BY feed_id""")
def audit_check(spark: SparkSession, d: str) -> DataFrame:
    """What a check of the chain says after some records have been altered."""
    now = F.when(F.expr("event_seq % 17 = 3"), F.sha2(F.lit("other"), 256)).otherwise(F.col("h"))
    c = Q.check_chain(_chain(spark, d).withColumn("h", now), ["feed_id"], "event_seq", "h")
    return c.groupBy("feed_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bound")).alias("unbound"), F.count_if(~F.col("joined")).alias("unjoined"))


@query(f"""WITH {_SPLIT}, all_tr AS (SELECT 'frozen' AS view, level, y FROM tr UNION ALL SELECT 'purged', level, y FROM tr, b WHERE day < split - 1 UNION ALL SELECT 'embargoed', level, y FROM tr, b WHERE day < split - 5),
c AS (SELECT view, level, count(*) AS n, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 2) AS n2 FROM all_tr GROUP BY ALL),
v AS (SELECT DISTINCT view FROM all_tr)
SELECT v.view, count(*) AS n, round(avg(pow((coalesce(n0, 0) + 1) / (coalesce(c.n, 0) + 3.0::DOUBLE) - (y = 0)::INT, 2) + pow((coalesce(n1, 0) + 1) / (coalesce(c.n, 0) + 3.0::DOUBLE) - (y = 1)::INT, 2) + pow((coalesce(n2, 0) + 1) / (coalesce(c.n, 0) + 3.0::DOUBLE) - (y = 2)::INT, 2)), 7) + 0.0 AS brier
FROM oo CROSS JOIN v LEFT JOIN c ON c.view = v.view AND c.level = oo.level GROUP BY v.view""")
def comparator_views(spark: SparkSession, d: str) -> DataFrame:
    """The same scored rows against climatologies of the frozen, the purged and the
    embargoed training rows: one aggregate of training counts serves all three."""
    tr, oo = _parts(spark, d)
    views = {"frozen": 0, "purged": 1, "embargoed": 5}
    split = forecasts(spark, d).agg((F.max("day") - 14).alias("split"))
    t = tr.join(F.broadcast(split), F.lit(True))
    counts = [F.count_if((F.col("y") == c) & (F.col("day") < F.col("split") - n)).alias(f"{v}_{c}") for v, n in views.items() for c in range(3)]
    m = t.groupBy("level").agg(*counts)
    s = oo.groupBy("level", "y").agg(F.count(F.lit(1)).alias("n")).join(m, "level", "left")
    out = []
    for v in views:
        k = [F.coalesce(F.col(f"{v}_{c}"), F.lit(0)) for c in range(3)]
        total = k[0] + k[1] + k[2] + 3
        err = sum((F.pow((k[c] + 1) / total - (F.col("y") == c).cast("double"), F.lit(2.0)) for c in range(3)), F.lit(0.0))
        out.append(F.struct(F.lit(v).alias("view"), (F.sum(F.col("n") * err) / F.sum("n")).alias("brier")))
    one = s.agg(F.sum("n").alias("n"), F.array(*out).alias("v")).where("n IS NOT NULL")
    return one.select("n", F.explode("v").alias("e")).select("e.view", "n", rd("e.brier", 7).alias("brier"))
