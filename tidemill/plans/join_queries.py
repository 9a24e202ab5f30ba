"""Panels, as-of joins, outcomes, events, transforms and matrices."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import joins as J
from tidemill.operators import series as S
from tidemill.operators.sequential import ordered_scan
from tidemill.plans.base import EDGES, GRID, KEYS, WEEK_US, Registry, edges, grid, rd
from tidemill.plans.core_problems import exposed_pairs
from tidemill.session import table

query = Registry()

#: The symbols in their fixed order (a fixed value of the data).
SYMBOLS = ["EURUSD", "USDJPY", "GBPUSD", "USDCHF", "AUDUSD", "USDCAD", "USDCNH", "EURGBP", "EURJPY", "GBPJPY"]
#: Three symbols of the densest feed that close a triangle: EURGBP = EURUSD / GBPUSD.
TRIANGLE = ["EURUSD", "GBPUSD", "EURGBP"]

_HOUR = GRID + """,
h AS (SELECT feed_id, symbol, CAST(k * step // 14400 AS BIGINT) AS h, arg_max(x, k) AS x FROM g GROUP BY ALL)"""

_MID = _HOUR + """,
mid AS (SELECT symbol, h, median(x) AS x FROM h GROUP BY ALL)"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """feed_id, symbol, h (four-hour slot), x (its last log price)."""
    h = F.expr("cast(floor(k * step / 14400) as bigint)").alias("h")
    return grid(spark, d).groupBy(*KEYS, h).agg(F.max_by("x", "k").alias("x"))


def mid(spark: SparkSession, d: str) -> DataFrame:
    """One series a symbol: the median over feeds of the slot's log price."""
    return hourly(spark, d).groupBy("symbol", "h").agg(F.median("x").alias("x"))


def returns(spark: SparkSession, d: str) -> DataFrame:
    """symbol, h, r: return of the median series over contiguous slots."""
    w = W.partitionBy("symbol").orderBy("h")
    m = mid(spark, d).withColumn("r", F.when(F.col("h") - F.lag("h").over(w) == 1, F.col("x") - F.lag("x").over(w)))
    return m.where("r IS NOT NULL").select("symbol", "h", "r")


_RET = _MID + """,
r AS (SELECT symbol, h, CASE WHEN h - lag(h) OVER w = 1 THEN x - lag(x) OVER w END AS r FROM mid WINDOW w AS (PARTITION BY symbol ORDER BY h)),
ret AS (SELECT * FROM r WHERE r IS NOT NULL)"""


@query(f"WITH {_MID} SELECT h, {', '.join(f'round(max(x) FILTER (symbol = {chr(39)}{s}{chr(39)}), 8) + 0.0 AS {s}' for s in SYMBOLS[:5])} FROM mid GROUP BY h HAVING count(*) FILTER (symbol IN ({', '.join(repr(s) for s in SYMBOLS[:5])})) = 5")
def panel_inner(spark: SparkSession, d: str) -> DataFrame:
    p = J.panel(mid(spark, d), "h", "symbol", SYMBOLS[:5], "x")
    return p.select("h", *(rd(s, 8).alias(s) for s in SYMBOLS[:5]))


@query(f"WITH {_HOUR} SELECT symbol, h, count(DISTINCT feed_id) AS n_feeds FROM h GROUP BY ALL HAVING count(DISTINCT feed_id) >= 2")
def ts_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a symbol that at least two feeds share."""
    return hourly(spark, d).groupBy("symbol", "h").agg(F.count(F.lit(1)).alias("n_feeds")).where("n_feeds >= 2")


_PARAMS = "p AS (SELECT feed_id, symbol, timestamp, arg_max(struct_pack(a := param_id, b := sigma_eps), (recorded_at, -param_id)) AS v FROM dynamics_params WHERE sigma_eps IS NOT NULL GROUP BY ALL)"


def _held(spark: SparkSession, d: str, max_age: float | None) -> DataFrame:
    g = grid(spark, d).select(*KEYS, "k", ((F.col("k") + 1) * F.col("step") * 1_000_000).alias("us"))
    p = table(spark, d, "dynamics_params").where("sigma_eps IS NOT NULL").select(*KEYS, F.unix_micros("timestamp").alias("t"), "param_id", "recorded_at", (-F.col("param_id")).alias("low"))
    return J.asof(g, p, KEYS, "us", "t", ["param_id", "t"], ["recorded_at", "low"], max_age, slot=WEEK_US)


@query(f"""WITH {GRID}, {_PARAMS}
SELECT g.feed_id, g.symbol, g.k, p.v.a AS param_id FROM g ASOF LEFT JOIN p ON g.feed_id = p.feed_id AND g.symbol = p.symbol AND make_timestamptz((g.k + 1) * g.step * 1000000) >= p.timestamp""")
def asof_params(spark: SparkSession, d: str) -> DataFrame:
    """Parameter row in force at the end of each bar's period (zero-order hold)."""
    return _held(spark, d, None).select(*KEYS, "k", "param_id")


@query(f"""WITH {GRID}, {_PARAMS}
SELECT g.feed_id, g.symbol, g.k, CASE WHEN (g.k + 1) * g.step * 1000000 - epoch_us(p.timestamp) <= 129600000000 THEN p.v.a END AS param_id
FROM g ASOF LEFT JOIN p ON g.feed_id = p.feed_id AND g.symbol = p.symbol AND make_timestamptz((g.k + 1) * g.step * 1000000) >= p.timestamp""")
def asof_stale(spark: SparkSession, d: str) -> DataFrame:
    """The same, but null when it is more than 36 hours old."""
    return _held(spark, d, 129_600_000_000.0).select(*KEYS, "k", "param_id")


_PAIRS = """
ev AS (SELECT event_seq, feed_id, decision_at, unnest(map_entries(pair_exposures), recursive := true) FROM legal_events),
pairs AS (SELECT * FROM (SELECT * FROM ev) AS e(event_seq, feed_id, decision_at, symbol, exposure) WHERE exposure <> 0)"""


@query(f"""WITH {GRID}, {_PAIRS}
SELECT p.event_seq, p.feed_id, p.symbol, g.k FROM pairs p ASOF LEFT JOIN g ON p.feed_id = g.feed_id AND p.symbol = g.symbol AND p.decision_at < make_timestamptz(g.k * g.step * 1000000)""")
def forward_first_bar(spark: SparkSession, d: str) -> DataFrame:
    """First bar that starts strictly after each decision."""
    ev = exposed_pairs(table(spark, d, "legal_events").select("event_seq", "feed_id", "decision_at", "pair_exposures")).withColumn("us", F.unix_micros("decision_at"))
    g = grid(spark, d).select(*KEYS, "k", (F.col("k") * F.col("step") * 1_000_000).alias("t"))
    return J.asof(ev, g, KEYS, "us", "t", ["k"], forward=True, slot=WEEK_US).select("event_seq", *KEYS, "k")


@query(f"""WITH {EDGES} SELECT feed_id, symbol, k, round(CASE WHEN lead(segment_id, 5) OVER w = segment_id THEN lead(x, 5) OVER w - x END, 9) + 0.0 AS outcome,
  round(CASE WHEN lag(segment_id, 5) OVER w = segment_id THEN x - lag(x, 5) OVER w END, 9) + 0.0 AS before FROM e WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k)""")
def horizon_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Return over the next and the last five periods, null where a gap lies between."""
    w = S.ordered(KEYS)
    e = edges(spark, d)
    ahead = F.when(F.lead("segment_id", 5).over(w) == F.col("segment_id"), F.lead("x", 5).over(w) - F.col("x"))
    back = F.when(F.lag("segment_id", 5).over(w) == F.col("segment_id"), F.col("x") - F.lag("x", 5).over(w))
    return e.select(*KEYS, "k", rd(ahead).alias("outcome"), rd(back).alias("before"))


@query(f"""WITH {GRID}, u AS (SELECT DISTINCT feed_id, symbol, epoch_us(timestamp) AS us FROM dynamics_params UNION SELECT feed_id, symbol, k * step * 1000000 FROM g),
f AS (SELECT feed_id, symbol, min(epoch_us(timestamp)) AS f FROM dynamics_params GROUP BY ALL)
SELECT feed_id, symbol, us FROM u JOIN f USING (feed_id, symbol) WHERE us >= f""")
def union_config_times(spark: SparkSession, d: str) -> DataFrame:
    """Distinct times at which either stream changes, from the parameters' first on."""
    p = table(spark, d, "dynamics_params").select(*KEYS, F.unix_micros("timestamp").alias("us"), F.lit(True).alias("p"))
    g = grid(spark, d).select(*KEYS, (F.col("k") * F.col("step") * 1_000_000).alias("us"), F.lit(False).alias("p"))
    u = p.unionAll(g).groupBy(*KEYS, "us").agg(F.max("p").alias("p"))
    first = F.min(F.when(F.col("p"), F.col("us"))).over(W.partitionBy(*KEYS))
    return u.withColumn("f", first).where("us >= f").select(*KEYS, "us")


@query("SELECT feed_id, symbol FROM series EXCEPT SELECT feed_id, symbol FROM dynamics_params")
def missing_required(spark: SparkSession, d: str) -> DataFrame:
    """Series without any parameter row."""
    return table(spark, d, "series").select(*KEYS).exceptAll(table(spark, d, "dynamics_params").select(*KEYS).distinct())


@query("""SELECT s.feed_id, s.symbol FROM series s WHERE NOT EXISTS (SELECT 1 FROM legal_events e WHERE e.feed_id = s.feed_id AND e.pair_exposures[s.symbol] <> 0)""")
def series_without_events(spark: SparkSession, d: str) -> DataFrame:
    ev = exposed_pairs(table(spark, d, "legal_events").select("feed_id", "pair_exposures"))
    return table(spark, d, "series").select(*KEYS).join(ev.select(*KEYS).distinct(), KEYS, "left_anti")


#: Impact of each scenario (fixed values).
IMPACT = {"withdrawn": 0.0, "enacted": 1.0, "diluted": 0.35, "injunction": -0.5, "appeal_success": -0.6, "aggressive_enforcement": 1.25, "loophole": -0.25}


@query(f"""WITH {_PAIRS}, m AS (SELECT event_seq, {" + ".join(f"coalesce(scenario_probabilities['{k}'], 0) * {v}" for k, v in IMPACT.items())} AS impact FROM legal_events)
SELECT p.event_seq, p.symbol, round(impact * exposure, 12) + 0.0 AS pressure FROM pairs p JOIN m USING (event_seq)""")
def event_pressure(spark: SparkSession, d: str) -> DataFrame:
    """Expected impact times exposure, for each exposed pair."""
    impact = sum((F.coalesce(F.try_element_at("scenario_probabilities", F.lit(k)), F.lit(0.0)) * v for k, v in IMPACT.items()), F.lit(0.0))
    ev = table(spark, d, "legal_events").select("event_seq", impact.alias("impact"), F.explode("pair_exposures").alias("symbol", "exposure"))
    return ev.where("exposure <> 0").select("event_seq", "symbol", rd(F.col("impact") * F.col("exposure"), 12).alias("pressure"))


@query("""WITH first AS (SELECT source_document_id AS doc, min(assessment_created_at) AS since FROM legal_events GROUP BY ALL),
c AS (SELECT event_seq, assessment_created_at, unnest(source_citations) AS doc FROM legal_events)
SELECT event_seq, doc, CASE WHEN since IS NULL THEN 'unknown' ELSE 'future' END AS problem FROM c LEFT JOIN first USING (doc) WHERE since IS NULL OR since > assessment_created_at""")
def citation_problems(spark: SparkSession, d: str) -> DataFrame:
    """Citations of documents that are unknown, or known only later."""
    ev = table(spark, d, "legal_events").select("event_seq", "source_document_id", "assessment_created_at", "source_citations")
    first = ev.groupBy(F.col("source_document_id").alias("doc")).agg(F.min("assessment_created_at").alias("since"))
    c = ev.select("event_seq", "assessment_created_at", F.explode("source_citations").alias("doc")).join(first, "doc", "left")
    return c.where("since IS NULL OR since > assessment_created_at").select("event_seq", "doc", F.when(F.col("since").isNull(), "unknown").otherwise("future").alias("problem"))


@query("""WITH p AS (SELECT assessment_sha256 AS sha, min(assessment_created_at) AS since FROM legal_events WHERE assessment_sha256 IS NOT NULL GROUP BY ALL)
SELECT e.event_seq, CASE WHEN p.sha IS NULL THEN 'unknown' WHEN p.since > e.assessment_created_at THEN 'future' ELSE 'sound' END AS parent FROM legal_events e LEFT JOIN p ON e.parent_assessment_sha256 = p.sha WHERE e.parent_assessment_sha256 IS NOT NULL""")
def parent_chain(spark: SparkSession, d: str) -> DataFrame:
    """Whether each record's parent assessment is known and not later."""
    ev = table(spark, d, "legal_events").select("event_seq", "assessment_sha256", "parent_assessment_sha256", "assessment_created_at")
    p = ev.where("assessment_sha256 IS NOT NULL").groupBy(F.col("assessment_sha256").alias("sha")).agg(F.min("assessment_created_at").alias("since"))
    e = ev.where("parent_assessment_sha256 IS NOT NULL").join(p, F.col("parent_assessment_sha256") == F.col("sha"), "left")
    state = F.when(F.col("sha").isNull(), "unknown").when(F.col("since") > F.col("assessment_created_at"), "future").otherwise("sound")
    return e.select("event_seq", state.alias("parent"))


@query("""SELECT event_id, count(*) AS n, count(DISTINCT assessment_sha256) AS n_hashes, CASE WHEN count(DISTINCT assessment_sha256) > 1 THEN 'conflict' ELSE 'repeat' END AS kind FROM legal_events WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1""")
def repeated_events(spark: SparkSession, d: str) -> DataFrame:
    """Records repeated under one id: copies if all hashes agree, else conflicts."""
    e = table(spark, d, "legal_events").where("event_id IS NOT NULL").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("assessment_sha256").alias("n_hashes")).where("n > 1")
    return e.withColumn("kind", F.when(F.col("n_hashes") > 1, "conflict").otherwise("repeat"))


@query("""SELECT feed_id, sha256(string_agg(DISTINCT assessment_sha256, '' ORDER BY assessment_sha256)) AS root FROM legal_events WHERE assessment_sha256 IS NOT NULL GROUP BY feed_id""")
def ledger_root(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 over the sorted distinct assessment hashes of each feed, which pass in order
    through one hash: no feed is ever held as a whole."""
    e = table(spark, d, "legal_events").where("assessment_sha256 IS NOT NULL").select(F.coalesce("feed_id", F.lit("")).alias("feed"), "feed_id", "assessment_sha256").distinct()
    w = W.partitionBy("feed").orderBy("assessment_sha256")
    e = e.withColumns({"first": F.lag("feed").over(w).isNull(), "last": F.lead("feed").over(w).isNull()})

    def step(h, b: pa.RecordBatch):
        out = []
        for x, first, last in zip(b["assessment_sha256"].to_pylist(), b["first"].to_pylist(), b["last"].to_pylist()):
            h = hashlib.sha256() if first else h
            h.update(x.encode())
            out.append(h.hexdigest() if last else None)
        return h, {"root": pa.array(out, pa.string())}

    return ordered_scan(e, ["feed"], ["feed", "assessment_sha256"], step, {"root": T.StringType()}).where("last").select("feed_id", "root")


@query(f"""WITH {EDGES}, {_PAIRS}, f AS (SELECT p.event_seq, p.feed_id, p.symbol, p.exposure, g.k AS k0 FROM pairs p ASOF JOIN g ON p.feed_id = g.feed_id AND p.symbol = g.symbol AND p.decision_at < make_timestamptz(g.k * g.step * 1000000)),
o AS (SELECT feed_id, symbol, k, CASE WHEN lead(segment_id, 3) OVER w = segment_id THEN lead(x, 3) OVER w - x END AS post, CASE WHEN lag(segment_id, 6) OVER w = segment_id THEN x - lag(x, 6) OVER w END AS pre FROM e WINDOW w AS (PARTITION BY feed_id, symbol ORDER BY k))
SELECT f.event_seq, f.symbol, f.k0, round(post, 9) + 0.0 AS realised, round(pre / 2, 9) + 0.0 AS expected, round(post - pre / 2, 9) + 0.0 AS abnormal, CASE WHEN post <> 0 THEN sign(post) = sign(exposure) END AS direction_match
FROM f JOIN o ON f.feed_id = o.feed_id AND f.symbol = o.symbol AND f.k0 = o.k""")
def event_study(spark: SparkSession, d: str) -> DataFrame:
    """Return over three periods after the first bar past each decision, against what the six before it lead to expect."""
    w = S.ordered(KEYS)
    e = edges(spark, d)
    same = lambda c: c == F.col("segment_id")
    o = e.select(*KEYS, "k", (F.col("k") * F.col("step") * 1_000_000).alias("t"),
        F.when(same(F.lead("segment_id", 3).over(w)), F.lead("x", 3).over(w) - F.col("x")).alias("post"),
        F.when(same(F.lag("segment_id", 6).over(w)), F.col("x") - F.lag("x", 6).over(w)).alias("pre"))
    ev = table(spark, d, "legal_events").select("event_seq", "feed_id", F.unix_micros("decision_at").alias("us"), F.explode("pair_exposures").alias("symbol", "exposure")).where("exposure <> 0")
    s = J.asof(ev, o, KEYS, "us", "t", ["k", "post", "pre"], forward=True, slot=WEEK_US).where("k IS NOT NULL")
    match = F.when(F.col("post") != 0, F.signum("post") == F.signum("exposure"))
    return s.select("event_seq", "symbol", F.col("k").alias("k0"), rd("post").alias("realised"), rd(F.col("pre") / 2).alias("expected"), rd(F.col("post") - F.col("pre") / 2).alias("abnormal"), match.alias("direction_match"))


@query(f"""WITH {_MID}, p AS (SELECT h, {', '.join(f"max(x) FILTER (symbol = '{s}') AS {s}" for s in TRIANGLE)} FROM mid GROUP BY h)
SELECT h, round(EURUSD, 8) + 0.0 AS z0, round(GBPUSD, 8) + 0.0 AS z1, round(EURGBP - EURUSD + GBPUSD, 8) + 0.0 AS z2 FROM p WHERE EURUSD IS NOT NULL AND GBPUSD IS NOT NULL AND EURGBP IS NOT NULL""")
def triangle_transform(spark: SparkSession, d: str) -> DataFrame:
    """Two base log prices and the residual of the triangle they close."""
    p = J.panel(mid(spark, d), "h", "symbol", TRIANGLE, "x")
    return p.select("h", rd("EURUSD", 8).alias("z0"), rd("GBPUSD", 8).alias("z1"), rd(F.col("EURGBP") - F.col("EURUSD") + F.col("GBPUSD"), 8).alias("z2"))


@query(f"""WITH {_PAIRS}, u AS (SELECT event_seq, substr(symbol, 1, 3) AS currency, exposure FROM pairs UNION ALL SELECT event_seq, substr(symbol, 4, 3), -exposure FROM pairs)
SELECT event_seq, currency, round(sum(exposure), 9) + 0.0 AS exposure FROM u GROUP BY ALL""")
def incidence_exposure(spark: SparkSession, d: str) -> DataFrame:
    """Currency exposure of each record: base plus, quote minus."""
    ev = table(spark, d, "legal_events").select("event_seq", F.explode("pair_exposures").alias("symbol", "w")).where("w <> 0")
    legs = F.explode(F.array(F.struct(F.substring("symbol", 1, 3).alias("currency"), F.col("w")), F.struct(F.substring("symbol", 4, 3).alias("currency"), (-F.col("w")).alias("w"))))
    return ev.select("event_seq", legs.alias("l")).groupBy("event_seq", "l.currency").agg(rd(F.sum("l.w")).alias("exposure"))


@query(f"""WITH {_RET}
SELECT a.symbol AS affected, b.symbol AS source, count(*) AS n, round(corr(a.r, b.r), 7) + 0.0 AS corr, round(1e8 * covar_samp(a.r, b.r), 5) + 0.0 AS cov FROM ret a JOIN ret b USING (h) GROUP BY ALL""")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Correlation and covariance of every two symbols' returns, as rows.

    Each slot's few symbols are gathered and paired inside the slot: one shuffle by slot,
    and at most ten times ten pairs in each.
    """
    s = returns(spark, d).groupBy("h").agg(F.collect_list(F.struct("symbol", "r")).alias("a"))
    p = s.select("a", F.explode("a").alias("x")).select("x", F.explode("a").alias("y"))
    g = p.groupBy(F.col("x.symbol").alias("affected"), F.col("y.symbol").alias("source"))
    return g.agg(F.count(F.lit(1)).alias("n"), rd(F.corr("x.r", "y.r"), 7).alias("corr"), rd(F.covar_samp("x.r", "y.r") * 1e8, 5).alias("cov"))


@query(f"""WITH {_RET}, c AS (SELECT a.symbol AS affected, b.symbol AS source, corr(a.r, b.r) AS c FROM ret a JOIN ret b USING (h) WHERE a.symbol <> b.symbol GROUP BY ALL)
SELECT affected, source, round(c, 7) + 0.0 AS c FROM c WHERE affected < source ORDER BY abs(c) DESC, affected, source LIMIT 15""")
def top_edges(spark: SparkSession, d: str) -> DataFrame:
    """The 15 strongest off-diagonal entries."""
    c = corr_matrix(spark, d).where("affected < source").withColumnRenamed("corr", "c")
    return c.orderBy(F.abs("c").desc(), "affected", "source").limit(15).select("affected", "source", "c")


@query(f"""WITH {_RET}, c AS (SELECT a.symbol AS affected, b.symbol AS source, round(corr(a.r, b.r), 7) AS c FROM ret a JOIN ret b USING (h) WHERE a.symbol <> b.symbol GROUP BY ALL),
i AS (SELECT affected AS symbol, sum(abs(c)) AS s FROM c GROUP BY ALL), o AS (SELECT source AS symbol, sum(abs(c)) AS s FROM c GROUP BY ALL)
SELECT symbol, round(i.s, 5) + 0.0 AS in_strength, round(o.s, 5) + 0.0 AS out_strength FROM i JOIN o USING (symbol)""")
def in_out_strength(spark: SparkSession, d: str) -> DataFrame:
    c = corr_matrix(spark, d).where("affected <> source")
    both = F.explode(F.array(F.struct(F.col("affected").alias("symbol"), F.abs("corr").alias("i"), F.lit(0.0).alias("o")), F.struct(F.col("source").alias("symbol"), F.lit(0.0).alias("i"), F.abs("corr").alias("o"))))
    return c.select(both.alias("e")).groupBy("e.symbol").agg(rd(F.sum("e.i"), 5).alias("in_strength"), rd(F.sum("e.o"), 5).alias("out_strength"))


_COUPLING = _RET + """,
lagged AS (SELECT symbol, h, r, lead(r) OVER w AS nxt, lead(h) OVER w - h AS d FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY h)),
c AS (SELECT CAST(a.h // 6 AS BIGINT) AS day, a.symbol AS affected, b.symbol AS source, count(*) AS n, sum(a.nxt * b.r) AS xy, sum(b.r * b.r) AS xx
  FROM lagged a JOIN lagged b USING (h) WHERE a.d = 1 GROUP BY ALL)"""


def _coupling(spark: SparkSession, d: str) -> DataFrame:
    """Daily moments of each symbol's next return on each other's return."""
    w = W.partitionBy("symbol").orderBy("h")
    l = returns(spark, d).withColumn("nxt", F.when(F.lead("h").over(w) - F.col("h") == 1, F.lead("r").over(w)))
    s = l.groupBy("h").agg(F.collect_list(F.struct("symbol", "r", "nxt")).alias("a"))
    p = s.select("h", "a", F.explode("a").alias("x")).select("h", "x", F.explode("a").alias("y")).where("x.nxt IS NOT NULL")
    g = p.groupBy(F.expr("h div 6").alias("day"), F.col("x.symbol").alias("affected"), F.col("y.symbol").alias("source"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("x.nxt * y.r")).alias("xy"), F.sum(F.expr("y.r * y.r")).alias("xx"))


@query(f"WITH {_COUPLING} SELECT day, affected, source, n, round(CASE WHEN xx > 0 THEN xy / xx END, 6) + 0.0 AS c FROM c")
def coupling_long(spark: SparkSession, d: str) -> DataFrame:
    """Matrix of lagged slopes of each day, one row per cell."""
    return _coupling(spark, d).select("day", "affected", "source", "n", rd(F.expr("try_divide(xy, xx)"), 6).alias("c"))


@query(f"""WITH {_COUPLING} SELECT day, {', '.join(f"round(max(xy / nullif(xx, 0)) FILTER (affected = '{a}' AND source = '{b}'), 6) + 0.0 AS {a}_{b}" for a in SYMBOLS[:2] for b in SYMBOLS[:2])} FROM c GROUP BY day""")
def coupling_wide(spark: SparkSession, d: str) -> DataFrame:
    """The same cells of two symbols side by side, in fixed order."""
    c = _coupling(spark, d).withColumn("ij", F.concat_ws("_", "affected", "source")).withColumn("c", F.expr("try_divide(xy, xx)"))
    names = [f"{a}_{b}" for a in SYMBOLS[:2] for b in SYMBOLS[:2]]
    return c.groupBy("day").agg(*(rd(F.max(F.when(F.col("ij") == n, F.col("c"))), 6).alias(n) for n in names))


@query(f"WITH {_COUPLING} SELECT day, count(*) AS cells, count(DISTINCT affected) AS n_affected, count(*) = count(DISTINCT affected) * count(DISTINCT source) AS complete FROM c GROUP BY day")
def snapshot_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a day's matrix has all its cells."""
    c = _coupling(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("affected").alias("n_affected"), F.count_distinct("source").alias("n_source"))
    return c.select("day", "cells", "n_affected", (F.col("cells") == F.col("n_affected") * F.col("n_source")).alias("complete"))


@query(f"WITH {_COUPLING} SELECT affected, source, count(*) AS days, round(avg(CASE WHEN xx > 0 THEN xy / xx END), 5) + 0.0 AS mean_c, round(stddev_pop(CASE WHEN xx > 0 THEN xy / xx END), 5) + 0.0 AS std_c FROM c GROUP BY ALL")
def coupling_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mean and spread of each cell over the days."""
    c = _coupling(spark, d).withColumn("c", F.expr("try_divide(xy, xx)"))
    return c.groupBy("affected", "source").agg(F.count(F.lit(1)).alias("days"), rd(F.avg("c"), 5).alias("mean_c"), rd(F.stddev_pop("c"), 5).alias("std_c"))


@query(f"""WITH {_COUPLING}, f AS (SELECT affected, source, day, xy / nullif(xx, 0) AS c, lag(xy / nullif(xx, 0)) OVER w AS p, lag(day) OVER w AS pd FROM c WINDOW w AS (PARTITION BY affected, source ORDER BY day)),
s AS (SELECT day, sqrt(sum((c - p) * (c - p))) AS delta, sqrt(sum(p * p)) AS size FROM f WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY day)
SELECT day, round(delta, 5) + 0.0 AS delta, round(CASE WHEN size > 0 THEN delta / size END, 5) + 0.0 AS relative, coalesce(size > 0 AND delta / size >= 0.5, false) AS regime_break FROM s""")
def snapshot_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of the matrix against the one before, and whether it breaks the regime."""
    w = W.partitionBy("affected", "source").orderBy("day")
    c = _coupling(spark, d).withColumn("c", F.expr("try_divide(xy, xx)")).withColumn("p", F.lag("c").over(w)).where("c IS NOT NULL AND p IS NOT NULL")
    s = c.groupBy("day").agg(F.sqrt(F.sum(F.expr("(c - p) * (c - p)"))).alias("delta"), F.sqrt(F.sum(F.expr("p * p"))).alias("size")).withColumn("rel", F.expr("try_divide(delta, size)"))
    return s.select("day", rd("delta", 5).alias("delta"), rd("rel", 5).alias("relative"), F.coalesce(F.col("rel") >= 0.5, F.lit(False)).alias("regime_break"))


@query(f"""WITH {_PAIRS}, p AS (SELECT event_seq, coalesce(sum(exposure) FILTER (symbol = 'EURUSD'), 0) AS a, coalesce(sum(exposure) FILTER (symbol = 'GBPUSD'), 0) AS b, coalesce(sum(exposure) FILTER (symbol = 'EURGBP'), 0) AS c FROM pairs GROUP BY event_seq)
SELECT event_seq, round(a - c, 9) + 0.0 AS w_eurusd, round(b + c, 9) + 0.0 AS w_gbpusd, round(c, 9) + 0.0 AS w_eurgbp FROM p""")
def dual_weights(spark: SparkSession, d: str) -> DataFrame:
    """Signals on the basis (EURUSD, GBPUSD, triangle residual) as weights of the pairs:
    the transpose of the transform, not its inverse."""
    ev = table(spark, d, "legal_events").select("event_seq", F.map_filter("pair_exposures", lambda _, v: v != 0).alias("m")).where("size(m) > 0")
    s = {n: F.coalesce(F.try_element_at("m", F.lit(n)), F.lit(0.0)) for n in TRIANGLE}
    t = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [-1.0, 1.0, 1.0]]  # rows: basis, columns: pairs in order of TRIANGLE
    w = [sum((s[n] * t[i][j] for i, n in enumerate(TRIANGLE)), F.lit(0.0)) for j in range(3)]
    return ev.select("event_seq", *(rd(c).alias(f"w_{n.lower()}") for n, c in zip(TRIANGLE, w)))


@query(f"""WITH {GRID}, f AS (SELECT feed_id, symbol, min(epoch_us(timestamp)) AS f FROM dynamics_params GROUP BY ALL),
r AS (SELECT g.feed_id, g.symbol, g.k, row_number() OVER (PARTITION BY g.feed_id, g.symbol ORDER BY g.k) AS i FROM g JOIN f USING (feed_id, symbol) WHERE g.k * g.step * 1000000 >= f.f)
SELECT feed_id, symbol, k FROM r WHERE i <= 100 + greatest(20, 100 // 5)""")
def bounded_window(spark: SparkSession, d: str) -> DataFrame:
    """From each series' first parameters on, 100 rows and a fifth more for what later joins lose."""
    first = table(spark, d, "dynamics_params").groupBy(*KEYS).agg(F.min(F.unix_micros("timestamp")).alias("f"))
    g = grid(spark, d).select(*KEYS, "k", (F.col("k") * F.col("step") * 1_000_000).alias("us")).join(first, KEYS).where("us >= f")
    return g.withColumn("i", F.row_number().over(W.partitionBy(*KEYS).orderBy("k"))).where("i <= 120").select(*KEYS, "k")


@query(f"""WITH {GRID} SELECT feed_id, symbol, k, k * step >= epoch(TIMESTAMP '2024-11-01')::BIGINT AS test FROM g WHERE k * step >= epoch(TIMESTAMP '2024-10-01')::BIGINT AND k * step < epoch(TIMESTAMP '2024-12-01')::BIGINT""")
def split_window(spark: SparkSession, d: str) -> DataFrame:
    """Two periods, the later one for testing; the time range reaches the scan."""
    b = table(spark, d, "bars").where("timestamp >= timestamp'2024-10-01' AND timestamp < timestamp'2024-12-01'")
    g = S.grid_bars(b, table(spark, d, "series"), KEYS)
    return g.select(*KEYS, "k", (F.col("k") * F.col("step") >= F.unix_timestamp(F.lit("2024-11-01").cast("timestamp"))).alias("test"))


@query(f"""WITH {_PAIRS}, n AS (SELECT event_seq, count(*) AS n_pairs FROM pairs GROUP BY event_seq) SELECT e.event_seq, e.event_id, coalesce(n_pairs, 0) AS n_pairs FROM legal_events e LEFT JOIN n USING (event_seq)""")
def write_back(spark: SparkSession, d: str) -> DataFrame:
    """Results computed per pair put back onto the records they came from."""
    ev = table(spark, d, "legal_events").select("event_seq", "event_id", "pair_exposures")
    n = exposed_pairs(ev.select("event_seq", "pair_exposures")).groupBy("event_seq").agg(F.count(F.lit(1)).alias("n_pairs"))
    return ev.select("event_seq", "event_id").join(n, "event_seq", "left").fillna(0, ["n_pairs"])
