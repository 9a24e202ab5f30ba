"""Entries with horizons: episodes, clusters, overlaps, acceptance and turnover.

An entry frame has the key columns, ``source_index``, ``segment_id``, ``horizon``,
``component`` and ``eligible``, in order of ``source_index`` inside each key.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.sequential import ordered_scan


def _w(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("source_index")


def episodes(entries: DataFrame, keys: Sequence[str], cooldown: int = 0) -> DataFrame:
    """Adds ``episode``: a new one where the row before is ineligible, of another component
    or segment, or more than 1 + cooldown away; -1 for ineligible rows."""
    w = _w(keys)
    lag = lambda c: F.lag(c).over(w)
    goes_on = lag("eligible") & (lag("component") == F.col("component")) & (lag("segment_id") == F.col("segment_id")) & (F.col("source_index") - lag("source_index") <= 1 + cooldown)
    new = F.when(F.col("eligible") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)
    e = entries.withColumn("__new", new)
    e = e.withColumn("episode", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return e.withColumn("episode", F.when(F.col("eligible"), F.col("episode")).otherwise(-1)).drop("__new")


def target_clusters(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``cluster``: rows chained while they start at or before the furthest end so far
    and the segment does not change between consecutive rows."""
    w = _w(keys)
    e = entries.withColumn("__end", F.col("source_index") + F.col("horizon"))
    e = e.withColumn("__run", F.sum(F.coalesce(F.lag("segment_id").over(w) != F.col("segment_id"), F.lit(True)).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy(*keys, "__run").orderBy("source_index")
    reach = F.max("__end").over(inside.rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("__new", F.coalesce(F.col("source_index") > reach, F.lit(True)).cast("long"))
    return e.withColumn("cluster", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__end", "__run", "__new")


def overlap_counts(entries: DataFrame, keys: Sequence[str], within: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Adds for eligible rows ``active``, the earlier eligible entries of the segment still
    open at the row, and ``overlap``, how far the furthest of them reaches beyond it.

    ``within``: names of more counts, each of the open entries that agree with the row in the
    columns given.  Openings and closings are counted along one sorted stream, so no pairs
    arise.
    """
    g, more = [*keys, "segment_id"], within or {}
    e = entries.where("eligible")
    same = list(dict.fromkeys(c for cs in more.values() for c in cs))
    opened = e.select(*entries.columns, F.col("source_index").alias("__at"), F.lit(1).alias("__kind"))
    closed = e.select(*g, *same, (F.col("source_index") + F.col("horizon")).alias("__at"), F.lit(2).alias("__kind"))
    along = lambda cs: W.partitionBy(*g, *cs).orderBy("__at", "__kind").rowsBetween(W.unboundedPreceding, -1)
    still = F.when(F.col("__kind") == 1, 1).otherwise(-1)
    u = opened.unionByName(closed, allowMissingColumns=True)
    u = u.withColumns({
        "active": F.coalesce(F.sum(still).over(along([])), F.lit(0)),
        "__reach": F.max(F.when(F.col("__kind") == 1, F.col("source_index") + F.col("horizon"))).over(along([])),
    })
    u = u.withColumns({n: F.coalesce(F.sum(still).over(along(cs)), F.lit(0)) for n, cs in more.items()}).where("__kind = 1")
    over = F.coalesce(F.greatest(F.col("__reach") - F.col("source_index"), F.lit(0)), F.lit(0))
    return u.withColumn("overlap", over).select(*entries.columns, "active", "overlap", *more)


def _choose(open_until: int | None, batch: pa.RecordBatch) -> tuple[int | None, dict[str, pa.Array]]:
    start, end, anew = (batch[c].to_pylist() for c in ("source_index", "__end", "__new"))
    out = []
    for s, e, n in zip(start, end, anew):
        take = bool(n) or open_until is None or s > open_until
        if take:
            open_until = e
        out.append(take)
    return open_until, {"accepted": pa.array(out)}


def greedy_accept(entries: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Eligible rows with ``accepted``: taken in order when they start after the end of the
    last one taken in their segment (and group ``by``).

    The choice is a chain and so runs in Python, as one ordered scan whose whole state is
    the end of the last taken row.  Where no earlier interval reaches a row the chain starts
    anew, so long segments are spread by their clusters.
    """
    g = [*keys, "segment_id", *by]
    w = W.partitionBy(*g).orderBy("source_index")
    e = entries.where("eligible").withColumn("__end", F.col("source_index") + F.col("horizon"))
    reach = F.max("__end").over(w.rowsBetween(W.unboundedPreceding, -1))
    e = e.withColumn("__new", F.coalesce(F.col("source_index") > reach, F.lit(True)).cast("long"))
    e = e.withColumn("__c", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    done = ordered_scan(e, [*g, "__c"], [*g, "source_index"], _choose, {"accepted": T.BooleanType()})
    return done.select(*entries.columns, "accepted")


def turnover(entries: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Adds ``turnover``: Σ|w - w before|, 0 at the start of each run of a segment."""
    w = _w(keys)
    same = F.lag("segment_id").over(w) == F.col("segment_id")
    change = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in weights), F.lit(0.0))
    return entries.withColumn("turnover", F.when(same, change).otherwise(0.0))


def accepted_turnover(accepted: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Turnover against the last accepted row of the segment; null for its first."""
    w = W.partitionBy(*keys, "segment_id").orderBy("source_index")
    change = sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in weights), F.lit(0.0))
    return accepted.where("accepted").withColumn("turnover", change)
