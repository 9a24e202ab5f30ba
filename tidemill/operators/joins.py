"""Joins in time: panels, as-of lookups, outcomes at a horizon, interval overlaps.

As-of joins are one union and one window: both sides are sorted once by (key, time) and
the last right row is carried forward; no range join, no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_t: str,
    right_t: str,
    carry: Sequence[str],
    rank: Sequence[str] = (),
    max_age: float | None = None,
    forward: bool = False,
    prefix: str = "",
    slot: float | None = None,
) -> DataFrame:
    """Each left row with the ``carry`` columns of the last right row of its keys at or
    before its time (``forward``: the first strictly after), null if there is none or it is
    older than ``max_age``.

    Among right rows of one time the one last in order of ``rank`` wins (forward: the
    first).  Times are numbers.  Left rows with a null time, and rows with null keys
    together as one entity, are kept; right rows with a null time are left out.

    ``slot``: a length of time by which keys are cut, so that one with a third of all rows
    is spread over tasks; what a slot must know of those before it is one row, found from
    the last right rows of all slots.
    """
    got = F.struct(F.col(right_t).alias("__t"), *(F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)))
    ranks = [f"__r{i}" for i in range(len(rank))]
    r = right.where(F.col(right_t).isNotNull()).select(*keys, F.col(right_t).alias("__at"), *(F.col(c).alias(n) for c, n in zip(rank, ranks)), got.alias("__got"), F.lit(0).alias("__side"))
    l = left.select(*keys, F.col(left_t).alias("__at"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("__left"), F.lit(1).alias("__side"))
    u = r.unionByName(l, allowMissingColumns=True)
    if forward:  # from the end: a left row stands before right rows of its own time
        order = [F.col("__at").desc_nulls_first(), F.col("__side").desc(), *(F.col(n).desc() for n in ranks)]
    else:
        order = [F.col("__at").asc(), F.col("__side").asc(), *(F.col(n).asc() for n in ranks)]
    by = list(keys)
    if slot:
        by.append("__slot")
        u = u.withColumn("__slot", F.expr(f"cast(floor(__at / {float(slot)}D) as bigint)"))
        at = F.when(F.col("__side") == 0, F.struct("__at", *ranks))
        ends = u.where("__slot IS NOT NULL").groupBy(*by).agg((F.min_by if forward else F.max_by)("__got", at).alias("__end"))
        along = W.partitionBy(*keys).orderBy(F.col("__slot").desc() if forward else F.col("__slot")).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*by, F.last("__end", ignorenulls=True).over(along).alias("__got"), F.lit(0).alias("__side")).where("__got IS NOT NULL")
        u = u.unionByName(carried, allowMissingColumns=True)  # without a time, so first in its slot
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    u = u.withColumn("__got", F.last("__got", ignorenulls=True).over(w)).where("__side = 1")
    fits = F.col("__at").isNotNull() & F.col("__got").isNotNull()
    if max_age is not None:
        fits = fits & (F.abs(F.col("__at") - F.col("__got.__t")) <= max_age)
    return u.select(*(F.col(f"__left.`{c}`") for c in left.columns), *(F.when(fits, F.col(f"__got.__c{i}")).alias(prefix + c) for i, c in enumerate(carry)))


def panel(rows: DataFrame, at: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    """Wide synchronous panel: instants at which every name has a value.  One shuffle.

    A name has at most one value at an instant: a second one ends the job with an error,
    as which of them is meant cannot be told.
    """
    own = {n: F.when(F.col(column) == n, F.col(value)) for n in names}
    p = rows.where(F.col(column).isin(list(names))).groupBy(at).agg(*(F.max(c).alias(n) for n, c in own.items()), F.array(*(F.count(c) for c in own.values())).alias("__n"))
    p = p.where(F.when(F.exists("__n", lambda c: c > 1), F.raise_error(F.concat(F.lit("several values of a name at "), F.col(at).cast("string")))).isNull())
    return p.drop("__n").dropna(subset=list(names))


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint unions of closed intervals of each key; touching ones merge, adjacent do not."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    r = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end)
    r = r.withColumn("__new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("long"))
    r = r.withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def overlaps_any(rows: DataFrame, others: DataFrame, keys: Sequence[str], start: str, end: str, flag: str = "overlaps") -> DataFrame:
    """``rows`` with a flag: its closed interval meets one of ``others`` of the same key.

    The others are merged first; of disjoint intervals only the last that starts at or
    before a row's end can meet it, so one as-of lookup decides.
    """
    m = merge_intervals(others, keys, start, end).select(*keys, F.col(start).alias("__os"), F.col(end).alias("__oe"))
    r = asof(rows, m, keys, end, "__os", ["__oe"])
    return r.withColumn(flag, F.coalesce(F.col("__oe") >= F.col(start), F.lit(False))).drop("__oe")
