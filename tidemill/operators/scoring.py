"""Scores of probabilistic forecasts, climatologies and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-12


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(TINY), F.least(F.lit(1.0 - TINY), p))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(-(y * F.ln(clipped(p)) + (1 - y) * F.ln(1 - clipped(p))))


def multiclass_brier(ps: Sequence[Column], y: Column) -> Column:
    return F.avg(sum(((p - (y == c).cast("double")) ** 2 for c, p in enumerate(ps)), F.lit(0.0)))


def multiclass_log_loss(ps: Sequence[Column], y: Column) -> Column:
    own = F.when(y == 0, ps[0])
    for c, p in enumerate(ps[1:], 1):
        own = own.when(y == c, p)
    return F.avg(-F.ln(clipped(own)))


def top1(ps: Sequence[Column], y: Column) -> Column:
    """Share of rows whose largest probability is the class; the first of equals counts."""
    a = F.array(*ps)
    return F.avg((F.array_position(a, F.array_max(a)) - 1 == y).cast("double"))


def calibration_error(rows: DataFrame, keys: Sequence[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Weighted mean distance of mean forecast and frequency over equal bins, per key."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    per = rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"))


def laplace_prior(rows: DataFrame, keys: Sequence[str], by: str, label: str, classes: int) -> DataFrame:
    """Adds prior_0..: (count + 1) / (n + classes) over strictly earlier rows of the key."""
    w = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    n = F.count(label).over(w)
    return rows.withColumns({f"prior_{c}": (F.count_if(F.col(label) == c).over(w) + 1) / (n + classes).cast("double") for c in range(classes)})


def climatology(train: DataFrame, target: DataFrame, tiers: Sequence[Sequence[str]], label: str, classes: int, least: int = 20, alpha: float = 1.0) -> DataFrame:
    """Target rows with p_0.. and ``tier``: frequencies of the first tier of keys whose cell
    has at least ``least`` training rows; the last tier is the whole training set.

    All tiers come from one aggregate at the finest grain, rolled up; null keys are cells.
    """
    counts = [F.count_if(F.col(label) == c).alias(f"__n{c}") for c in range(classes)]
    finest = list(dict.fromkeys(k for t in tiers for k in t))
    cells = train.where(F.col(label).isNotNull()).groupBy(*finest).agg(*counts)
    t = target
    total = lambda i: sum((F.col(f"__n{c}_{i}") for c in range(classes)), F.lit(0))
    for i, keys in enumerate(tiers):
        c = cells.groupBy(*keys).agg(*(F.sum(f"__n{j}").alias(f"__n{j}_{i}") for j in range(classes))).select(*(F.col(k).alias(f"__k{i}_{k}") for k in keys), *(f"__n{j}_{i}" for j in range(classes)))
        if keys:
            on = F.lit(True)
            for k in keys:
                on = on & F.col(k).eqNullSafe(F.col(f"__k{i}_{k}"))
            t = t.join(c, on, "left").drop(*(f"__k{i}_{k}" for k in keys))
        else:
            t = t.join(c, F.lit(True), "left")  # one row
    out, tier = [F.lit(None).cast("double")] * classes, F.lit(None).cast("int")
    for i in reversed(range(len(tiers))):
        enough = (total(i) >= least) if i < len(tiers) - 1 else F.lit(True)
        n = F.coalesce(total(i), F.lit(0))
        out = [F.when(enough, (F.coalesce(F.col(f"__n{c}_{i}"), F.lit(0)) + alpha) / (n + alpha * classes)).otherwise(out[c]) for c in range(classes)]
        tier = F.when(enough, F.lit(i)).otherwise(tier)
    return t.select(*target.columns, *(p.alias(f"p_{c}") for c, p in enumerate(out)), tier.alias("tier"))


def holm(tests: DataFrame, family: Sequence[str], ident: str, p: str, alpha: float) -> DataFrame:
    """Adds ``rank``, ``threshold`` and ``rejected``: ascending p, ties by id, the first
    failure stops its family."""
    w = W.partitionBy(*family).orderBy(p, ident)
    size = F.count(F.lit(1)).over(W.partitionBy(*family))
    t = tests.withColumn("rank", F.row_number().over(w))
    t = t.withColumn("threshold", F.lit(alpha) / (size - F.col("rank") + 1))
    return t.withColumn("rejected", F.min((F.col(p) <= F.col("threshold")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1)
