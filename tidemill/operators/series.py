"""Ordered operators over regular series: lags, gaps, segments, averages, regressions.

A series frame has the key columns, ``step`` (seconds), ``k`` (number of the period since
1970) and ``x`` (log price).  Two rows are contiguous when their ``k`` differ by one; a value
never crosses a gap.  Windows are always partitioned by the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], by: str = "k"):
    return W.partitionBy(*keys).orderBy(by)


def grid_bars(bars: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One bar per series and period: the last reading of the period (of equal times the
    smallest ``bar_id``), positive closes only.  One shuffle, no join but the small one."""
    b = bars.where("close > 0 AND close < double('infinity')").join(series.select(*keys, F.col("bar_seconds").cast("long").alias("step")), list(keys))
    b = b.withColumn("k", F.expr("(unix_micros(timestamp) - pmod(unix_micros(timestamp), step * 1000000)) div (step * 1000000)"))
    last = F.max_by(F.struct("close", "volume"), F.struct("timestamp", -F.col("bar_id")))
    g = b.groupBy(*keys, "step", "k").agg(last.alias("b"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "step", "k", F.col("b.close").alias("close"), F.col("b.volume").alias("volume"), "n", F.ln("b.close").alias("x"))


def keep_first(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The first row of each key by position; of equal positions the one with the smallest
    hash of its other columns, so that the choice doesn't depend on how rows arrive."""
    other = [f"`{f.name}`" for f in rows.schema.fields if f.name not in (*keys, position) and "map<" not in f.dataType.simpleString()]
    w = W.partitionBy(*keys).orderBy(F.col(f"`{position}`"), *([F.xxhash64(*other)] if other else []))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def duplicate_report(rows: DataFrame, keys: Sequence[str], group: Sequence[str], payload: Sequence[str], position: str) -> DataFrame:
    """Per ``group``: rows, rows beyond the first of their key, and of these the ones whose
    payload differs from the first (nulls equal)."""
    w = W.partitionBy(*keys).orderBy(position)
    r = rows.withColumns({"__rn": F.row_number().over(w), **{f"__f_{c}": F.first(c).over(w) for c in payload}})
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"__f_{c}"))
    n = lambda c, a: F.count_if(c).alias(a)
    return r.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), n(F.col("__rn") > 1, "n_duplicates"), n((F.col("__rn") > 1) & ~same, "n_conflicts"))


def constraints(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Violations of each rule (SQL predicates that must not be false) in one pass."""
    a = rows.agg(*(F.count_if(F.expr(f"NOT ({e})")).alias(n) for n, e in rules.items()), F.count(F.lit(1)).alias("__n"))
    entries = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))
    return a.select(F.explode(entries).alias("e"), F.col("__n").alias("n_rows")).select("e.rule", "e.violations", "n_rows")


#: Periods of a slot into which a series is cut.
SLOT = 1 << 16


def with_edges(s: DataFrame, keys: Sequence[str], slot: int = SLOT) -> DataFrame:
    """Adds ``ret`` (null across a gap), ``contiguous``, ``two_step`` and ``segment_id``.

    The first row is no contiguous arrival; the first row after a gap opens a segment.

    A row needs only the two periods before it, so a series is cut into slots of ``slot``
    periods, each with the last two of the slot before: one that holds a third of all rows
    is spread over tasks.  Segments are numbered in each slot and begin after those counted
    in the slots before it.
    """
    own = F.expr(f"cast(floor(k / {slot}) as bigint)")
    into = F.when(F.expr(f"pmod(k, {slot}) >= {slot - 2}"), F.array(own, own + 1)).otherwise(F.array(own))
    s = s.withColumn("__own", own).withColumn("__slot", F.explode(into))
    w = ordered([*keys, "__slot"])
    d = F.col("k") - F.lag("k").over(w)
    s = s.withColumn("contiguous", F.coalesce(d == 1, F.lit(False)))
    s = s.withColumns({
        "ret": F.when(F.col("contiguous"), F.col("x") - F.lag("x").over(w)),
        "two_step": F.col("contiguous") & F.coalesce(F.lag("contiguous").over(w), F.lit(False)),
        "segment_id": F.sum((~F.col("contiguous") & (F.col("__own") == F.col("__slot"))).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1,
    }).where("__own = __slot")
    slots = s.groupBy(*keys, "__slot").agg((F.max("segment_id") + 1).alias("__n"))  # a row a slot
    before = F.coalesce(F.sum("__n").over(ordered(keys, "__slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.join(slots.select(*keys, "__slot", before.alias("__before")), [*keys, "__slot"])
    return s.withColumn("segment_id", F.col("segment_id") + F.col("__before")).drop("__own", "__slot", "__before")


def kinematics(s: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Velocity and acceleration per second; null where the edges are not contiguous."""
    w = ordered(keys)
    v = F.col("ret") / F.col("step")
    s = s.withColumn("v", v)
    return s.withColumn("a", F.when(F.col("two_step"), (F.col("v") - F.lag("v").over(w)) / F.col("step")))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def trailing_sums(s: DataFrame, keys: Sequence[str], sums: dict[str, Column], rows: int, by: str = "k") -> DataFrame:
    """Adds sums of the last ``rows`` rows (fewer at the start), nulls as 0, in time
    independent of ``rows``.

    The rows of a key are laid in blocks of ``rows``: the last ``rows`` rows are the end of
    one block and the beginning of the next, both running sums.  Nothing is subtracted, so
    no digits are lost and a NaN leaves the sums when it leaves the window.
    """
    s = s.withColumns({f"__v_{n}": F.coalesce(c, F.lit(0.0)) for n, c in sums.items()})
    s = s.withColumn("__block", F.expr(f"(row_number() OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY `{by}`) - 1) div {rows}"))
    inside = W.partitionBy(*keys, "__block").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    # the rest of a block is summed from its end: the same block in the opposite order
    after = W.partitionBy(*keys, "__block").orderBy(F.col(by).desc()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({f"__a_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    s = s.withColumns({f"__b_{n}": F.sum(f"__v_{n}").over(after) for n in sums})
    w = ordered(keys, by)
    s = s.withColumns({n: F.col(f"__a_{n}") + F.coalesce(F.lag(f"__b_{n}", rows).over(w), F.lit(0.0)) for n in sums})
    return s.drop("__block", *(f"__{x}_{n}" for n in sums for x in "vab"))


def rolling_ols(s: DataFrame, keys: Sequence[str], y: str, r1: str, r2: str, rows: int, least: int) -> DataFrame:
    """Trailing two-regressor least squares without intercept, over ``rows`` rows of which
    only those with all three values count.  Adds n_valid, b1, b2 and b2_only, null unless
    n_valid >= ``least``, the determinant and both squares are positive."""
    ok = F.col(y).isNotNull() & F.col(r1).isNotNull() & F.col(r2).isNotNull()
    m = lambda a, b: F.when(ok, F.col(a) * F.col(b))
    s = trailing_sums(s, keys, {"n_valid": F.when(ok, F.lit(1.0)), "s11": m(r1, r1), "s22": m(r2, r2), "s12": m(r1, r2), "s1y": m(r1, y), "s2y": m(r2, y)}, rows)
    s = s.withColumn("det", F.expr("s11 * s22 - s12 * s12"))
    good = F.expr(f"n_valid >= {least} AND det > 0 AND s11 > 0 AND s22 > 0")
    return s.withColumns({
        "b1": F.when(good, F.expr("try_divide(s1y * s22 - s2y * s12, det)")),
        "b2": F.when(good, F.expr("try_divide(s2y * s11 - s1y * s12, det)")),
        "b2_only": F.when(good, F.expr("try_divide(s2y, s22)")),
    })


def ewma_wall(s: DataFrame, keys: Sequence[str], value: str, half_life_s: float, out: str) -> DataFrame:
    """Normalised wall-clock exponential average: weights 2^(-age / half life) over all rows
    up to now.

    Weights are taken from the start of the row's block of 256 half lives, so they never
    overflow; sums of earlier blocks come in damped: numerator and denominator of block b
    reach block b + 1 times 2^-256 and no later one (below double precision).
    """
    block = F.floor(F.col("k") * F.col("step") / F.lit(256.0 * half_life_s)).cast("long")
    s = s.withColumn("__b", block)
    age = (F.col("k") * F.col("step") - F.col("__b") * F.lit(256.0 * half_life_s)) / F.lit(half_life_s)
    has = F.col(value).isNotNull()
    s = s.withColumns({"__g": F.when(has, F.pow(F.lit(2.0), age)), "__age": age})
    inside = W.partitionBy(*keys, "__b").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys, "__b")
    s = s.withColumns({"__n": F.sum(F.col("__g") * F.col(value)).over(inside), "__d": F.sum("__g").over(inside), "__tn": F.sum(F.col("__g") * F.col(value)).over(whole), "__td": F.sum("__g").over(whole)})
    first = F.lag("__b").over(ordered(keys)) != F.col("__b")
    w = ordered(keys)
    s = s.withColumn("__f", F.coalesce(first, F.lit(False)))
    # the totals of the block just before, seen at this block's first row
    s = s.withColumns({c: F.when(F.col("__f") & (F.lag("__b").over(w) == F.col("__b") - 1), F.lag(t).over(w)) for c, t in (("__pn", "__tn"), ("__pd", "__td"))})
    s = s.withColumns({c: F.coalesce(F.first(c, ignorenulls=True).over(inside), F.lit(0.0)) * F.lit(2.0**-256) for c in ("__pn", "__pd")})
    num, den = F.coalesce("__n", F.lit(0.0)) + F.col("__pn"), F.coalesce("__d", F.lit(0.0)) + F.col("__pd")
    return s.withColumn(out, F.when(den > 0, num / den)).drop("__b", "__g", "__age", "__n", "__d", "__tn", "__td", "__f", "__pn", "__pd")


def ewma_recursive(s: DataFrame, keys: Sequence[str], value: str, half_life_rows: float, start: float, out: str) -> DataFrame:
    """s(n) = (1 - a) s(n-1) + a v(n) inside each segment, from ``start``; a from the half
    life in rows; null values count as 0; ``keys`` must contain the segment.

    Closed form over running sums in blocks of 512 half lives, so that no weight overflows
    however long a segment is: a block begins with the state at the end of the one before
    it, which takes in its own rows and, the second one, the start; what is older has lost
    2^-512 of its weight.
    """
    rate = 2.0 ** (-1.0 / half_life_rows)
    size = max(1, int(512 * half_life_rows))
    w = ordered(keys)
    s = s.withColumn("__i", F.row_number().over(w) - 1).withColumns({"__b": F.expr(f"__i div {size}"), "__j": F.expr(f"__i % {size} + 1")})
    q = F.expr(f"pow({rate!r}D, cast(-__j as double)) * coalesce({value}, 0D)")
    inside = W.partitionBy(*keys, "__b").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("__s", F.sum(q).over(inside))
    # the last sum of a block, seen at the first row of the next and carried along it
    s = s.withColumn("__p", F.when(F.expr("__j = 1 AND __b > 0"), F.lag("__s").over(w)))
    before = F.coalesce(F.first("__p", ignorenulls=True).over(inside), F.lit(0.0))
    s = s.withColumn("__p", F.lit(rate**size) * (F.lit(1.0 - rate) * before + F.when(F.col("__b") == 1, F.lit(start)).otherwise(0.0)) + F.when(F.col("__b") == 0, F.lit(start)).otherwise(0.0))
    return s.withColumn(out, F.expr(f"pow({rate!r}D, cast(__j as double)) * (__p + {1.0 - rate!r}D * __s)")).drop("__i", "__b", "__j", "__s", "__p")


def acf_gap_aware(s: DataFrame, keys: Sequence[str], value: str, lags: Sequence[int], least: int) -> DataFrame:
    """Autocorrelation over pairs of rows exactly ``lag`` periods apart; null below ``least`` pairs."""
    w = ordered(keys)
    s = s.withColumns({f"__l{n}": F.when(F.col("k") - F.lag("k", n).over(w) == n, F.lag(value, n).over(w)) for n in lags})
    both = lambda n: F.when(F.col(f"__l{n}").isNotNull() & F.col(value).isNotNull(), F.col(f"__l{n}"))
    aggs = [a for n in lags for a in (F.count(both(n)).alias(f"n_{n}"), F.corr(F.when(both(n).isNotNull(), F.col(value)), both(n)).alias(f"c_{n}"))]
    a = s.groupBy(*keys).agg(*aggs)
    cell = lambda n: F.struct(F.lit(n).alias("lag"), F.col(f"n_{n}").alias("pairs"), F.when(F.col(f"n_{n}") >= least, F.col(f"c_{n}")).alias("acf"))
    return a.select(*keys, F.explode(F.array(*(cell(n) for n in lags))).alias("e")).select(*keys, "e.*")


def moments(s: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, both deviations and bias-corrected skewness and excess kurtosis."""
    v = F.col(value)
    a = s.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    return a.select(
        *keys, "n", "mean", "std", "std_pop",
        F.expr("CASE WHEN n > 2 THEN g1 * sqrt(n * (n - 1D)) / (n - 2D) END").alias("skew"),
        F.expr("CASE WHEN n > 3 THEN ((n + 1D) * g2 + 6D) * (n - 1D) / ((n - 2D) * (n - 3D)) END").alias("kurtosis"),
    )


def hour_of_week(step: str = "step", k: str = "k") -> Column:
    """Monday 00 UTC is 0."""
    hours = F.floor(F.col(k) * F.col(step) / 3600)
    return F.pmod(hours + 72, F.lit(168)).cast("int")


def even_positions(rows: DataFrame, keys: Sequence[str], by: str, cap: int) -> DataFrame:
    """At most ``cap`` rows of each key at evenly spaced positions, first and last included."""
    w, all_w = ordered(keys, by), W.partitionBy(*keys)
    r = rows.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(all_w)})
    # position i is taken when some j < cap has floor(j (n-1) / (cap-1)) = i
    if cap == 1:
        return r.where("__i = 0").drop("__i", "__n")
    j = f"cast(ceil(__i * {cap - 1} / greatest(__n - 1D, 1D)) as bigint)"
    taken = f"__n <= {cap} OR ({j} <= {cap - 1} AND floor({j} * (__n - 1) / {cap - 1}D) = __i)"
    return r.where(taken).drop("__i", "__n")
