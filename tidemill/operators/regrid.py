"""Problem 3: irregular readings onto a regular grid.

The value at a grid time is a weighted local polynomial in the readings around it.  The
kernel (Epanechnikov) ends at ``bandwidth`` periods, so a reading reaches a known, small
set of grid periods: it is indexed by exactly those, the weighted moments are summed per
period, and the polynomial is solved from the moments in closed form.  The effective
support of a period, from its own readings and from all within reach, says whether it is
missing and whether it can be filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def regular_grid(
    readings: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    step_s: str,
    bandwidth: float = 2.0,
    min_support: float = 1.5,
    extent: str = "series",
) -> DataFrame:
    """One row per entity and grid period.

    ``step_s`` is a column of ``readings`` with the entity's period in whole seconds;
    periods are counted from 1970-01-01 UTC, start included, end excluded.  Output: keys,
    ``step_s``, ``period_start`` (seconds), ``n_readings`` (non-null readings inside the
    period), ``own_support`` (their effective number, (Σw)²/Σw² of the kernel's weights),
    ``missing`` (``own_support`` is 0: nothing in the period itself bears it out; with one
    reading it is 1, with more more),
    ``estimate`` (the local polynomial at the period's middle), ``support`` (effective
    number of all finite readings within reach), ``supported`` (``support`` >=
    ``min_support``; below it the estimate is null).  Degree 1 where the readings spread in
    time, else degree 0.

    ``extent``: "series" from the entity's first to its last reading, "day" only inside
    each UTC day, from that day's first to its last reading.  Readings at the same time
    all count; rows with null time, value, key or step (or a step < 1) are left out;
    non-finite values have no part in estimate and support, but are readings of their
    period.  An entity without
    readings has no grid, an empty table gives an empty result.
    """
    if bandwidth <= 0.5:
        raise ValueError("the kernel must reach beyond its own period")
    k = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)]
    kn = [f"__k{i}" for i in range(len(keys))]
    r = readings.select(*k, F.col(f"`{step_s}`").cast("long").alias("__step"), F.unix_micros(ts).alias("__us"), F.col(f"`{value}`").cast("double").alias("__y"))
    r = r.where(" AND ".join(f"{c} IS NOT NULL" for c in (*kn, "__step", "__us", "__y")) + " AND __step >= 1")
    # position in periods; a reading reaches the periods whose middle is nearer than the bandwidth
    r = r.withColumns({"__p": F.expr("floor(__us / (__step * 1000000D))"), "__x": F.expr("__us / (__step * 1000000D)")})
    r = r.withColumn("__p", F.expr("CASE WHEN __p * __step * 1000000 > __us THEN __p - 1 WHEN (__p + 1) * __step * 1000000 <= __us THEN __p + 1 ELSE __p END"))
    reach = F.sequence(F.expr(f"least(__p, cast(ceil(__x - 0.5 - {bandwidth}) as bigint))"), F.expr(f"greatest(__p, cast(floor(__x - 0.5 + {bandwidth}) as bigint))"))
    r = r.withColumn("__g", F.explode(reach))
    ok = "abs(__y) < double('infinity')"
    r = r.withColumn("__d", F.expr("__x - 0.5 - __g"))
    r = r.withColumn("__k", F.expr(f"greatest(0D, 1D - pow(__d / {bandwidth}, 2))"))  # a period's own readings are nearer than the bandwidth
    r = r.withColumn("__w", F.expr(f"IF({ok}, __k, 0D)"))
    r = r.withColumn("__y", F.expr(f"IF({ok}, __y, 0D)"))
    s = lambda e, n: F.expr(f"sum({e})").alias(n)
    m = r.groupBy(*kn, "__step", "__g").agg(
        s("cast(__g = __p as int)", "n_readings"), s("IF(__g = __p, __k, 0D)", "o0"), s("IF(__g = __p, __k * __k, 0D)", "oq"),
        s("__w", "s0"), s("__w * __d", "s1"), s("__w * __d * __d", "s2"),
        s("__w * __y", "t0"), s("__w * __d * __y", "t1"), s("__w * __w", "q"),
    )
    # lay out the periods that no reading reaches, day by day: no window holds more than a
    # source's day; where the grid goes on over days, a summary of the days tells each
    # one's last period how far the next is
    m = m.withColumn("__day", F.expr("(__g * __step - pmod(__g * __step, 86400)) div 86400"))
    day = [*kn, "__step", "__day"]
    w, all_w = W.partitionBy(*day).orderBy("__g"), W.partitionBy(*day)
    m = m.withColumn("__own", F.expr("IF(oq > 0D, o0 * o0 / oq, 0D)"))
    # one reading has an effective number of 1, more have more; the sums are rounded
    seen = F.when(F.col("__own") > 0.5, F.col("__g"))
    m = m.withColumns({"__next": F.lead("__g").over(w), "__first": F.min(seen).over(all_w), "__last": F.max(seen).over(all_w)})
    if extent == "series":
        days = m.groupBy(*day).agg(F.min("__g").alias("__opens"), F.min(seen).alias("__f"), F.max(seen).alias("__l"))
        along, whole = W.partitionBy(*kn, "__step").orderBy("__day"), W.partitionBy(*kn, "__step")
        days = days.select(*day, F.lead("__opens").over(along).alias("__then"), F.min("__f").over(whole).alias("__f"), F.max("__l").over(whole).alias("__l"))
        m = m.join(days, day).withColumns({"__next": F.coalesce("__next", "__then"), "__first": F.col("__f"), "__last": F.col("__l")})
    m = m.where("__g BETWEEN __first AND __last")
    m = m.withColumn("__e", F.explode(F.sequence(F.col("__g"), F.expr("least(coalesce(__next - 1, __g), __last)"))))
    own = F.col("__e") == F.col("__g")
    det = "(s0 * s2 - s1 * s1)"
    support = F.when(own & (F.col("q") > 0), F.col("s0") * F.col("s0") / F.col("q")).otherwise(F.lit(0.0))
    estimate = F.expr(f"CASE WHEN s0 > 0 AND {det} > 1e-9 * s0 * s0 THEN (t0 * s2 - t1 * s1) / {det} WHEN s0 > 0 THEN t0 / s0 END")
    own_support = F.when(own, F.col("__own")).otherwise(F.lit(0.0))
    n = F.when(own, F.col("n_readings")).otherwise(F.lit(0)).cast("long")
    return m.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)),
        F.col("__step").alias("step_s"),
        (F.col("__e") * F.col("__step")).alias("period_start"),
        n.alias("n_readings"),
        own_support.alias("own_support"),
        (own_support < 0.5).alias("missing"),
        F.when(own & (support >= min_support), estimate).alias("estimate"),
        support.alias("support"),
        (support >= min_support).alias("supported"),
    )
