"""Problem 5: readings that cannot be true, by how their source itself behaves.

Three tests per source: values that no reading of it could take (bounds), short
excursions from its level (phase-space thresholding, then a check against the level on
both sides) and stuck values (runs of zero differences).

What is usual for a source (its median, the scales of its phase space and of its moves,
its number of readings) is taken over all its readings, from counts that are merged over
tasks; a large source is cut into slots of time that only apply it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import materialize

#: Rows of one source that a task takes at once, and readings on either side that it sees too.
ROWS_A_SLOT, MARGIN = 200_000, 256
#: Pieces of equal time in a slot of a source with evenly spread readings; cuts lie between them.
PIECES = 64
#: Readings around one that give its level, and the longest excursion that is a spike.
LEVEL_WINDOW, LONGEST_SPIKE = 7, 3
#: Bins of a doubling by which sizes are counted, bins of a unit of the logarithm for levels.
BINS, LEVEL_BINS = 32, 1024
_ZERO = -(1 << 20)


def counted(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the sizes of numbers, and how many are in each."""
    size = np.abs(a)
    with np.errstate(divide="ignore"):
        b = np.where(size > 0, np.floor(np.log2(size) * BINS), _ZERO).astype(np.int64)
    return np.unique(b, return_counts=True)


def middle(bins: np.ndarray, n: np.ndarray) -> float:
    """The median size from sorted bins and their counts, placed inside its bin by its rank."""
    if not len(bins):
        return 0.0
    total = np.cumsum(n)
    i = int(np.searchsorted(2 * total, total[-1]))
    if bins[i] == _ZERO:
        return 0.0
    return float(2.0 ** ((bins[i] + (total[-1] / 2 - (total[i] - n[i])) / n[i]) / BINS))


@dataclass
class Usual:
    """How a source behaves: readings, non-zero moves, robust scales of the deviation from
    its level, of its first and second difference and of its moves, and two sums that give the
    phase space its slant."""

    n: int = 0
    moves: int = 0
    scale: list[float] = field(default_factory=lambda: [0.0] * 4)
    cross: float = 0.0
    square: float = 0.0


def _central(a: np.ndarray) -> np.ndarray:
    d = np.zeros_like(a)
    if len(a) > 2:
        d[1:-1] = (a[2:] - a[:-2]) / 2
    return d


def _level(x: np.ndarray) -> np.ndarray:
    """Running median, shorter at the ends."""
    h = LEVEL_WINDOW // 2
    padded = np.concatenate([np.full(h, np.nan), x, np.full(h, np.nan)])
    out = np.empty(len(x))
    wide = np.lib.stride_tricks.sliding_window_view(padded, LEVEL_WINDOW)
    out[h : len(x) - h] = np.median(wide[h : len(x) - h], axis=1) if len(x) > 2 * h else 0
    for i in [*range(min(h, len(x))), *range(max(h, len(x) - h), len(x))]:
        out[i] = np.nanmedian(wide[i])
    return out


def phase_space(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviation from the running level, first and second difference."""
    u = y - _level(y)
    d1 = _central(u)
    return u, d1, _central(d1)


def sizes(x: np.ndarray, own: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], float, float]:
    """What the ``own`` ones of these readings add to the counts and sums of their source."""
    if len(x) < LEVEL_WINDOW:
        u = d1 = d2 = np.zeros(len(x))
    else:
        u, d1, d2 = phase_space(x)
    moves = np.diff(x)[own[1:]]
    u, d1, d2 = u[own], d1[own], d2[own]
    return [counted(a) for a in (u, d1, d2, moves[moves != 0])], float(np.dot(u, d2)), float(np.dot(u, u))


def usual(counts: Sequence[tuple[np.ndarray, np.ndarray]], cross: float, square: float) -> Usual:
    """From the counts over a whole source."""
    return Usual(int(counts[0][1].sum()), int(counts[3][1].sum()), [1.4826 * middle(*c) for c in counts], cross, square)


def phase_space_candidates(x: np.ndarray, of: Usual) -> np.ndarray:
    """Readings outside the ellipsoid of (deviation from level, first, second difference).

    The half axes are the source's robust scales times the universal threshold; readings
    found are bridged by interpolation and the test is repeated until it finds none.
    """
    n = len(x)
    found = np.zeros(n, dtype=bool)
    if of.n < LEVEL_WINDOW or n < LEVEL_WINDOW:
        return found
    lam2 = 2 * np.log(of.n)
    a0, a1, a2 = (lam2 * max(s, 1e-12) ** 2 for s in of.scale[:3])
    theta = math.atan2(of.cross, of.square or 1.0)
    c2, s2 = math.cos(theta) ** 2, math.sin(theta) ** 2
    det = c2 * c2 - s2 * s2
    p, q = ((a0 * c2 - a2 * s2) / det, (a2 * c2 - a0 * s2) / det) if abs(det) > 1e-6 else (a0, a2)
    if p <= 0 or q <= 0:
        p, q = a0, a2
    y = x.copy()
    while True:
        u, d1, d2 = phase_space(y)
        along, across = u * math.cos(theta) + d2 * math.sin(theta), d2 * math.cos(theta) - u * math.sin(theta)
        out = (u * u / a0 + d1 * d1 / a1 > 1) | (d1 * d1 / a1 + d2 * d2 / a2 > 1) | (along * along / p + across * across / q > 1)
        out &= ~found
        if not out.any():
            return found
        found |= out
        keep = np.flatnonzero(~found)
        if len(keep) < LEVEL_WINDOW:
            return found
        y = np.interp(np.arange(n), keep, x[keep])


def spikes(x: np.ndarray, threshold: float, of: Usual) -> np.ndarray:
    """Runs of at most three candidates that stand off the readings before and after
    them, to the same side, by more than ``threshold`` usual moves."""
    hit = np.zeros(len(x), dtype=bool)
    if of.moves < 5:
        return hit
    candidate = phase_space_candidates(x, of)
    reach = threshold * of.scale[3]
    while True:
        idx = np.flatnonzero(~hit)
        v, c = x[idx], candidate[idx]
        new = np.zeros(len(v), dtype=bool)
        for m in range(1, LONGEST_SPIKE + 1):
            n = len(v) - m - 1
            if n <= 0:
                break
            before, after = v[:n], v[m + 1 :]
            ups, downs, all_c = np.full(n, np.inf), np.full(n, np.inf), np.ones(n, dtype=bool)
            for k in range(1, m + 1):
                w = v[k : k + n]
                ups = np.minimum(ups, np.minimum(w - before, w - after))
                downs = np.minimum(downs, np.minimum(before - w, after - w))
                all_c &= c[k : k + n]
            start = np.flatnonzero((np.maximum(ups, downs) > reach) & all_c)
            for k in range(1, m + 1):
                new[start + k] = True
        if not new.any():
            return hit
        hit[idx[new]] = True


def stuck(x: np.ndarray, repeats: int) -> np.ndarray:
    """Readings that repeat the one before them in a run of at least ``repeats``."""
    same = np.concatenate([[False], x[1:] == x[:-1], [False]]) if len(x) else np.zeros(1, dtype=bool)
    edge = np.flatnonzero(same[1:] != same[:-1])
    out = np.zeros(len(x), dtype=bool)
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= repeats:
            out[a + 1 : b + 1] = True
    return out


class _Ordered:
    """Readings of one source in order, what of them is usable, and where each belongs."""

    def __init__(self, us: np.ndarray, value: np.ndarray, order: np.ndarray, own: np.ndarray, level: float, factor: float):
        self.by = np.lexsort((order, us))
        t, self.v = us[self.by], value[self.by]
        self.first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=bool)
        self.at = np.cumsum(self.first) - 1  # the time each delivery belongs to; its first delivery stands for it
        with np.errstate(all="ignore"):
            logs = np.where((self.v > 0) & np.isfinite(self.v), np.log(self.v), np.nan)
        self.off = ~np.isfinite(logs) | (np.abs(logs - level) > np.log(factor))
        self.usable = self.first & ~self.off
        self.x, self.own = logs[self.usable], own[self.by][self.usable]

    def faults(self, of: Usual, threshold: float, repeats: int) -> np.ndarray:
        """Fault of each reading as given: 0 none, 1 impossible, 2 spike, 3 stuck."""
        out = np.zeros(len(self.by), dtype=np.int8)
        if not len(out):
            return out
        per_time = np.zeros(int(self.at[-1]) + 1, dtype=np.int8)
        per_time[self.at[self.first][stuck(self.v[self.first], repeats)]] = 3
        per_time[self.at[self.usable][spikes(self.x, threshold, of)]] = 2
        out[self.by] = np.where(self.off, 1, per_time[self.at])
        return out


def source_faults(us: np.ndarray, value: np.ndarray, order: np.ndarray, level: float, threshold: float, repeats: int, factor: float) -> np.ndarray:
    """Fault of each reading of a whole source: 0 none, 1 impossible, 2 spike, 3 stuck."""
    o = _Ordered(us, value, order, np.ones(len(us), dtype=bool), level, factor)
    return o.faults(usual(*sizes(o.x, o.own)), threshold, repeats)


FAULTS = ("impossible", "spike", "stuck")


def _sources(r: DataFrame, kn: Sequence[str]) -> DataFrame:
    """Of each source: its number of readings, its first and last time, and its level, the
    middle of the bin (a thousandth wide) that holds the median of its logarithms."""
    log = "IF(__v > 0 AND __v < double('infinity'), ln(__v), NULL)"
    bins = r.groupBy(*kn, F.expr(f"floor({log} * {LEVEL_BINS})").alias("__b")).agg(F.count(F.lit(1)).alias("__n"), F.min("__us").alias("__lo"), F.max("__us").alias("__hi"))
    good = F.when(F.col("__b").isNotNull(), F.col("__n")).otherwise(F.lit(0))
    w = W.partitionBy(*kn)  # as many rows as a source has bins
    b = bins.withColumns({"__c": F.sum(good).over(w.orderBy(F.col("__b").asc_nulls_first())), "__all": F.sum(good).over(w)})
    level = F.min(F.when((2 * F.col("__c") >= F.col("__all")) & F.col("__b").isNotNull(), (F.col("__b") + 0.5) / LEVEL_BINS))
    return b.groupBy(*kn).agg(F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.coalesce(level, F.lit(0.0)).alias("__level"))


def _slots(r: DataFrame, kn: Sequence[str], rows_a_slot: int) -> DataFrame:
    """``r``, of sources that are too large for a task, with ``__slot`` and ``__own``: cut
    between pieces of time after about ``rows_a_slot`` readings each, a slot with the
    ``MARGIN`` readings on either side that it must see."""
    r = r.withColumn("__piece", F.expr(f"cast(floor((__us - __lo) / greatest(1D, (__hi - __lo + 1D) * {rows_a_slot} / ({PIECES}D * __n))) as bigint)"))
    pieces = r.groupBy(*kn, "__piece").agg(F.count(F.lit(1)).alias("__m"))
    w = W.partitionBy(*kn).orderBy("__piece")  # some PIECES rows for each slot
    pieces = pieces.withColumn("__end", F.sum("__m").over(w)).withColumn("__start", F.col("__end") - F.col("__m"))
    pieces = pieces.withColumn("__own", F.dense_rank().over(W.partitionBy(*kn).orderBy(F.expr(f"__start div {rows_a_slot}"))).cast("long"))
    pieces = materialize(pieces, "pieces")
    slots = pieces.groupBy(*kn, F.col("__own").alias("__slot")).agg(F.min("__start").alias("__from"), F.max("__end").alias("__to"))
    around = 3 + 2 * -(-MARGIN // rows_a_slot)
    seen = pieces.withColumn("__slot", F.explode(F.sequence(F.col("__own") - around, F.col("__own") + around))).join(slots, [*kn, "__slot"])
    seen = seen.where(f"__end > __from - {MARGIN} AND __start < __to + {MARGIN}").groupBy(*kn, "__piece", "__own").agg(F.collect_list("__slot").alias("__slots"))
    # written to a file, so that the planner knows its size and broadcasts it only if it is small
    return r.join(materialize(seen, "slots"), [*kn, "__piece"]).withColumn("__slot", F.explode("__slots")).drop("__slots", "__piece")


def flag_faults(
    readings: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    rank: str,
    threshold: float = 10.0,
    repeats: int = 9,
    factor: float = 2.0,
    rows_a_slot: int = ROWS_A_SLOT,
) -> DataFrame:
    """The faulty readings: keys, ``rank``, ``ts``, ``value`` and ``fault``.

    impossible: not a positive finite number, or more than ``factor`` times off the
    source's median.  spike: at most three readings in a row that stand off those before
    and after them by more than ``threshold`` usual moves (robust scale of the source's
    non-zero moves).  stuck: repeats the reading before it in a run of at least
    ``repeats``.  Deliveries at an equal time count once in runs, the smallest ``rank``
    standing for all; all of them take its fault.  Rows with a null key, time or value
    are no readings; sources with fewer than six usable ones have no spikes; an empty
    table gives an empty result.

    Medians are taken from counts in narrow bins over the whole source, whatever its size.
    A source of more than ``rows_a_slot`` readings is spread over tasks in slots of time;
    its counts are merged first, and each slot applies them.  Only a chain of more than
    ``MARGIN`` suspicious readings without a good one between them could tell its slots apart.
    """
    kn = [f"__k{i}" for i in range(len(keys))]
    r = readings.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keys, kn)), F.unix_micros(ts).alias("__us"), F.col(f"`{value}`").cast("double").alias("__v"), F.col(f"`{rank}`").cast("long").alias("__id"))
    r = r.where(" AND ".join(f"{c} IS NOT NULL" for c in (*kn, "__us", "__v")))
    sources = materialize(_sources(r, kn), "sources")
    keyed = [T.StructField(n, r.schema[n].dataType) for n in kn]
    out = T.StructType([*keyed, T.StructField("__id", T.LongType()), T.StructField("__us", T.LongType()), T.StructField("__v", T.DoubleType()), T.StructField("__f", T.IntegerType())])

    def ordered(t: pa.Table) -> _Ordered:
        order = t["__id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        own = t["__own"].to_numpy() == t["__slot"].to_numpy() if "__own" in t.column_names else np.ones(t.num_rows, dtype=bool)
        return _Ordered(t["__us"].to_numpy(), t["__v"].to_numpy(), order, own, t["__level"][0].as_py(), factor)

    def flagged(t: pa.Table, f: np.ndarray) -> pa.Table:
        if "__own" in t.column_names:
            f = np.where(t["__own"].to_numpy() == t["__slot"].to_numpy(), f, 0)
        hit = np.flatnonzero(f > 0)
        return t.select([*kn, "__id", "__us", "__v"]).take(pa.array(hit)).append_column("__f", pa.array(f[hit].astype(np.int32)))

    def whole(t: pa.Table) -> pa.Table:
        o = ordered(t)
        return flagged(t, o.faults(usual(*sizes(o.x, o.own)), threshold, repeats))

    large = sources.where(F.col("__n") > rows_a_slot)
    found = r.join(sources.where(F.col("__n") <= rows_a_slot).select(*kn, "__level"), kn).groupBy(*kn).applyInArrow(whole, out)
    if not large.isEmpty():
        parts = _slots(r.join(large, kn), kn, rows_a_slot)

        def count(t: pa.Table) -> pa.Table:
            o = ordered(t)
            got, cross, square = sizes(o.x, o.own)
            kind, bins, n = (np.concatenate(x) for x in zip(*((np.full(len(b), i), b, n) for i, (b, n) in enumerate(got))))
            cols = {"__kind": np.append(kind, 4).astype(np.int32), "__bin": np.append(bins, 0), "__c": np.append(n, 0), "__x": np.append(np.zeros(len(n)), cross), "__y": np.append(np.zeros(len(n)), square)}
            return pa.table({**{k: [t[k][0].as_py()] * (len(n) + 1) for k in kn}, **cols}, schema=pa.schema([*(t.schema.field(k) for k in kn), ("__kind", pa.int32()), ("__bin", pa.int64()), ("__c", pa.int64()), ("__x", pa.float64()), ("__y", pa.float64())]))

        counts = T.StructType([*keyed, T.StructField("__kind", T.IntegerType()), T.StructField("__bin", T.LongType()), T.StructField("__c", T.LongType()), T.StructField("__x", T.DoubleType()), T.StructField("__y", T.DoubleType())])
        merged = parts.groupBy(*kn, "__slot").applyInArrow(count, counts).groupBy(*kn, "__kind", "__bin").agg(F.sum("__c").alias("__c"), F.sum("__x").alias("__x"), F.sum("__y").alias("__y"))

        def summed(t: pa.Table) -> pa.Table:
            t = t.sort_by("__bin")
            kind, bins, n = (t[c].to_numpy() for c in ("__kind", "__bin", "__c"))
            of = usual([(bins[kind == i], n[kind == i]) for i in range(4)], float(t["__x"].to_numpy().sum()), float(t["__y"].to_numpy().sum()))
            return pa.table({**{k: t[k].slice(0, 1) for k in kn}, "__usual": [[float(of.n), float(of.moves), *of.scale, of.cross, of.square]]})

        # as many rows of a source as it has bins
        known = materialize(merged.groupBy(*kn).applyInArrow(summed, T.StructType([*keyed, T.StructField("__usual", T.ArrayType(T.DoubleType()))])), "usual")

        def apply(t: pa.Table) -> pa.Table:
            n, moves, a, b, c, d, cross, square = t["__usual"][0].as_py()
            return flagged(t, ordered(t).faults(Usual(int(n), int(moves), [a, b, c, d], cross, square), threshold, repeats))

        found = found.unionAll(parts.join(known, kn).groupBy(*kn, "__slot").applyInArrow(apply, out))
    name = F.element_at(F.array(*(F.lit(f) for f in FAULTS)), F.col("__f"))
    return found.select(*(F.col(n).alias(k) for n, k in zip(kn, keys)), F.col("__id").alias(rank), F.timestamp_micros("__us").alias(ts), F.col("__v").alias(value), name.alias("fault"))
