"""Running an ordered Python body over independent segments.

State is reset at every gap, so a segment is the unit of work: segments spread over the
cluster and no state crosses them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.arrow import utc
from tidemill.session import materialize


def panel_segments(rows: DataFrame, keys: Sequence[str], at: str, column: str, names: Sequence[str], value: str) -> DataFrame:
    """Instants of each key at which all names have a value: keys, ``t``, ``xs`` (array in the
    order of names) and ``segment_id`` (runs of instants exactly one apart)."""
    picks = [F.max(F.when(F.col(column) == n, F.col(value))) for n in names]
    p = rows.where(F.col(column).isin(list(names))).groupBy(*keys, F.col(at).alias("t")).agg(F.array(*picks).alias("xs"))
    p = p.where(~F.exists("xs", lambda x: x.isNull()))
    w = W.partitionBy(*keys).orderBy("t")
    new = F.coalesce(F.col("t") - F.lag("t").over(w) != 1, F.lit(True)).cast("long")
    return p.withColumn("__new", new).withColumn("segment_id", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("__new")


def per_segment(rows: DataFrame, keys: Sequence[str], body: Callable[[np.ndarray, np.ndarray], dict[str, list]], columns: dict[str, T.DataType]) -> DataFrame:
    """Apply ``body(t, xs)`` to each segment of :func:`panel_segments`.

    It returns columns of equal length, the first of them ``t``; the keys and the segment
    are put before them.
    """
    group = [*keys, "segment_id"]
    schema = T.StructType([*(rows.schema[g] for g in group), *(T.StructField(n, k) for n, k in columns.items())])
    kinds = {f.name: f.dataType for f in schema.fields}
    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.ArrayType(T.DoubleType()): pa.list_(pa.float64())}
    types = {n: arrow[k] for n, k in kinds.items()}
    names = list(columns)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        xs = np.array(t["xs"].to_pylist(), dtype=np.float64)
        out = body(t["t"].to_numpy(), xs)
        n = len(out[names[0]])
        cols = [pa.array([k.as_py()] * n, types[g]) for k, g in zip(key, group)] + [pa.array(out[c], types[c]) for c in names]
        return pa.Table.from_arrays(cols, [*group, *names])

    return rows.groupBy(*group).applyInArrow(run, schema)


def ordered_scan(rows: DataFrame, spread: Sequence[str], order: Sequence[str], step: Callable[[object, pa.RecordBatch], tuple[object, dict[str, pa.Array]]], added: dict[str, T.DataType]) -> DataFrame:
    """Pass over each partition in order with a small state, adding columns.

    Rows are spread by the columns ``spread`` and sorted by ``order``; ``step(state, batch)``
    gives the state after a batch and the added columns.  It must start anew wherever a
    row says so (a flag computed beforehand), for a partition holds many groups one after
    another.  No group is ever held as a whole, whatever its length.
    """
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                state, cols = step(state, b)
                yield pa.RecordBatch.from_arrays([*(utc(c) for c in b.columns), *(cols[n] for n in added)], [*names, *added])

    return rows.repartition(*spread).sortWithinPartitions(*order).mapInArrow(run, schema)


def numbered(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds each row's number (from 1) in the order of the columns over the whole table, nulls
    last.

    The table is sorted in ranges, so no task holds more than a part of it: the rows of
    each part are counted, and a part's numbers begin after those of the parts before it.
    The sorted rows are written first, so that both passes see the same parts.
    """
    by = [F.col(f"`{c}`").asc_nulls_last() for c in order]
    kept = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    sizes = {r["__part"]: r["count"] for r in kept.groupBy("__part").count().collect()}  # a row a part
    starts, before = {}, 0
    for part in sorted(sizes):
        starts[part] = before
        before += sizes[part]
    # ids rise by one inside a part, from the part's number times 2^33
    start = F.create_map(*(F.lit(v) for p, n in starts.items() for v in (p, n))) if starts else F.create_map(F.lit(0), F.lit(0))
    return kept.withColumn(out, (start[F.col("__part")] + F.col("__at") % F.lit(1 << 33) + 1).cast("long")).drop("__part", "__at")


GENESIS = "0" * 64


def hash_chain(rows: DataFrame, keys: Sequence[str], order: str, digest: str) -> DataFrame:
    """Adds ``prev`` and ``link``: link = SHA-256(prev ‖ digest) in hex, prev the link of the row
    before it in its chain (the keys), zeros at the first.

    A link needs the one before it, so a chain is one pass in order of ``order``, which must
    be unique in it; its whole state is the last link.
    """
    first = F.row_number().over(W.partitionBy(*keys).orderBy(order)) == 1

    def step(last: object, b: pa.RecordBatch) -> tuple[object, dict[str, pa.Array]]:
        prev, link = [], []
        for h, new in zip(b["__h"].to_pylist(), b["__first"].to_pylist()):
            prev.append(GENESIS if new else last)
            last = hashlib.sha256((prev[-1] + h).encode()).hexdigest()
            link.append(last)
        return last, {"prev": pa.array(prev, pa.string()), "link": pa.array(link, pa.string())}

    r = rows.withColumns({"__h": F.coalesce(F.col(digest), F.lit("")), "__first": first})
    return ordered_scan(r, keys, [*keys, order], step, {"prev": T.StringType(), "link": T.StringType()}).drop("__h", "__first")


def check_chain(rows: DataFrame, keys: Sequence[str], order: str, digest: str) -> DataFrame:
    """Adds ``bound`` (the row's link follows from its own prev and digest) and ``joined`` (its
    prev is the link of the row before it, or zeros at the first).

    Every row is checked against stored values only, so unlike building a chain this needs no
    order between tasks.
    """
    before = F.lag("link", 1, GENESIS).over(W.partitionBy(*keys).orderBy(order))
    own = F.sha2(F.concat(F.col("prev"), F.coalesce(F.col(digest), F.lit(""))), 256)
    return rows.withColumns({"bound": own.eqNullSafe(F.col("link")), "joined": F.col("prev").eqNullSafe(before)})


def standardised(xs: np.ndarray, half_life: float = 1440.0, start: float = 1e-8, most: float = 5.0) -> np.ndarray:
    """Returns over the volatility known before them, clipped; row 0 has none.

    The variance is a recursive average from ``start``: row i is divided by the state
    after row i - 1 and then enters it.
    """
    a = 1.0 - 2.0 ** (-1.0 / half_life)
    r = np.diff(xs, axis=0)
    z, var = np.empty_like(r), np.full(xs.shape[1], start)
    for i, x in enumerate(r):
        var = (1 - a) * var + a * x * x
        z[i] = x / np.sqrt(np.maximum(var, 1e-16))
    return np.clip(z, -most, most)
