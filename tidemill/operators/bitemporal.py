"""Problem 1: attributes as they were known at an event's time.

A fact row holds from its valid time on, and is known from its recorded time on.  In
the plane of (valid, recorded) time the rows of one entity are cut into disjoint
rectangles, each owned by the row that is current there; rectangles are indexed by the
cells of a grid, and an event is the point (valid, recorded) that lies in one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.arrow import utc

#: Recorded time without end.
FOREVER = (1 << 63) - 1

#: Cells that recorded time may run behind or ahead of valid time before it is
#: counted as the last such cell; the join's exact bounds decide inside a cell.
_LAG_CELLS = 2


def staircase(valid: np.ndarray, recorded: np.ndarray, owned: np.ndarray, horizon: int) -> tuple[np.ndarray, ...]:
    """Rectangles (row, valid from, valid to, recorded from, recorded to), ends excluded.

    Rows must be sorted by (valid, recorded, rank), the winner last.  A row loses its
    region wherever a later row of that order is valid and recorded too, so its upper
    recorded bound falls along the chain of next smaller recorded times.
    """
    n = len(valid)
    v, r = valid.tolist(), recorded.tolist()
    smaller = [n] * n  # next row in order that was recorded earlier
    stack: list[int] = []
    for i in range(n - 1, -1, -1):
        while stack and r[stack[-1]] >= r[i]:
            stack.pop()
        smaller[i] = stack[-1] if stack else n
        stack.append(i)
    out: list[tuple[int, int, int, int, int]] = []
    for i in np.flatnonzero(owned).tolist():
        end, low, high, j = v[i] + horizon + 1, v[i], FOREVER, i + 1
        while low < end and high > r[i]:
            stop = min(v[j], end) if j < n else end
            if stop > low:
                out.append((i, low, stop, r[i], high))
                low = stop
            if j >= n:
                break
            high = r[j]
            j = smaller[j]
    cols = np.array(out, dtype=np.int64).reshape(-1, 5)
    return tuple(cols[:, k] for k in range(5))


def rectangles(facts: DataFrame, keys: Sequence[str], valid: str, recorded: str, rank: str, horizon_us: int) -> DataFrame:
    """Disjoint current-version rectangles of ``facts``.

    Adds v_from, v_to, r_from, r_to (microseconds, ends excluded) to the columns of
    ``facts``; a row whose region has k pieces comes out k times, one that is never
    current not at all.  Among equal (valid, recorded) the smallest ``rank`` wins; of
    exact copies in all three one is kept.  Rows with a null key, valid or recorded
    time are never current.

    Only rows within ``horizon_us`` after a row can limit it, so entities are split
    into slots of valid time and each row is also sent to the slot before its own:
    a task holds one slot of an entity, never an entity.
    """
    slot = 3 * (horizon_us + 1)
    f = facts
    for c in (*keys, valid, recorded):
        f = f.where(F.col(f"`{c}`").isNotNull())
    f = f.withColumns({"__v": F.unix_micros(valid), "__r": F.unix_micros(recorded)})
    own = F.expr(f"__v div {slot} - IF(__v % {slot} < 0, 1, 0)")
    before = F.expr(f"(__v - {horizon_us + 1}) div {slot} - IF((__v - {horizon_us + 1}) % {slot} < 0, 1, 0)")
    f = f.withColumns({"__own": own, "__slot": F.explode(F.array_distinct(F.array(own, before)))})
    names = facts.columns
    schema = T.StructType([*facts.schema.fields, *(T.StructField(c, T.LongType()) for c in ("v_from", "v_to", "r_from", "r_to"))])

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by([("__v", "ascending"), ("__r", "ascending"), (rank, "descending")])
        owned = t["__own"].to_numpy() == t["__slot"].to_numpy()
        i, v0, v1, r0, r1 = staircase(t["__v"].to_numpy(), t["__r"].to_numpy(), owned, horizon_us)
        kept = t.select(names).take(pa.array(i))
        cols = [*(utc(c) for c in kept.columns), *(pa.array(c) for c in (v0, v1, r0, r1))]
        return pa.Table.from_arrays(cols, [*names, "v_from", "v_to", "r_from", "r_to"])

    return f.groupBy(*(f"`{k}`" for k in keys), "__slot").applyInArrow(cut, schema)


def _cells(col: str, width: int) -> str:
    return f"({col} div {width} - IF({col} % {width} < 0, 1, 0))"


def attributes_as_known(
    events: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    event_valid: str,
    event_recorded: str,
    valid: str,
    recorded: str,
    rank: str,
    carry: Sequence[str],
    horizon_us: int,
    how: str = "inner",
    prefix: str = "known_",
) -> DataFrame:
    """Each event with the ``carry`` columns of the fact row current at its point.

    The row is the one of the event's ``keys`` with the latest ``valid`` (at most
    ``horizon_us`` old), then the latest ``recorded``, then the smallest ``rank``, among
    those valid and recorded not after the event's two times.  Every event row counts for
    itself; ``how="left"`` also keeps events without such a row or with a null time or
    key (carried columns null), ``"inner"`` drops them.  Carried columns are prefixed, so
    clashing names stay apart.  Empty inputs give an empty result or null columns.
    """
    g = max(1, horizon_us // 4)
    used = list(dict.fromkeys([*keys, valid, recorded, rank, *carry]))
    rect = rectangles(facts.select(*(f"`{c}`" for c in used)), keys, valid, recorded, rank, horizon_us)
    span = F.sequence(F.expr(_cells("v_from", g)), F.expr(_cells("(v_to - 1)", g)))
    rect = rect.withColumn("__vc", F.explode(span))
    clamp = lambda c: F.expr(f"greatest(__vc - {_LAG_CELLS}, least(__vc + {_LAG_CELLS}, {c}))")
    rect = rect.withColumn("__rc", F.explode(F.sequence(clamp(_cells("r_from", g)), clamp(_cells("(r_to - 1)", g)))))
    rect = rect.select(
        *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)),
        *(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carry)),
        "v_from", "v_to", "r_from", "r_to", "__vc", "__rc",
    )
    p = events.withColumns({"__pv": F.unix_micros(event_valid), "__pr": F.unix_micros(event_recorded)})
    p = p.withColumn("__pvc", F.expr(_cells("__pv", g)))
    p = p.withColumn("__prc", F.expr(f"greatest(__pvc - {_LAG_CELLS}, least(__pvc + {_LAG_CELLS}, {_cells('__pr', g)}))"))
    on = (F.col("__pvc") == F.col("__vc")) & (F.col("__prc") == F.col("__rc"))
    for i, k in enumerate(keys):
        on = on & (F.col(f"`{k}`") == F.col(f"__k{i}"))
    on = on & F.expr("__pv >= v_from AND __pv < v_to AND __pr >= r_from AND __pr < r_to")
    return p.join(rect, on, how).select(
        *(F.col(f"`{c}`") for c in events.columns),
        *(F.col(f"__c{i}").alias(prefix + c) for i, c in enumerate(carry)),
    )
