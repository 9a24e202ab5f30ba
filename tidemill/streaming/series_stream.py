"""Streaming forms of ordered operators: rollups with a watermark and a resumable replay."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_rollup(stream: DataFrame, keys: Sequence[str], ts: str, value: str, delay: str) -> DataFrame:
    """Count, mean, least and largest value of each key and UTC day, emitted once the
    watermark has passed the day; rows later than ``delay`` are dropped."""
    s = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, "1 day").alias("w"))
    a = s.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return a.select(*keys, F.to_date("w.start").alias("day"), "n", "mean", "low", "high")


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, delay: str) -> DataFrame:
    """Runs of rows less than ``gap`` apart: first time, end and count of each."""
    s = stream.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_STATE = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("v", T.DoubleType())])


def replay_rows(k: np.ndarray, x: np.ndarray, x_eq: np.ndarray, kappa: np.ndarray, gamma: np.ndarray, step: float, state: tuple[int, float, float] | None) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """Forecast of each row in order of ``k``, whether it was reset, and the state after it.

    A row that does not follow its predecessor by one resets to the observation at rest;
    others take one semi-implicit step from the state under their own parameters.
    """
    last, px, pv = state or (-(1 << 62), 0.0, 0.0)
    out, reset = np.empty(len(k)), np.zeros(len(k), dtype=bool)
    for i in range(len(k)):
        if k[i] != last + 1:
            px, pv, reset[i] = float(x[i]), 0.0, True
        else:
            pv = (pv - step * max(float(kappa[i]), 0.0) * (px - float(x_eq[i]))) / (1.0 + step * float(gamma[i]))
            px = px + step * pv
        out[i], last = px, int(k[i])
    return out, reset, (last, px, pv)


def replay_stream(stream: DataFrame, keys: Sequence[str], step: float) -> DataFrame:
    """Resumable replay: columns k, x, x_eq, kappa, gamma arrive in order of k per key.

    The state of a key is its last row's number, position and speed; Spark's checkpoint
    keeps it, so a restarted query goes on as if it had never stopped.
    """
    kn = list(keys)
    out = T.StructType([*(stream.schema[c] for c in kn), T.StructField("k", T.LongType()), T.StructField("forecast", T.DoubleType()), T.StructField("was_reset", T.BooleanType())])

    def advance(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values("k", kind="stable")  # one micro-batch of one key
        got, reset, after = replay_rows(*(rows[c].to_numpy() for c in ("k", "x", "x_eq", "kappa", "gamma")), step, tuple(state.get) if state.exists else None)
        state.update(after)
        yield pd.DataFrame({c: [v] * len(rows) for c, v in zip(kn, key)} | {"k": rows["k"].to_numpy(), "forecast": got, "was_reset": reset})

    return stream.groupBy(*kn).applyInPandasWithState(advance, out, _STATE, "append", GroupStateTimeout.NoTimeout)
