"""Ordered and numeric models over segments of synchronous panels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import dynamics as D
from tidemill.operators import factors as X
from tidemill.operators import filters as Q
from tidemill.operators import joins as J
from tidemill.operators import series as S
from tidemill.operators.sequential import numbered, ordered_scan, panel_segments, per_segment, standardised
from tidemill.plans.base import GRID, KEYS, WEEK_US, Registry, grid, rd
from tidemill.plans.join_queries import SYMBOLS
from tidemill.plans.scoring_queries import _SPLIT as SPLIT
from tidemill.plans.scoring_queries import _parts
from tidemill.session import table

query = Registry()

L, N, B, V = T.LongType(), T.DoubleType(), T.BooleanType(), T.ArrayType(T.DoubleType())
#: A fixed weak coupling between neighbours, per second squared.
SEED, DT = 20260718, 60.0
THREE = SYMBOLS[:3]
#: Bond dimension, landmarks, samples of the coupling's window and replicates, as in the reference.
CHI, LANDMARKS, WINDOW, REPLICATES = 16, 64, 28_800, 2_000


def coupling(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.where(np.abs(i[:, None] - i[None, :]) == 1, 1e-5 * (1 + 0.1 * (i[:, None] - i[None, :])), 0.0)


#: Panels are told apart by the length of their bars; t counts bars, so this is seconds.
PANEL = ["bar_seconds"]
SECONDS = "t * bar_seconds"


def native(bars: DataFrame) -> DataFrame:
    """bar_seconds, symbol, k, x: one series a symbol and length of bar, at every bar of the
    grid; the median over the feeds whose bars have that length."""
    return bars.groupBy(F.col("step").alias("bar_seconds"), "symbol", "k").agg(F.median("x").alias("x"))


def segments(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Synchronous panels of the symbols, one for each length of bar, in segments."""
    return panel_segments(native(grid(spark, d)), PANEL, "k", "symbol", names, "x")


@query()
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each series' grid: name, then its times and its closes, in order.

    Each column of a series passes in order through one hash, which is all that is kept.
    """
    g = grid(spark, d).select(*KEYS, "k", (F.col("k") * F.col("step")).alias("t"), "close").withColumn("c", F.explode(F.array(F.lit(0), F.lit(1))))
    w = W.partitionBy(*KEYS).orderBy("c", "k")
    g = g.withColumns({"i": F.row_number().over(w), "last": F.lead("k").over(w).isNull()})

    def step(h, b: pa.RecordBatch):
        first, last, c = (b[n].to_numpy(zero_copy_only=False) for n in ("i", "last", "c"))
        t, close = b["t"].to_numpy().astype("<i8"), b["close"].to_numpy().astype("<f8")
        cuts = np.flatnonzero(np.concatenate([[True], (first[1:] == 1) | (c[1:] != c[:-1])]))
        out = [None] * len(c)
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(c)]):
            if first[i] == 1:
                h = hashlib.sha256("|".join(b[k][i].as_py() for k in KEYS).encode())
            h.update((close if c[i] else t)[i:j].tobytes())
            if last[j - 1]:
                out[j - 1] = h.hexdigest()
        return h, {"sha256": pa.array(out, pa.string())}

    done = ordered_scan(g, KEYS, [*KEYS, "c", "k"], step, {"sha256": T.StringType()}).where("last")
    return done.select(*KEYS, "sha256", (F.col("i") / 2).cast("long").alias("n"))


@query()
def lindblad_filter(spark: SparkSession, d: str) -> DataFrame:
    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        p, purity, worst = Q.lindblad(standardised(xs), coupling(xs.shape[1]), DT)
        return {"t": t[1:], "p": p.tolist(), "purity": purity, "invariant_error": np.full(len(p), worst)}

    return per_segment(segments(spark, d, THREE), PANEL, body, {"t": L, "p": V, "purity": N, "invariant_error": N})


@query()
def trajectory_filter(spark: SparkSession, d: str) -> DataFrame:
    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        p, jumps = Q.trajectories(standardised(xs), coupling(xs.shape[1]), DT, 96, SEED + int(t[0]))
        return {"t": t[1:], "p": p.tolist(), "jumps": jumps}

    return per_segment(segments(spark, d, THREE), PANEL, body, {"t": L, "p": V, "jumps": L})


@query()
def tensor_chain_filter(spark: SparkSession, d: str) -> DataFrame:
    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        a, lost = Q.tensor_chain(standardised(xs), coupling(xs.shape[1]), DT, CHI, SEED + int(t[0]))
        return {"t": t[1:], "activity": a.tolist(), "lost_weight": lost}

    return per_segment(segments(spark, d, SYMBOLS), PANEL, body, {"t": L, "activity": V, "lost_weight": N})


@query()
def reservoir_features(spark: SparkSession, d: str) -> DataFrame:
    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        return {"t": t[1:], "observables": Q.reservoir(standardised(xs), SEED).tolist()}

    return per_segment(segments(spark, d, SYMBOLS), PANEL, body, {"t": L, "observables": V})


def _next_largest(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """t, z (array), y: the symbol with the largest absolute next return in the segment."""

    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        z, y = standardised(xs)[:-1], np.abs(np.diff(xs, axis=0)[1:]).argmax(axis=1)
        return {"t": t[1:-1], "z": z.tolist(), "y": y} if len(xs) > 2 else {"t": [], "z": [], "y": []}

    return per_segment(segments(spark, d, names), PANEL, body, {"t": L, "z": V, "y": L})


def moments(rows: DataFrame, m: int, c: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Of rows x (array of m), y (class): sums of x xᵀ and of x by class; None without rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, xx, xy = 0, np.zeros((m, m)), np.zeros((m, c))
        for t in batches:
            x = t["x"].flatten().to_numpy().reshape(-1, m)
            n, xx, xy = n + len(x), xx + x.T @ x, xy + x.T @ np.eye(c)[t["y"].to_numpy()]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[*xx.ravel(), *xy.ravel()]], pa.list_(pa.float64()))], ["v"])

    sums = rows.mapInArrow(part, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # m * (m + c) rows
    v = np.array([r["v"] for r in sorted(sums, key=lambda r: r["pos"])])
    return (v[: m * m].reshape(m, m), v[m * m :].reshape(m, c)) if len(v) else None


@query()
def reservoir_readout(spark: SparkSession, d: str) -> DataFrame:
    """Ridge readout of the observables: moments summed by Spark, a small solve, scores.

    The first seven tenths of the time train, the rest is scored.
    """
    obs = reservoir_features(spark, d).join(_next_largest(spark, d, SYMBOLS).select(*PANEL, "t", "y"), [*PANEL, "t"])
    obs = obs.withColumn("s", F.expr(SECONDS))
    b = obs.agg((F.min("s") + F.expr("(max(s) - min(s)) * 7 div 10")).alias("split")).first()["split"]
    if b is None:
        return spark.createDataFrame([], "n long, accuracy double, brier double")
    k, c = 2 * len(SYMBOLS) + 2, len(SYMBOLS)
    x = F.concat(F.array(F.lit(1.0)), "observables")
    sums = moments(obs.where(F.col("s") < b).select(x.alias("x"), "y"), k, c)
    if sums is None:
        return spark.createDataFrame([], "n long, accuracy double, brier double")
    penalty = 5.0 * np.eye(k)
    penalty[0, 0] = 0.0
    w = np.linalg.solve(sums[0] + penalty, sums[1])
    dot = lambda j: F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in w[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = obs.where(F.col("s") >= b).withColumn("e", F.transform(F.array(*(dot(j) for j in range(c))), lambda v: F.exp(v)))
    p = F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    scored = scored.withColumn("p", p)
    brier = F.aggregate(F.transform("p", lambda v, i: F.pow(v - (i == F.col("y")).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.array_position("p", F.array_max("p")) - 1 == F.col("y")).cast("double")).alias("accuracy"), F.avg(brier).alias("brier"))


@query()
def kernel_features(spark: SparkSession, d: str) -> DataFrame:
    """Fidelity kernel of every row against 64 landmarks, in Nyström form.

    The landmarks are placed evenly over the first seven tenths of the time, which train:
    what is scored has no part in the features.
    """
    rows = _next_largest(spark, d, SYMBOLS).withColumn("s", F.expr(SECONDS))
    span = rows.agg(F.min("s").alias("a"), F.max("s").alias("b")).first()
    if span["a"] is None:
        return spark.createDataFrame([], "bar_seconds long, t long, y long, phi array<double>")
    train = (span["b"] - span["a"]) * 7 // 10
    part = F.expr(f"(s - {span['a']}) * {LANDMARKS} div {max(train, 1)}")
    marks = rows.where(F.col("s") < span["a"] + max(train, 1)).groupBy(part.alias("part")).agg(F.min_by("z", F.struct("s", *PANEL)).alias("z")).orderBy("part")  # at most LANDMARKS rows
    n = len(SYMBOLS)
    encoded = lambda zs: np.array([Q.encode(np.array(v), coupling(n), DT) for v in zs]).reshape(-1, 1 << n)
    shared = spark.sparkContext.broadcast(encoded([r["z"] for r in marks.collect()]))

    def features(batches):
        m = shared.value
        own = Q.fidelity(m, m)
        for t in batches:
            z = t["z"].to_pylist()
            # 1,024 amplitudes a row: 500 rows at once
            phi = np.concatenate([Q.nystroem(Q.fidelity(encoded(z[i : i + 500]), m), own) for i in range(0, max(len(z), 1), 500)])
            yield pa.RecordBatch.from_arrays([t["bar_seconds"], t["t"], t["y"], pa.array(phi.tolist(), pa.list_(pa.float64()))], ["bar_seconds", "t", "y", "phi"])

    return rows.select(*PANEL, "t", "y", "z").mapInArrow(features, "bar_seconds long, t long, y long, phi array<double>")


@query()
def channel_tomography(spark: SparkSession, d: str) -> DataFrame:
    """Positivity, trace preservation and radius of the channel at every row."""

    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        z, at = standardised(xs), t[1:]
        c = [Q.channel_checks(Q.kraus(v, coupling(xs.shape[1]), DT)) for v in z]
        return {"t": at} | {k: [x[k] for x in c] for k in ("min_eigenvalue", "trace_error", "radius")}

    return per_segment(segments(spark, d, THREE), PANEL, body, {"t": L, "min_eigenvalue": N, "trace_error": N, "radius": N})


@query("""WITH c AS (SELECT label, [CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END, CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END] AS bits, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT label, sum(n)::BIGINT AS shots, round(sum(n * (1 - 2 * bits[1])) / sum(n)::DOUBLE, 9) + 0.0 AS z0, round(sum(n * (1 - 2 * bits[2])) / sum(n)::DOUBLE, 9) + 0.0 AS z1, round(sum(n * (1 - 2 * bits[1]) * (1 - 2 * bits[2])) / sum(n)::DOUBLE, 9) + 0.0 AS zz FROM c GROUP BY label""")
def counts_to_observables(spark: SparkSession, d: str) -> DataFrame:
    """Expectations from counts of bit strings: Σ count (1 - 2 bit) / Σ count."""
    bit = lambda i: F.when(F.col("embedding")[i] > 0, 1).otherwise(0).alias(f"b{i}")
    c = table(spark, d, "embeddings").select("label", bit(0), bit(1)).groupBy("label", "b0", "b1").agg(F.count(F.lit(1)).alias("n"))
    z0, z1, n = 1 - 2 * F.col("b0"), 1 - 2 * F.col("b1"), F.col("n")
    mean = lambda e, a: (F.round(F.sum(n * e) / F.sum(n), 9) + F.lit(0.0)).alias(a)
    return c.groupBy("label").agg(F.sum(n).alias("shots"), mean(z0, "z0"), mean(z1, "z1"), mean(z0 * z1, "zz"))


def _configurations(spark: SparkSession, d: str) -> DataFrame:
    """One row a series and parameter time with finite curvature and damping."""
    p = table(spark, d, "dynamics_params").where("kappa IS NOT NULL AND gamma IS NOT NULL")
    return p.groupBy(*KEYS, "timestamp").agg(F.max_by(F.struct("param_id", "kappa", "gamma", "x_eq"), F.struct("recorded_at", -F.col("param_id"))).alias("p")).select(*KEYS, "timestamp", "p.*")


@query()
def stability_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Raw and guarded stability of every parameter row taken as a pair of like oscillators."""

    def rate(batches):
        for t in batches:
            out = []
            for k, g in zip(t["kappa"].to_numpy(), t["gamma"].to_numpy()):
                c = coupling(2)
                raw, ok = D.stability(np.array([k, k]), np.array([g, g]), c, DT), D.stability(np.maximum([k, k], 0.0), np.array([g, g]), c, DT)
                out.append((raw["radius"], ok["radius"], ok["norm"], ok["growth"], ok["distance"], bool(ok["radius"] <= D.RADIUS_LIMIT and ok["growth"] <= D.GROWTH_LIMIT)))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([t["param_id"], *(pa.array(list(c), pa.float64()) for c in cols[:5]), pa.array(list(cols[5]), pa.bool_())], ["param_id", "radius_raw", "radius", "norm", "growth", "distance", "stable"])

    return _configurations(spark, d).select("param_id", "kappa", "gamma").mapInArrow(rate, "param_id long, radius_raw double, radius double, norm double, growth double, distance double, stable boolean")


@query()
def step_size_stability(spark: SparkSession, d: str) -> DataFrame:
    """Stable stretches over sampled step sizes, at each series' last parameters."""
    last = _configurations(spark, d).groupBy(*KEYS).agg(F.max_by(F.struct("kappa", "gamma"), "timestamp").alias("p")).select(*KEYS, "p.*")

    def rate(batches):
        for t in batches:
            got = [D.stable_steps(np.maximum([k, k], 0.0), np.array([g, g]), coupling(2)) for k, g in zip(t["kappa"].to_numpy(), t["gamma"].to_numpy())]
            yield pa.RecordBatch.from_arrays([t["feed_id"], t["symbol"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], ["feed_id", "symbol", "stretches", "largest_s"])

    return last.mapInArrow(rate, "feed_id string, symbol string, stretches long, largest_s double")


@query()
def replay(spark: SparkSession, d: str) -> DataFrame:
    """Replay of every segment of every series under the parameters then in force."""
    g = grid(spark, d)
    w = W.partitionBy(*KEYS).orderBy("k")
    g = g.withColumn("__new", F.coalesce(F.col("k") - F.lag("k").over(w) != 1, F.lit(True)).cast("long"))
    g = g.withColumn("segment_id", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    g = g.select(*KEYS, "segment_id", "step", "k", "x", ((F.col("k") + 1) * F.col("step") * 1_000_000).alias("us"))
    p = _configurations(spark, d).where("x_eq IS NOT NULL").select(*KEYS, F.unix_micros("timestamp").alias("t"), "kappa", "gamma", "x_eq")
    rows = J.asof(g, p, KEYS, "us", "t", ["kappa", "gamma", "x_eq"], slot=WEEK_US).where("kappa IS NOT NULL")
    # a segment starts anew at its first row with parameters
    first = F.row_number().over(W.partitionBy(*KEYS, "segment_id").orderBy("k")) == 1
    rows = rows.select(*KEYS, "segment_id", "step", "k", "x", "kappa", "gamma", "x_eq", first.alias("first"))

    def advance(state, b: pa.RecordBatch):
        cols = [b[c].to_numpy(zero_copy_only=False) for c in ("x", "x_eq", "kappa", "gamma", "step", "first")]
        state = state or D.Replayer(1)
        out, held = np.empty(b.num_rows), np.empty(b.num_rows, dtype=bool)
        for i, (x, q, k, g, dt, anew) in enumerate(zip(*cols)):
            y, held[i] = state.row(np.array([x]), np.array([q]), np.array([k]), np.array([g]), None, float(dt), bool(anew))
            out[i] = y[0]
        return state, {"forecast": pa.array(out), "held": pa.array(held)}

    done = ordered_scan(rows, [*KEYS, "segment_id"], [*KEYS, "segment_id", "k"], advance, {"forecast": N, "held": B})
    return done.select(*KEYS, "segment_id", "k", "forecast", (F.col("forecast") - F.col("x")).alias("error"), "held")


def trailing_ridge(pairs: DataFrame, n: int, window: int) -> DataFrame:
    """Of rows bar_seconds, t, z, y (arrays of n): at each day's last row the ridge matrix ``c`` of
    the last ``window`` rows of its panel, row by row, with their number and the condition."""
    day = F.expr(f"{SECONDS} div 86400")
    rows = pairs.select(*PANEL, "t", "z", "y", day.alias("day"))
    last = F.coalesce(F.lead("day").over(W.partitionBy(*PANEL).orderBy("t")) != F.col("day"), F.lit(True))
    kinds = {"n": L, "c": V, "condition": N}

    def advance(state, b: pa.RecordBatch):
        panel, flags = b["bar_seconds"].to_numpy(), b["last"].to_numpy(zero_copy_only=False)
        zy = np.hstack([b[c].flatten().to_numpy().reshape(-1, n) for c in ("z", "y")])
        out: dict[str, list] = {k: [None] * b.num_rows for k in kinds}
        at = 0
        for end in sorted({*(np.flatnonzero(flags) + 1).tolist(), b.num_rows}):
            if state is None or state[0] != panel[at]:
                state = panel[at], np.zeros((0, 2 * n))
            state = state[0], np.concatenate([state[1], zy[at:end]])[-window:]
            if flags[end - 1]:
                z, y = state[1][:, :n], state[1][:, n:]
                c, cond = D.ridge_matrix(y.T @ z, z.T @ z)
                out["n"][end - 1], out["c"][end - 1], out["condition"][end - 1] = len(z), c.ravel().tolist(), cond
            at = end
        return state, {"n": pa.array(out["n"], pa.int64()), "c": pa.array(out["c"], pa.list_(pa.float64())), "condition": pa.array(out["condition"], pa.float64())}

    return ordered_scan(rows.withColumn("last", last), PANEL, [*PANEL, "t"], advance, kinds).where("last").select(*PANEL, "day", *kinds)


def return_pairs(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """bar_seconds, segment_id, t, z, y: each return of the panel's symbols and the next one."""

    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        r = np.diff(xs, axis=0)
        return {"t": t[2:], "z": r[:-1].tolist(), "y": r[1:].tolist()}

    return per_segment(segments(spark, d, names), PANEL, body, {"t": L, "z": V, "y": V})


def coupled_replay(rows: DataFrame, n: int) -> DataFrame:
    """Rows bar_seconds, segment_id, t with arrays xs, x_eq, kappa, gamma of ``n`` and c of n²
    (null: no coupling), which are replayed together segment by segment."""
    first = F.row_number().over(W.partitionBy(*PANEL, "segment_id").orderBy("t")) == 1

    def advance(state, b: pa.RecordBatch):
        state = state or D.Replayer(n)
        xs, q, k, g = (b[c].flatten().to_numpy().reshape(-1, n) for c in ("xs", "x_eq", "kappa", "gamma"))
        out, held = np.empty(xs.shape), np.empty(len(xs), dtype=bool)
        last, matrix = None, None
        for i, (c, dt, anew) in enumerate(zip(b["c"], b["bar_seconds"].to_pylist(), b["first"].to_pylist())):
            c = c.as_py()
            if c != last or matrix is None:  # a matrix is in force for a day
                last, matrix = c, np.zeros((n, n)) if c is None else np.array(c).reshape(n, n)
            out[i], held[i] = state.row(xs[i], q[i], k[i], g[i], matrix, float(dt), bool(anew))
        return state, {"forecast": pa.array(out.tolist(), pa.list_(pa.float64())), "held": pa.array(held)}

    keep = [*PANEL, "segment_id", "t", "xs", "x_eq", "kappa", "gamma", "c", first.alias("first")]
    return ordered_scan(rows.select(*keep), [*PANEL, "segment_id"], [*PANEL, "segment_id", "t"], advance, {"forecast": V, "held": B})


def _updates(spark: SparkSession, d: str) -> tuple[list[DataFrame], DataFrame]:
    """Of each panel and each of three symbols the parameters by time (of feeds with equal bars
    the row that was recorded last), and the accepted coupling matrices in 1/s²: the ridge
    matrix of the last 28,800 samples, from the end of its day on."""
    own = table(spark, d, "dynamics_params").join(table(spark, d, "series").select(*KEYS, F.col("bar_seconds").cast("long").alias("bar_seconds")), KEYS)
    own = own.where("kappa IS NOT NULL AND gamma IS NOT NULL AND x_eq IS NOT NULL")
    p = []
    for i, s in enumerate(THREE):
        one = own.where(F.col("symbol") == s).groupBy(*PANEL, F.unix_micros("timestamp").alias("at"))
        p.append(one.agg(F.max_by(F.struct("kappa", "gamma", "x_eq"), F.struct("recorded_at", -F.col("param_id"))).alias(f"p{i}")))
    m = trailing_ridge(return_pairs(spark, d, THREE), len(THREE), WINDOW).where("n >= 10 AND condition <= 1e12D")
    return p, m.select(*PANEL, ((F.col("day") + 1) * 86_400_000_000).alias("at"), F.transform("c", lambda v: v / F.pow("bar_seconds", F.lit(2.0))).alias("c"))


def _in_force(rows: DataFrame, p: list[DataFrame], m: DataFrame) -> DataFrame:
    """Rows bar_seconds, us with kappa, gamma, x_eq (arrays) and c of the configuration in force;
    rows before the first parameters of all symbols are left out."""
    for i, one in enumerate(p):
        rows = J.asof(rows, one, PANEL, "us", "at", [f"p{i}"], slot=WEEK_US)
    rows = J.asof(rows.where(" AND ".join(f"p{i} IS NOT NULL" for i in range(len(p)))), m, PANEL, "us", "at", ["c"], slot=WEEK_US)
    arrays = {f: F.array(*(F.col(f"p{i}.{f}") for i in range(len(p)))) for f in ("kappa", "gamma", "x_eq")}
    return rows.withColumns(arrays).drop(*(f"p{i}" for i in range(len(p))))


@query()
def replay_coupled(spark: SparkSession, d: str) -> DataFrame:
    """Three symbols replayed together, each under its own parameters in force, under the
    coupling in force."""
    rows = segments(spark, d, THREE).withColumn("us", (F.col("t") + 1) * F.col("bar_seconds") * 1_000_000)
    done = coupled_replay(_in_force(rows, *_updates(spark, d)), len(THREE))
    return done.select(*PANEL, "segment_id", "t", "forecast", F.zip_with("forecast", "xs", lambda f, x: f - x).alias("error"), "held", F.col("c").isNotNull().alias("coupled"))


@query()
def stability_table(spark: SparkSession, d: str) -> DataFrame:
    """Raw and guarded stability at every time at which the configuration of three symbols
    changes: the union of the times of their parameters and of their couplings."""
    p, m = _updates(spark, d)
    times = m.select(*PANEL, F.col("at").alias("us"))
    for one in p:
        times = times.unionAll(one.select(*PANEL, F.col("at").alias("us")))
    rows = _in_force(times.distinct(), p, m).select(*PANEL, "us", "kappa", "gamma", "c")
    n = len(THREE)
    names = ["radius_raw", "radius", "norm", "growth", "distance", "condition"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, g = (b[c].flatten().to_numpy().reshape(-1, n) for c in ("kappa", "gamma"))
            out = []
            for i, (c, dt) in enumerate(zip(b["c"].to_pylist(), b["bar_seconds"].to_pylist())):
                c = np.zeros((n, n)) if c is None else np.array(c).reshape(n, n)
                raw, ok = D.stability(k[i], g[i], c, float(dt)), D.stability(np.maximum(k[i], 0.0), g[i], c, float(dt))
                out.append([raw["radius"], *(ok[x] for x in names[1:]), ok["radius"] <= D.RADIUS_LIMIT and ok["growth"] <= D.GROWTH_LIMIT])
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([b["bar_seconds"], b["us"], *(pa.array(list(c), pa.float64()) for c in cols[:6]), pa.array(list(map(bool, cols[6])), pa.bool_())], [*PANEL, "us", *names, "stable"])

    return rows.mapInArrow(rate, f"bar_seconds long, us long, {', '.join(f'{x} double' for x in names)}, stable boolean")


@query()
def ridge_coupling(spark: SparkSession, d: str) -> DataFrame:
    """Matrix of lagged slopes by ridge regression at each day's end over the last 28,800
    samples of all symbols, one row per cell."""
    pairs = return_pairs(spark, d, SYMBOLS)
    n, names = len(SYMBOLS), F.array(*map(F.lit, SYMBOLS))
    state = F.expr("CASE WHEN n < 10 THEN 'INSUFFICIENT_HISTORY' WHEN condition > 1e12D THEN 'REJECTED_NUMERICAL_CONDITION' ELSE 'ACCEPTED' END")
    m = trailing_ridge(pairs, n, WINDOW).select("*", F.posexplode("c").alias("i", "v"))
    name = lambda e, a: F.element_at(names, F.expr(e) + 1).alias(a)
    return m.select(*PANEL, "day", "n", name(f"cast(i div {n} as int)", "affected"), name(f"i % {n}", "source"), F.col("v").alias("c"), "condition", state.alias("status"))


@query()
def factor_state(spark: SparkSession, d: str) -> DataFrame:
    """Regime probability, blended residual levels and the selected component of each row."""

    def body(t: np.ndarray, xs: np.ndarray) -> dict:
        s = X.factor_states(np.diff(xs, axis=0)) if len(xs) > 1 else None
        if s is None:
            return {"t": [], "high": [], "levels": [], "component": [], "score": []}
        who, score = X.select(s["level"], s["pressure"], s["cluster"])
        return {"t": t[1:], "high": s["high"], "levels": s["level"].tolist(), "component": who, "score": score}

    return per_segment(segments(spark, d, SYMBOLS), PANEL, body, {"t": L, "high": N, "levels": V, "component": L, "score": N})


def _incidence() -> np.ndarray:
    names = sorted({s[:3] for s in SYMBOLS} | {s[3:] for s in SYMBOLS})
    return np.array([[(s[:3] == c) - (s[3:] == c) for c in names] for s in SYMBOLS], dtype=float)


@query()
def basket_weights(spark: SparkSession, d: str) -> DataFrame:
    """Currency-neutral unit basket against the selected component, its distortion and overlap."""
    con = _incidence()

    def build(batches):
        for t in batches:
            w, kept, off = [], [], []
            for levels, who in zip(t["levels"].to_pylist(), t["component"].to_pylist()):
                s = np.zeros(len(levels))
                s[who] = -np.sign(levels[who]) or -1.0
                b = X.neutral_basket(s, con)
                unit = b / max(np.linalg.norm(b), 1e-300)
                w.append(b.tolist())
                kept.append(float(abs(unit @ s)))
                off.append(float(np.linalg.norm(unit - s)))
            yield pa.RecordBatch.from_arrays([t["bar_seconds"], t["t"], pa.array(w, pa.list_(pa.float64())), pa.array(kept, pa.float64()), pa.array(off, pa.float64())], [*PANEL, "t", "weights", "preserved", "distortion"])

    return factor_state(spark, d).select(*PANEL, "t", "levels", "component").mapInArrow(build, "bar_seconds long, t long, weights array<double>, preserved double, distortion double")


#: Rows after a row that its path goes on for.
STEPS = 6


@query(f"""WITH {GRID}, n AS (SELECT step AS bar_seconds, symbol, k, median(x) AS x FROM g WHERE symbol IN {tuple(SYMBOLS)} GROUP BY ALL),
c AS (SELECT *, CASE WHEN k - lag(k) OVER w = 1 THEN 0 ELSE 1 END AS new FROM n WINDOW w AS (PARTITION BY bar_seconds, symbol ORDER BY k)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY bar_seconds, symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS segment_id FROM c),
l AS (SELECT *, x - first(x) OVER (PARTITION BY bar_seconds, symbol, segment_id ORDER BY k) AS l FROM s),
a AS (SELECT *, [{", ".join(f"lead(l, {i}) OVER w" for i in range(1, STEPS + 1))}] AS a FROM l WINDOW w AS (PARTITION BY bar_seconds, symbol, segment_id ORDER BY k)),
o AS (SELECT *, [v * sign(l) <= 0 FOR v IN a] AS over FROM a WHERE a[{STEPS}] IS NOT NULL)
SELECT bar_seconds, symbol, segment_id, k AS t, round(a[{STEPS}] - l, 8) + 0.0 AS change, round(greatest(0.0::DOUBLE, list_max([(v - l) * sign(l) FOR v IN a])), 8) + 0.0 AS adverse, round(list_max([abs(v) FOR v IN a]), 8) + 0.0 AS largest,
  CASE WHEN list_contains(over, true) THEN list_position(over, true) ELSE -1 END::BIGINT AS crossed FROM o""")
def frozen_targets(spark: SparkSession, d: str) -> DataFrame:
    """Path of each symbol's displacement from its segment's start over the six rows after each
    row: change to the end, largest adverse and absolute move, first step beyond zero (-1: never)."""
    keys = [*PANEL, "symbol"]
    own = native(grid(spark, d)).where(F.col("symbol").isin(SYMBOLS)).withColumn("step", F.col("bar_seconds"))
    w = S.ordered([*keys, "segment_id"])
    e = S.with_edges(own, keys).withColumn("l", F.col("x") - F.first("x").over(w))
    e = e.withColumn("a", F.array(*(F.lead("l", i).over(w) for i in range(1, STEPS + 1)))).where(F.col("a")[STEPS - 1].isNotNull())
    side = F.signum("l")
    over = F.transform("a", lambda v: v * side <= 0)
    change, adverse = F.col("a")[STEPS - 1] - F.col("l"), F.greatest(F.lit(0.0), F.array_max(F.transform("a", lambda v: (v - F.col("l")) * side)))
    largest, crossed = F.array_max(F.transform("a", lambda v: F.abs(v))), F.array_position(over, True)
    return e.select(*keys, "segment_id", F.col("k").alias("t"), rd(change, 8).alias("change"), rd(adverse, 8).alias("adverse"), rd(largest, 8).alias("largest"), F.when(crossed > 0, crossed).otherwise(-1).cast("long").alias("crossed"))


@query()
def block_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of the forecasts' Brier improvement on the training prior, by symbol, from 2,000
    replicates of blocks of observed time; every symbol's replicates are spread over tasks."""
    tr, oo = _parts(spark, d)
    prior = tr.groupBy("symbol").agg(F.avg("up").alias("q"))
    # per symbol and day one row: the block unit, which bounds what a replicate touches
    day = oo.join(prior, "symbol").groupBy("symbol", "day").agg(F.sum(F.expr("(q - up) * (q - up) - (p - up) * (p - up)")).alias("gain"), F.count(F.lit(1)).alias("n"))
    days = day.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "gain", "n"))).alias("d"))
    reps = days.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))

    def draw(batches):
        for t in batches:
            out = []
            for ds, rep in zip(t["d"].to_pylist(), t["rep"].to_pylist()):
                at = np.array([x["day"] for x in ds])
                cut = np.flatnonzero(np.diff(at) > 1)
                first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
                i = X.block_draws(at, first, last, 3, len(at), np.random.default_rng([SEED, rep]))
                out.append(sum(ds[j]["gain"] for j in i) / sum(ds[j]["n"] for j in i))
            yield pa.RecordBatch.from_arrays([t["symbol"], t["rep"], pa.array(out, pa.float64())], ["symbol", "rep", "gain"])

    g = reps.select("symbol", "rep", "d").mapInArrow(draw, "symbol string, rep int, gain double")
    q = lambda p, a: F.percentile("gain", p).alias(a)
    bounds = g.groupBy("symbol").agg(q(0.025, "low_two_sided"), q(0.05, "low"), q(0.95, "high"), q(0.975, "high_two_sided"))
    point = day.groupBy("symbol").agg((F.sum("gain") / F.sum("n")).alias("point"))
    return point.join(bounds, "symbol")


@query(f"""WITH {SPLIT}, r AS (SELECT symbol, p, up, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', '1', feed_id, k)), feed_id, k) AS i, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws('|', '2', feed_id, k)), feed_id, k) AS j FROM oo)
SELECT a.symbol, count(*) AS n, round(avg((a.p - a.up) * (a.p - a.up)), 8) + 0.0 AS brier, round(avg((a.p - b.up) * (a.p - b.up)), 8) + 0.0 AS placebo_brier, round(avg(a.up), 8) + 0.0 AS rate, round(avg(b.up), 8) + 0.0 AS placebo_rate
FROM r a JOIN r b ON a.symbol = b.symbol AND a.i = b.j GROUP BY a.symbol""")
def placebo_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Brier of the forecasts against labels moved to other rows of their symbol: the rows in
    one random order meet the labels in another.  Both orders are sorted in ranges."""
    _, oo = _parts(spark, d)

    def order(salt: str, *columns: Column) -> DataFrame:
        key = F.md5(F.concat_ws("|", F.lit(salt), F.col("feed_id"), F.col("k").cast("string"))).alias("key")
        n = numbered(oo.select("symbol", key, "feed_id", "k", *columns), ["symbol", "key", "feed_id", "k"], "i")
        first = n.groupBy("symbol").agg(F.min("i").alias("first"))  # a row a symbol
        return n.join(first, "symbol").select("symbol", (F.col("i") - F.col("first")).alias("i"), *columns)

    j = order("1", F.col("p"), F.col("up")).join(order("2", F.col("up")).withColumnRenamed("up", "other"), ["symbol", "i"])
    err = lambda y: F.avg((F.col("p") - F.col(y)) * (F.col("p") - F.col(y)))
    return j.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rd(err("up"), 8).alias("brier"), rd(err("other"), 8).alias("placebo_brier"), rd(F.avg("up"), 8).alias("rate"), rd(F.avg("other"), 8).alias("placebo_rate"))


@query()
def budgeted_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Baskets with a currency budget instead of strict neutrality, and whether they fit."""
    con = _incidence()
    lead = np.ones((len(SYMBOLS), 1))

    def build(batches):
        for t in batches:
            got = []
            for levels, who in zip(t["levels"].to_pylist(), t["component"].to_pylist()):
                s = np.zeros(len(levels))
                s[who] = -np.sign(levels[who]) or -1.0
                got.append(X.budgeted_basket(s, lead, con, np.eye(len(s)) * 1e-8, np.zeros(len(s))))
            yield pa.RecordBatch.from_arrays([t["bar_seconds"], t["t"], pa.array([g[0].tolist() for g in got], pa.list_(pa.float64())), pa.array([g[1] for g in got], pa.bool_())], [*PANEL, "t", "weights", "feasible"])

    return factor_state(spark, d).select(*PANEL, "t", "levels", "component").mapInArrow(build, "bar_seconds long, t long, weights array<double>, feasible boolean")


@query()
def kernel_readout(spark: SparkSession, d: str) -> DataFrame:
    """Ridge on the kernel features: moments of the first seven tenths summed by Spark, one
    small solve, accuracy on the rest."""
    phi = kernel_features(spark, d).withColumn("s", F.expr(SECONDS))
    span = phi.agg(F.min("s").alias("a"), F.max("s").alias("b"), F.max(F.size("phi")).alias("m")).first()
    empty = spark.createDataFrame([], "n long, accuracy double")
    if span["a"] is None:
        return empty
    m, c, split = span["m"], len(SYMBOLS), span["a"] + (span["b"] - span["a"]) * 7 // 10
    sums = moments(phi.where(F.col("s") < split).select(F.col("phi").alias("x"), "y"), m, c)
    if sums is None:
        return empty
    w = np.linalg.solve(sums[0] + 0.01 * np.eye(m), sums[1])
    dot = lambda k: F.aggregate(F.zip_with("phi", F.array(*(F.lit(float(v)) for v in w[:, k])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = phi.where(F.col("s") >= split).withColumn("e", F.array(*(dot(k) for k in range(c))))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.avg((F.array_position("e", F.array_max("e")) - 1 == F.col("y")).cast("double")).alias("accuracy"))
