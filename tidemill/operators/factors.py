"""Two-regime factor state, baskets neutral to factors and currencies, block bootstrap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Regimes:
    """Parameters of the calm and the volatile regime, side by side (fixed values)."""

    cov_half_life: tuple[float, float] = (1440.0, 240.0)
    res_half_life: tuple[float, float] = (1440.0, 240.0)
    refresh: tuple[int, int] = (60, 15)
    memory: tuple[float, float] = (0.995, 0.970)
    factors: int = 3
    shrinkage: float = 0.20
    threshold: float = 0.15


#: Chances to stay in and to enter the volatile regime, and how far the two lie apart;
#: discounts of crowded components; weights of risk, of change and of a step (fixed values).
STAY, ENTER, APART = 0.985, 0.010, 0.55
PRESSED, CLUSTERED = 0.75, 0.10
RISK, CHANGE, STEP = 0.35, 0.03, 0.12


def _components(adjacent: np.ndarray) -> np.ndarray:
    """Size of each node's connected component (a handful of nodes)."""
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        more = (reach.astype(int) @ reach.astype(int)) > 0
        if (more == reach).all():
            return reach.sum(axis=1)
        reach = more


def partial_correlations(cov: np.ndarray, shrinkage: float) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvectors first, and partial correlations, of a shrunk covariance."""
    n = len(cov)
    c = (1 - shrinkage) * cov + shrinkage * max(np.trace(cov) / n, 1e-12) * np.eye(n)
    e, v = np.linalg.eigh(c)
    p = np.linalg.pinv(c, rcond=1e-12)
    d = np.sqrt(np.maximum(np.diag(p), 1e-18))
    partial = np.clip(-p / np.outer(d, d), -1, 1)
    np.fill_diagonal(partial, 0.0)
    return v[:, np.argsort(e)[::-1]], partial


def factor_states(returns: np.ndarray, r: Regimes = Regimes()) -> dict[str, np.ndarray]:
    """Causal two-regime factor model over one segment; row i uses rows up to i only.

    Both regimes are carried as leading axis 2: exponential mean and covariance weighted by
    the regime's probability, factors refreshed every few steps, residual scale, residual
    level S ← a S + residual / scale.  Levels are blended by the probabilities.
    """
    t, n = returns.shape
    f = min(r.factors, n - 1)
    alpha = lambda h: 1.0 - 2.0 ** (-1.0 / np.array(h))
    a_cov, a_res, a_vol = alpha(r.cov_half_life), alpha(r.res_half_life), alpha(r.res_half_life)[0]
    mean, cov = np.zeros((2, n)), np.repeat((np.eye(n) * 1e-8)[None], 2, axis=0)
    load, var, level = np.repeat(np.eye(n, f)[None], 2, axis=0), np.full((2, n), 1e-8), np.zeros((2, n))
    pressure, cluster = np.zeros((2, n)), np.ones((2, n), dtype=int)
    high, lv_mean, lv_var, memory = 0.5, 0.0, 1.0, np.array(r.memory)[:, None]
    out: dict[str, list] = {k: [] for k in ("high", "level", "pressure", "cluster", "scale", "residual")}
    for i, x in enumerate(returns, 1):
        lv = np.log(max(np.sqrt(np.mean(x * x)), 1e-12))
        z = np.clip((lv - lv_mean) / np.sqrt(max(lv_var, 1e-8)), -8, 8)
        prior = STAY * high + ENTER * (1 - high)
        odds = np.array([1 - prior, prior]) * np.exp(-0.5 * (z + np.array([APART, -APART])) ** 2)
        high = odds[1] / odds.sum() if odds.sum() > 1e-300 else 0.5
        d = lv - lv_mean
        lv_mean += a_vol * d
        lv_var = (1 - a_vol) * lv_var + a_vol * d * (lv - lv_mean)
        w = np.array([1 - high, high])
        a = (a_cov * w)[:, None]
        delta = x - mean
        mean = mean + a * delta
        cov = (1 - a[..., None]) * cov + a[..., None] * np.einsum("ki,kj->kij", delta, x - mean)
        cov = (cov + cov.transpose(0, 2, 1)) / 2
        for k in range(2):
            if i == 1 or i % r.refresh[k] == 0:
                vectors, partial = partial_correlations(cov[k], r.shrinkage)
                load[k] = vectors[:, :f]
                pressure[k] = np.minimum(np.abs(partial).sum(axis=1) / max(n - 1, 1), 1)
                cluster[k] = _components(np.abs(partial) >= r.threshold)
        c = x - mean
        res = c - np.einsum("kif,kjf,kj->ki", load, load, c)
        b = (a_res * w)[:, None]
        var = (1 - b) * var + b * res * res
        scale = np.sqrt(np.maximum(var, 1e-16))
        level = memory * level + res / scale
        active = int(high >= 0.5)
        for key, value in (("high", high), ("level", w @ level), ("pressure", pressure[active].copy()), ("cluster", cluster[active].copy()), ("scale", scale[active]), ("residual", res[active])):
            out[key].append(value)
    return {k: np.array(v) for k, v in out.items()}


def select(level: np.ndarray, pressure: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component with the largest |level| after discounting crowded ones, per row, and its score."""
    score = np.abs(level) / (1 + PRESSED * pressure + CLUSTERED * np.maximum(cluster - 1, 0))
    return score.argmax(axis=1), score.max(axis=1)


def neutral_basket(signal: np.ndarray, constraints: np.ndarray) -> np.ndarray:
    """The part of a signal orthogonal to all constraint columns, at unit gross; zero if none is left."""
    q, s, _ = np.linalg.svd(constraints, full_matrices=False)
    q = q[:, s > 1e-12 * max(s.max(initial=0.0), 1e-300)]
    w = signal - q @ (q.T @ signal)
    gross = np.abs(w).sum()
    return w / gross if gross > 1e-12 else np.zeros_like(w)


def budgeted_basket(signal: np.ndarray, factors: np.ndarray, incidence: np.ndarray, cov: np.ndarray, before: np.ndarray, budget: float = 0.35, most: float = 0.45, rounds: int = 400) -> tuple[np.ndarray, bool]:
    """Unit-gross weights neutral to the factors, with every currency's exposure within the
    budget and no weight above ``most``, that follow the signal; and whether all hold.

    Ascent on s·w - RISK wᵀΣw - CHANGE |w - before|, each step followed by Dykstra's
    alternating projections onto the factor-null space, the exposure slab of each currency
    and the weight box; gross exposure is restored along the feasible loop space, which
    neither factors nor currencies see.
    """
    q, s, _ = np.linalg.svd(factors, full_matrices=False)
    q = q[:, s > 1e-12 * max(s.max(initial=0.0), 1e-300)]
    norms = np.maximum((incidence**2).sum(axis=0), 1e-300)

    def project(w: np.ndarray) -> np.ndarray:
        keep = np.zeros((incidence.shape[1] + 2, len(w)))
        for _ in range(60):
            start = w
            for i in range(len(keep)):
                y = w + keep[i]
                if i == 0:
                    w = y - q @ (q.T @ y)
                elif i == 1:
                    w = np.clip(y, -most, most)
                else:
                    d = incidence[:, i - 2]
                    x = float(d @ y)
                    w = y - (x - np.clip(x, -budget, budget)) / norms[i - 2] * d
                keep[i] = y - w
            if np.abs(w - start).max() < 1e-13:
                break
        return w

    w = project(signal / max(np.abs(signal).sum(), 1e-300))
    for n in range(rounds // 20):
        w = project(w + STEP / (1 + n) * (signal - 2 * RISK * cov @ w - CHANGE * np.sign(w - before)))
    loop = neutral_basket(signal + 1e-3 * np.linspace(-1, 1, len(signal)), np.hstack([incidence, factors]))
    gross = np.abs(w).sum()
    if gross > 1:
        w = w / gross  # shrinking keeps every bound
    elif loop.any():
        low, high = 0.0, 2.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.abs(w + mid * loop).sum() < 1 else (low, mid)
        w = w + high * loop
    fits = np.abs(q.T @ w).max(initial=0) <= 1e-8 and np.abs(incidence.T @ w).max() <= budget + 1e-8 and np.abs(w).max() <= most + 1e-8 and abs(np.abs(w).sum() - 1) <= 1e-8
    return w, bool(fits)


def path_outcomes(level: np.ndarray, horizon: int) -> dict[str, np.ndarray]:
    """For every row with ``horizon`` rows after it: change to the end, largest adverse and
    absolute move, and the first step at which the level has crossed zero (-1: never)."""
    n = len(level) - horizon
    if n <= 0:
        return {k: np.zeros(0) for k in ("change", "adverse", "largest", "crossed")}
    ahead = np.lib.stride_tricks.sliding_window_view(level, horizon + 1)[:n]
    side = np.sign(ahead[:, :1])
    move = (ahead[:, 1:] - ahead[:, :1]) * side
    crossed = ahead[:, 1:] * side <= 0
    return {"change": ahead[:, -1] - ahead[:, 0], "adverse": np.maximum(move.max(axis=1), 0), "largest": np.abs(ahead[:, 1:]).max(axis=1), "crossed": np.where(crossed.any(axis=1), crossed.argmax(axis=1) + 1, -1)}


def block_draws(at: np.ndarray, first: np.ndarray, last: np.ndarray, block: int, want: int, rng: np.random.Generator) -> np.ndarray:
    """Positions of ``want`` rows from random contiguous blocks of observed time.

    ``at`` are the sorted times of the rows, ``first``/``last`` the bounds of the segments
    (inclusive).  A segment is drawn by its length, a start uniformly in it; the block
    ends with the segment; blocks without rows are drawn again.
    """
    length = (last - first + 1).astype(float)
    got, n = [], 0
    for _ in range(200):
        s = rng.choice(len(first), size=max(8, 2 * want // max(block, 1)), p=length / length.sum())
        a = first[s] + (rng.random(len(s)) * length[s]).astype(np.int64)
        lo, hi = np.searchsorted(at, a), np.searchsorted(at, np.minimum(a + block, last[s] + 1))
        for x, y in zip(lo.tolist(), hi.tolist()):
            if y > x:
                got.append(np.arange(x, y))
                n += y - x
            if n >= want:
                return np.concatenate(got)[:want]
    raise ValueError("the blocks hold too few rows")
