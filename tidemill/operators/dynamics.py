"""Coupled oscillators: stability of a configuration, replay of a segment, ridge coupling."""

from __future__ import annotations

import numpy as np

#: Limits of the guarded replay (fixed values).
RADIUS_LIMIT, GROWTH_LIMIT, GROWTH_STEPS, CIRCLE = 1.0 + 1e-10, 10.0, 60, 16
DT_GRID = np.concatenate([np.arange(1.0, 121.0), np.arange(150.0, 3601.0, 30.0)])


def step_matrix(kappa: np.ndarray, gamma: np.ndarray, coupling: np.ndarray, dt: float) -> np.ndarray:
    """One semi-implicit step in the balanced coordinates (x, dt v).

    dt v' = D (-dt² K x + (I + dt² C) dt v), x' = x + dt v' with D = 1 / (1 + dt γ).
    """
    n = len(kappa)
    d = 1.0 / (1.0 + dt * gamma)
    pull = np.diag(-d * dt * dt * kappa)
    keep = d[:, None] * (np.eye(n) + dt * dt * coupling)
    return np.vstack([np.hstack([np.eye(n) + pull, keep]), np.hstack([pull, keep])])


def stability(kappa: np.ndarray, gamma: np.ndarray, coupling: np.ndarray, dt: float) -> dict[str, float]:
    """Spectral radius, norm, condition of the eigenvectors, largest transient growth and
    distance to instability of one configuration."""
    a = step_matrix(kappa, gamma, coupling, dt)
    e, v = np.linalg.eig(a)
    powers = [a]
    while len(powers) < GROWTH_STEPS and np.abs(powers[-1]).max() < 1e100:  # beyond it growth is without bound
        powers.append(a @ powers[-1])
    growth = max(1.0, float(np.linalg.norm(np.array(powers), ord=2, axis=(1, 2)).max())) if len(powers) == GROWTH_STEPS else float("inf")
    z = np.exp(2j * np.pi * np.arange(CIRCLE) / CIRCLE)
    near = np.linalg.svd(z[:, None, None] * np.eye(len(a)) - a, compute_uv=False)[:, -1].min()
    return {"radius": float(np.abs(e).max()), "norm": float(np.linalg.norm(a, 2)), "condition": float(np.linalg.cond(v)), "growth": growth, "distance": float(near)}


def stable_steps(kappa: np.ndarray, gamma: np.ndarray, coupling: np.ndarray) -> tuple[int, float]:
    """Stable stretches of the sampled step sizes, and the largest stable one."""
    radii = np.array([np.abs(np.linalg.eigvals(step_matrix(kappa, gamma, coupling, t))).max() for t in DT_GRID])
    ok = radii <= RADIUS_LIMIT
    starts = int((ok & ~np.concatenate([[False], ok[:-1]])).sum())
    return starts, float(DT_GRID[ok].max()) if ok.any() else 0.0


class Replayer:
    """Row-by-row replay: position, speed and the parameters in force at the row before.

    A row that starts anew resets to the observation at rest.  Negative curvature is taken
    as none; a configuration over a limit holds the observed value.  Parameters change
    rarely, so the verdict on the last configuration is kept.
    """

    def __init__(self, n: int):
        self.x, self.v, self.before = np.zeros(n), np.zeros(n), None
        self.known: tuple | None = None
        self.steady = True

    def row(self, x: np.ndarray, x_eq: np.ndarray, kappa: np.ndarray, gamma: np.ndarray, coupling: np.ndarray | None, dt: float, anew: bool) -> tuple[np.ndarray, bool]:
        """Forecast of a row, and whether the observation was taken instead."""
        held = anew or self.before is None
        if not held:
            q, k, g, c = self.before
            config = (k.tobytes(), g.tobytes(), b"" if c is None else c.tobytes(), dt)
            if config != self.known:
                m = stability(k, g, np.zeros((len(k), len(k))) if c is None else c, dt)
                self.known, self.steady = config, m["radius"] <= RADIUS_LIMIT and m["growth"] <= GROWTH_LIMIT
            held = not self.steady
            if not held:
                push = 0.0 if c is None else c @ (dt * self.v)
                self.v = (self.v + dt * (push - k * (self.x - q))) / (1.0 + dt * g)
                self.x = self.x + dt * self.v
        if held:
            self.x, self.v = x.astype(float), np.zeros(len(x))
        self.before = (x_eq, np.maximum(kappa, 0.0), gamma, coupling)
        return self.x, held


def replay(xs: np.ndarray, x_eq: np.ndarray, kappa: np.ndarray, gamma: np.ndarray, coupling: np.ndarray, dt: float, state: Replayer | None = None) -> tuple[np.ndarray, np.ndarray, Replayer]:
    """Forecasts of a segment's rows, whether each was held, and the state after them; with
    ``state`` the rows go on from an earlier part."""
    r = Replayer(xs.shape[1]) if state is None else state
    got = [r.row(x, q, k, g, coupling, dt, state is None and i == 0) for i, (x, q, k, g) in enumerate(zip(xs, x_eq, kappa, gamma))]
    return np.array([g[0] for g in got]), np.array([g[1] for g in got]), r


def ridge_matrix(xy: np.ndarray, xx: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Rows of slopes (Σ y zᵀ)(Σ z zᵀ + λ diag)⁻¹ with no self-coupling, and the condition."""
    d = np.diag(xx)
    floor = max(float(np.median(d)) * 1e-12, np.finfo(float).tiny)
    m = xx + ridge * np.diag(np.maximum(d, floor))
    c = np.linalg.solve(m, xy.T).T
    np.fill_diagonal(c, 0.0)
    return c, float(np.linalg.cond(m))
