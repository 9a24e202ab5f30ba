import numpy as np
import pytest

from tidemill.operators import dynamics as D
from tidemill.operators import factors as X
from tidemill.operators import filters as Q
from tidemill.operators.sequential import standardised

C3 = np.array([[0, 1e-5, -2e-5], [1e-5, 0, 3e-5], [-2e-5, 3e-5, 0]])


def rows(n, k, seed=0):
    return np.clip(np.random.default_rng(seed).normal(size=(n, k)), -5, 5)


def test_filters_keep_their_invariants():
    z = rows(40, 3)
    p, purity, worst = Q.lindblad(z, C3, 60.0)
    assert worst < 1e-12 and np.allclose(p.sum(axis=1), 1) and (purity <= 1 + 1e-12).all()
    t, jumps = Q.trajectories(z, C3, 60.0, 96, 1)
    assert np.allclose(t.sum(axis=1), 1) and jumps.sum() > 0
    c = Q.channel_checks(Q.kraus(z[0], C3, 60.0))
    assert c["min_eigenvalue"] > -1e-12 and c["trace_error"] < 1e-12 and c["radius"] == pytest.approx(1, abs=1e-9)
    k0, k1 = Q.instrument(z[0])
    assert np.allclose(k0**2 + k1**2, 1)
    o = Q.reservoir(rows(5, 4), 7)
    assert o.shape == (5, 9) and (np.abs(o) <= 1 + 1e-12).all()
    e = np.array([Q.encode(v, np.zeros((4, 4)), 60.0) for v in rows(6, 4)])
    f = Q.fidelity(e, e)
    assert np.allclose(np.diag(f), 1) and np.allclose(f, f.T) and np.linalg.eigvalsh(f).min() > -1e-10
    assert np.allclose(Q.nystroem(f, f) @ Q.nystroem(f, f).T, f, atol=1e-6)


def test_trajectories_approach_the_channel():
    z = rows(6, 3, 2)
    rho = np.eye(3, dtype=complex) / 3
    want = []
    for v in z:
        u = Q.qutrit_unitary(v, C3, 60.0)
        r = u @ rho @ u.conj().T
        rho = (1 - Q.DEPHASING) * r + Q.DEPHASING * np.diag(np.diag(r))
        want.append(np.diag(rho).real)
    got, _ = Q.trajectories(z, C3, 60.0, 30_000, 3)
    assert np.abs(got - np.array(want)).max() < 0.02


def test_tensor_chain_against_the_dense_state():
    """Without truncation and jumps the chain is the dense product of the same gates."""
    z = rows(3, 3, 4)
    c = np.zeros((3, 3))
    c[0, 1] = c[1, 0] = c[1, 2] = c[2, 1] = 5e-5
    keep, Q.SITE_DEPHASING = Q.SITE_DEPHASING, 0.0
    try:
        got, lost = Q.tensor_chain(z, c, 60.0, 81, 0)
    finally:
        Q.SITE_DEPHASING = keep
    psi = np.full(27, 27**-0.5, dtype=complex)
    angle, eye = Q.EXCHANGE * 5e-5 * 3600, np.eye(3)
    bond = lambda q, f: np.kron(np.kron(np.eye(3**q), Q.evolution(Q._exchange() * angle * f)), np.eye(3 ** (1 - q)))
    for v in z:
        l = [Q.evolution((Q.SITE_PHASE * x * Q._LEVEL + Q.SITE_DRIVE * Q._DRIVE) / 2) for x in v]
        site = np.kron(np.kron(l[0], l[1]), l[2])
        psi = site @ bond(0, 0.5) @ bond(1, 1.0) @ bond(0, 0.5) @ site @ psi
        p = (np.abs(psi) ** 2).reshape(3, 3, 3)
    mid = np.array([p.sum(axis=tuple(a for a in range(3) if a != q))[1] for q in range(3)])
    assert lost.max() < 1e-12 and np.allclose(got[-1], (1 - mid) / (1 - mid).sum(), atol=1e-10)
    assert len(eye) == 3


def test_causality_of_ordered_bodies():
    xs = np.cumsum(rows(120, 4, 5) * 1e-4, axis=0)
    other = xs.copy()
    other[80:] += rows(40, 4, 6)
    assert np.array_equal(standardised(xs)[:79], standardised(other)[:79])
    a, b = X.factor_states(np.diff(xs, axis=0)), X.factor_states(np.diff(other, axis=0))
    assert all(np.array_equal(a[k][:79], b[k][:79]) for k in a)


def test_stability_and_replay():
    k, g, c = np.array([1e-6, 2e-6]), np.array([1e-3, 2e-3]), np.zeros((2, 2))
    m = D.stability(k, g, c, 60.0)
    assert m["radius"] < 1 and m["growth"] >= 1
    xs = rows(20, 2, 7)
    one = np.ones((20, 2))
    out, held, end = D.replay(xs, one * 0.1, one * k, one * g, c, 60.0)
    a = D.step_matrix(k, g, c, 60.0)
    s = np.concatenate([xs[0] - 0.1, [0, 0]])
    for i in range(1, 20):
        s = a @ s
        assert np.allclose(out[i], s[:2] + 0.1)
    first, _, mid = D.replay(xs[:10], one[:10] * 0.1, one[:10] * k, one[:10] * g, c, 60.0)
    rest, _, _ = D.replay(xs[10:], one[10:] * 0.1, one[10:] * k, one[10:] * g, c, 60.0, mid)
    assert np.allclose(np.concatenate([first, rest]), out) and held[0] and not held[1:].any()
    unstable, held, _ = D.replay(xs, one, one * 1e3, one * 0.0, c, 60.0)
    assert held.all() and np.allclose(unstable, xs)


def test_ridge_baskets_and_paths():
    z = rows(500, 3, 8)
    true = np.array([[0, 0.5, 0], [0.2, 0, -0.3], [0, 0, 0.0]])
    c, cond = D.ridge_matrix((z @ true.T).T @ z, z.T @ z)
    assert np.allclose(c, true, atol=0.01) and cond < 10
    con = rows(10, 4, 9)
    w = X.neutral_basket(np.eye(10)[3], con)
    assert np.abs(con.T @ w).max() < 1e-12 and np.abs(w).sum() == pytest.approx(1)
    assert not X.neutral_basket(con[:, 0], con).any()
    o = X.path_outcomes(np.array([1.0, 2, 3, -1, 0, 5]), 3)
    assert o["change"].tolist() == [-2, -2, 2] and o["crossed"].tolist() == [3, 2, 1] and o["adverse"].tolist() == [2, 1, 2]
    assert X.path_outcomes(np.zeros(2), 3)["change"].size == 0


def test_blocks_stay_inside_segments():
    at, first, last = np.array([0, 1, 5, 10, 11, 12]), np.array([0, 10]), np.array([6, 13])
    rng = np.random.default_rng(0)
    i = X.block_draws(at, first, last, 3, 60, rng)
    assert len(i) == 60 and set(i.tolist()) == set(range(6))
    with pytest.raises(ValueError):
        X.block_draws(np.zeros(0, dtype=int), first, last, 3, 5, rng)


def test_budgeted_baskets():
    names = ["EURUSD", "USDJPY", "GBPUSD", "USDCHF", "AUDUSD", "USDCAD", "USDCNH", "EURGBP", "EURJPY", "GBPJPY"]
    cur = sorted({n[:3] for n in names} | {n[3:] for n in names})
    inc = np.array([[(n[:3] == c) - (n[3:] == c) for c in cur] for n in names], dtype=float)
    rng, good = np.random.default_rng(0), 0
    for i in range(20):
        f = rng.normal(size=(10, 2))
        s = np.zeros(10)
        s[i % 10] = 1.0
        w, fits = X.budgeted_basket(s, f, inc, np.eye(10) * 1e-8, np.zeros(10))
        assert np.abs(f.T @ w).max() < 1e-8 and np.abs(inc.T @ w).max() <= 0.35 + 1e-6
        good += fits
    assert good >= 10


def test_panels_hold_every_bar_of_every_length(spark):
    """A minute's bars stay minutes; feeds of other lengths make panels of their own."""
    from tidemill.operators.sequential import panel_segments
    from tidemill.plans import model_queries as M

    bars = [(f, s, step, k, float(k)) for f, step, n in (("a", 60, 500), ("b", 60, 300), ("c", 900, 40)) for s in ("X", "Y") for k in range(n) if k != 100]
    p = panel_segments(M.native(spark.createDataFrame(bars, "feed_id string, symbol string, step long, k long, x double")), M.PANEL, "k", "symbol", ["X", "Y"], "x")
    assert sorted((r.bar_seconds, r.t, tuple(r.xs)) for r in p.collect()) == sorted((step, k, (k, k)) for step, n in ((60, 500), (900, 40)) for k in range(n) if k != 100)
    assert {(r.bar_seconds, r.segment_id) for r in p.collect()} == {(60, 0), (60, 1), (900, 0)}


def test_coupling_of_each_day_is_that_of_its_trailing_rows(spark):
    from tidemill.plans import model_queries as M

    rnd = np.random.default_rng(8)
    rows = [(bar, k, rnd.normal(size=10).tolist(), rnd.normal(size=10).tolist()) for bar, n in ((3600, 100), (14400, 40)) for k in range(n) if k % 24 != 5]
    df = spark.createDataFrame(rows, "bar_seconds long, t long, z array<double>, y array<double>").repartition(5)
    got = {(r.bar_seconds, r.day): r for r in M.trailing_ridge(df, 10, 50).collect()}
    want = {}
    for bar, k, _, _ in rows:
        before = [r for r in rows if r[0] == bar and r[1] * bar // 86400 <= k * bar // 86400][-50:]
        z, y = np.array([r[2] for r in before]), np.array([r[3] for r in before])
        want[bar, k * bar // 86400] = (len(z), *D.ridge_matrix(y.T @ z, z.T @ z))
    assert got.keys() == want.keys()
    for k, (n, c, cond) in want.items():
        assert got[k].n == n and np.allclose(got[k].c, c.ravel()) and got[k].condition == pytest.approx(cond)


def test_path_outcomes_come_for_every_symbol(spark, monkeypatch):
    from tidemill.plans import model_queries as M

    bars = [("f", s, 60, k, float(k)) for s in M.SYMBOLS for k in range(10)]
    monkeypatch.setattr(M, "grid", lambda spark, d: spark.createDataFrame(bars, "feed_id string, symbol string, step long, k long, x double"))
    got = {r.symbol: r["count"] for r in M.frozen_targets(spark, "").groupBy("symbol").count().collect()}
    assert got == {s: 4 for s in M.SYMBOLS}


def test_every_row_with_its_outcome_before_the_split_trains(spark, monkeypatch):
    from tidemill.plans import scoring_queries as C

    rows = [(k, 3600, k // 24) for k in range(24 * 20)]  # 20 days of hours: the split is day 5
    monkeypatch.setattr(C, "forecasts", lambda spark, d: spark.createDataFrame(rows, "k long, step long, day long"))
    train, scored = C._parts(spark, "")
    assert sorted(r.k for r in train.collect()) == list(range(5 * 24 - 1))
    assert sorted(r.k for r in scored.collect()) == list(range(5 * 24, 20 * 24))


def test_three_are_replayed_together(spark):
    from tidemill.operators import dynamics as D
    from tidemill.plans import model_queries as M

    rng = np.random.default_rng(3)
    c = [np.zeros((3, 3)), 1e-5 * rng.normal(size=(3, 3)), np.full((3, 3), 9.0)]  # the last grows without bound
    rows, want = [], {}
    for seg, n in ((0, 30), (1, 12)):
        xs = np.cumsum(rng.normal(0, 1e-3, (n, 3)), axis=0)
        k, g, q = rng.uniform(-1e-6, 1e-5, (n, 3)), rng.uniform(0.02, 0.1, (n, 3)), rng.normal(0, 1e-3, (n, 3))
        r = D.Replayer(3)
        for t in range(n):
            m = c[min(t // 10, 2)]
            f, held = r.row(xs[t], q[t], k[t], g[t], m, 60.0, t == 0)
            want[seg, t] = f.copy(), held
            rows.append((60, seg, t, xs[t].tolist(), q[t].tolist(), k[t].tolist(), g[t].tolist(), None if t < 10 else m.ravel().tolist()))
    df = spark.createDataFrame(rows, "bar_seconds long, segment_id long, t long, xs array<double>, x_eq array<double>, kappa array<double>, gamma array<double>, c array<double>").repartition(5)
    got = {(r.segment_id, r.t): r for r in M.coupled_replay(df, 3).collect()}
    assert len(got) == len(want)
    for key, (f, held) in want.items():
        assert np.allclose(got[key].forecast, f, rtol=1e-12) and got[key].held == held
    assert not got[0, 5].held and got[0, 25].held and got[1, 0].held
