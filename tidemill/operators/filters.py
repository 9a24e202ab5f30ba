"""Density-matrix and state-vector filters over standardised returns (bodies of segments).

All are written on whole arrays: channels that are diagonal in the basis act as elementwise
masks, gates as tensor contractions on a state of shape (2,) * n.
"""

from __future__ import annotations

import math

import numpy as np

#: Gains and rates (fixed values).
PHASE, MEASUREMENT, DEPHASING = 0.08, 0.20, 0.02
SITE_PHASE, SITE_DRIVE, EXCHANGE, MOST_ANGLE, SITE_DEPHASING = 0.085, 0.115, 0.85, 0.35, 0.004
#: Spread of the random circuit's weights and ring angles, largest loaded angle (fixed values).
THETA_SPREAD, PHI_SPREAD, RING_SPREAD, LOAD = 0.55, 0.40, 0.36, 1.2
#: Angles of the encoding: local turns, then even and odd neighbour gates (fixed values).
TURN_Y, TURN_Z, EVEN_Z, EVEN_C, ODD_Z, ODD_C = 0.75, 0.55, 0.24, 0.08, 0.17, 0.05


def evolution(h: np.ndarray) -> np.ndarray:
    """exp(-i h) of a Hermitian matrix."""
    e, v = np.linalg.eigh(h)
    return np.einsum("ij,j,kj->ik", v, np.exp(-1j * e), v.conj())


def qutrit_unitary(z: np.ndarray, coupling: np.ndarray, dt: float) -> np.ndarray:
    h = PHASE * (np.diag(z) + (coupling + coupling.T) * (dt * dt / 2))
    return evolution(h - np.eye(len(z)) * (np.trace(h) / len(z)))


def instrument(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonals of the two outcomes' operators; their squares sum to one."""
    effect = np.exp(MEASUREMENT * (z - z.max()))
    return np.sqrt(effect), np.sqrt(1.0 - effect)


def lindblad_step(rho: np.ndarray, z: np.ndarray, coupling: np.ndarray, dt: float) -> np.ndarray:
    """Unitary, conditional instrument and dephasing: the latter two are one mask."""
    u = qutrit_unitary(z, coupling, dt)
    k, _ = instrument(z)
    mask = np.outer(k, k) * (np.full_like(rho.real, 1 - DEPHASING) + DEPHASING * np.eye(len(z)))
    rho = (u @ rho @ u.conj().T) * mask
    rho = (rho + rho.conj().T) / 2
    return rho / np.trace(rho).real


def lindblad(zs: np.ndarray, coupling: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities and purity after each row, from the mixed state; worst invariant error."""
    n = zs.shape[1]
    rho, p, purity, worst = np.eye(n, dtype=complex) / n, [], [], 0.0
    for z in zs:
        rho = lindblad_step(rho, z, coupling, dt)
        p.append(np.diag(rho).real)
        purity.append(float(np.sum(np.abs(rho) ** 2)))
        worst = max(worst, abs(np.trace(rho).real - 1), float(-np.linalg.eigvalsh(rho)[0]))
    return np.array(p).reshape(-1, n), np.array(purity), worst


def trajectories(zs: np.ndarray, coupling: np.ndarray, dt: float, members: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """An ensemble of pure states with seeded jumps; its mean density is the filter's.

    Members start in the basis states in turn.  One uniform number per member decides on a
    jump and, stretched to the jump's share, on where it goes.
    """
    n = zs.shape[1]
    rng, psi, p, jumps = np.random.default_rng(seed), np.eye(n, dtype=complex)[np.arange(members) % n], [], []
    stay = 1.0 - DEPHASING
    for z in zs:
        psi = psi @ qutrit_unitary(z, coupling, dt).T
        draw = rng.random(members)
        jump = draw >= stay
        born = np.abs(psi[jump]) ** 2
        edge = np.cumsum(born / born.sum(axis=1, keepdims=True), axis=1)
        psi[jump] = np.eye(n)[np.minimum((edge < ((draw[jump] - stay) / DEPHASING)[:, None]).sum(axis=1), n - 1)]
        psi /= np.linalg.norm(psi, axis=1, keepdims=True)
        p.append((np.abs(psi) ** 2).mean(axis=0))
        jumps.append(int(jump.sum()))
    return np.array(p).reshape(-1, n), np.array(jumps, dtype=np.int64)


def _on_axes(state: np.ndarray, gate: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    """Apply a gate of shape (2,)*2k to k axes of a state tensor."""
    k = len(axes)
    return np.moveaxis(np.tensordot(gate, state, axes=(tuple(range(k, 2 * k)), axes)), tuple(range(k)), axes)


def _ry(a: float) -> np.ndarray:
    return np.array([[math.cos(a / 2), -math.sin(a / 2)], [math.sin(a / 2), math.cos(a / 2)]], dtype=complex)


def _rz(a: float) -> np.ndarray:
    return np.diag([np.exp(-0.5j * a), np.exp(0.5j * a)])


_CNOT = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]], dtype=complex).reshape(2, 2, 2, 2)


def _rzz(a: float) -> np.ndarray:
    return np.diag(np.exp(-0.5j * a * np.array([1, -1, -1, 1]))).reshape(2, 2, 2, 2)


def _rzx(a: float) -> np.ndarray:
    x = np.array([[0, 1], [1, 0]])
    return (math.cos(a / 2) * np.eye(4) - 1j * math.sin(a / 2) * np.kron(np.diag([1, -1]), x)).reshape(2, 2, 2, 2)


def pauli_z(state: np.ndarray) -> np.ndarray:
    """<Z> of each qubit, <ZZ> of each neighbour pair on the ring, and the parity."""
    n = state.ndim
    p = np.abs(state) ** 2
    sign = [np.array([1.0, -1.0]).reshape([2 if a == q else 1 for a in range(n)]) for q in range(n)]
    one = [float((p * s).sum()) for s in sign]
    two = [float((p * sign[q] * sign[(q + 1) % n]).sum()) for q in range(n)]
    return np.array([*one, *two, float((p * math.prod(sign)).sum())])


def reservoir(zs: np.ndarray, seed: int, layers: int = 3) -> np.ndarray:
    """Observables of a fixed random circuit into which every row is loaded three times."""
    n = zs.shape[1]
    rng = np.random.default_rng(seed)
    wt, bt = rng.normal(0, THETA_SPREAD, (layers, n, n)), rng.uniform(-math.pi, math.pi, (layers, n))
    wp, bp = rng.normal(0, PHI_SPREAD, (layers, n, n)), rng.uniform(-math.pi, math.pi, (layers, n))
    ring = rng.uniform(-RING_SPREAD, RING_SPREAD, (layers, n))
    state = np.zeros((2,) * n, dtype=complex)
    state[(0,) * n] = 1
    out = []
    for z in zs:
        for l in range(layers):
            theta, phi = LOAD * np.tanh(wt[l] @ z + bt[l]), LOAD * np.tanh(wp[l] @ z + bp[l])
            for q in range(n):
                state = _on_axes(state, _rz(phi[q]) @ _ry(theta[q]), (q,))
            for q in range(n if n > 2 else n - 1):
                state = _on_axes(state, _rzz(ring[l, q]), (q, (q + 1) % n))
            for q in range(n if n > 2 else n - 1):
                state = _on_axes(state, _CNOT, (q, (q + 1) % n))
        out.append(pauli_z(state))
    return np.array(out).reshape(-1, 2 * n + 1)


def encode(z: np.ndarray, coupling: np.ndarray, dt: float) -> np.ndarray:
    """State vector of one row: local rotations, then noncommuting neighbour gates."""
    n = len(z)
    z = np.clip(z, -3, 3)
    c = np.clip(coupling * dt * dt, -3, 3)
    state = np.full((2,) * n, 2.0 ** (-n / 2), dtype=complex)
    for q in range(n):
        state = _on_axes(state, _rz(TURN_Z * z[q]) @ _ry(TURN_Y * math.tanh(z[q])), (q,))
    for q in range(n - 1):
        even, odd = (c[q, q + 1] + c[q + 1, q]) / 2, (c[q, q + 1] - c[q + 1, q]) / 2
        state = _on_axes(state, _rzz(EVEN_Z * math.tanh(z[q] * z[q + 1]) + EVEN_C * math.tanh(even)), (q, q + 1))
        state = _on_axes(state, _rzx(ODD_Z * math.tanh(z[q] - z[q + 1]) + ODD_C * math.tanh(odd)), (q, q + 1))
    return state.reshape(-1)


def fidelity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a.conj() @ b.T) ** 2


def nystroem(to_landmarks: np.ndarray, landmarks: np.ndarray, floor: float = 1e-10) -> np.ndarray:
    e, v = np.linalg.eigh((landmarks + landmarks.T) / 2)
    return to_landmarks @ (v / np.sqrt(np.maximum(e, floor))) @ v.T


def kraus(z: np.ndarray, coupling: np.ndarray, dt: float) -> np.ndarray:
    """Operators of the channel without selection: dephasing x instrument x unitary."""
    n = len(z)
    u = qutrit_unitary(z, coupling, dt)
    dephase = [math.sqrt(1 - DEPHASING) * np.ones(n), *(math.sqrt(DEPHASING) * np.eye(n))]
    return np.array([(d * k)[:, None] * u for d in dephase for k in instrument(z)])


def channel_checks(ops: np.ndarray) -> dict[str, float]:
    """Choi matrix from the vectorised operators: positivity, trace, and the map's radius."""
    n = ops.shape[1]
    vec = ops.transpose(0, 2, 1).reshape(len(ops), n * n)
    choi = vec.T @ vec.conj()
    kept = np.einsum("kai,kaj->ij", ops.conj(), ops)
    transfer = np.einsum("kab,kcd->acbd", ops, ops.conj()).reshape(n * n, n * n)
    return {"min_eigenvalue": float(np.linalg.eigvalsh((choi + choi.conj().T) / 2)[0]), "trace_error": float(np.abs(kept - np.eye(n)).max()), "radius": float(np.abs(np.linalg.eigvals(transfer)).max())}


def _exchange() -> np.ndarray:
    """Nearest-neighbour exchange of two qutrits: sum of |ab><ba| over neighbouring levels."""
    s = np.zeros((3, 3))
    s[0, 1] = s[1, 2] = 1.0
    h = np.kron(s, s.T)
    return h + h.T


_DRIVE = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]]) / math.sqrt(2)
_LEVEL = np.diag([-1.0, 0.0, 1.0])


def _split(theta: np.ndarray, chi: int) -> tuple[np.ndarray, np.ndarray, float]:
    l, a, b, r = theta.shape
    u, s, v = np.linalg.svd(theta.reshape(l * a, b * r), full_matrices=False)
    keep = max(1, min(chi, int((s > s[0] * 1e-10).sum())))
    lost = float((s[keep:] ** 2).sum() / (s**2).sum())
    s = s[:keep] / np.linalg.norm(s[:keep])
    return u[:, :keep].reshape(l, a, keep), (s[:, None] * v[:keep]).reshape(keep, b, r), lost


def tensor_chain(zs: np.ndarray, coupling: np.ndarray, dt: float, chi: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A chain of qutrits by second-order splitting with truncated bonds and seeded local
    projections; activity of each site (1 - its middle level) and weight lost, per row.

    The orthogonality centre is swept along with the gates, so every truncation is optimal
    and local probabilities are read off the centre.
    """
    n = zs.shape[1]
    rng = np.random.default_rng(seed)
    sites = [np.full((1, 3, 1), 3**-0.5, dtype=complex) for _ in range(n)]
    angle = [float(np.clip(EXCHANGE * (coupling[q, q + 1] + coupling[q + 1, q]) / 2 * dt * dt, -MOST_ANGLE, MOST_ANGLE)) for q in range(n - 1)]
    swap = _exchange()
    gate = {(q, f): evolution(swap * angle[q] * f).reshape(3, 3, 3, 3) for q in range(n - 1) for f in (0.5, 1.0)}
    activity, lost = [], []

    def sweep(gates: dict[int, np.ndarray]) -> float:
        """Left to right with the given bond gates, then back to the left by QR."""
        total = 0.0
        for q in range(n - 1):
            theta = np.tensordot(sites[q], sites[q + 1], axes=(2, 0))
            if q in gates:
                theta = np.einsum("ABab,labr->lABr", gates[q], theta)
            sites[q], sites[q + 1], x = _split(theta, chi)
            total += x
        for q in range(n - 1, 0, -1):
            l, a, r = sites[q].shape
            o, t = np.linalg.qr(sites[q].reshape(l, a * r).T)
            sites[q] = o.T.reshape(-1, a, r)
            sites[q - 1] = np.tensordot(sites[q - 1], t.T, axes=(2, 0))
        return total

    for z in zs:
        local = [evolution((SITE_PHASE * x * _LEVEL + SITE_DRIVE * _DRIVE) / 2) for x in z]
        turn = lambda: [np.einsum("ab,lbr->lar", g, s) for g, s in zip(local, sites)]
        sites[:] = turn()
        x = sum(sweep({q: gate[q, f] for q in range(start, n - 1, 2)}) for start, f in ((0, 0.5), (1, 1.0), (0, 0.5)))
        sites[:] = turn()
        row = []
        for q in range(n):  # the centre walks to the right
            p = (np.abs(sites[q]) ** 2).sum(axis=(0, 2))
            p = p / p.sum()
            if rng.random() < SITE_DEPHASING:
                level = int(rng.choice(3, p=p))
                mask = np.zeros((1, 3, 1))
                mask[0, level] = 1
                sites[q] = sites[q] * mask
                p = mask[0, :, 0]
            sites[q] = sites[q] / np.linalg.norm(sites[q])
            row.append(1.0 - p[1])
            if q < n - 1:
                l, a, r = sites[q].shape
                o, t = np.linalg.qr(sites[q].reshape(l * a, r))
                sites[q], sites[q + 1] = o.reshape(l, a, -1), np.tensordot(t, sites[q + 1], axes=(1, 0))
        for q in range(n - 1, 0, -1):
            l, a, r = sites[q].shape
            o, t = np.linalg.qr(sites[q].reshape(l, a * r).T)
            sites[q] = o.T.reshape(-1, a, r)
            sites[q - 1] = np.tensordot(sites[q - 1], t.T, axes=(2, 0))
        activity.append(np.array(row) / max(sum(row), 1e-300))
        lost.append(x)
    return np.array(activity).reshape(-1, n), np.array(lost)
