"""Small numerical helpers on numpy arrays: integrals, least squares on a box or a simplex."""

from __future__ import annotations

from itertools import product

import numpy as np

_X, _W = np.polynomial.legendre.leggauss(16)


def urgency_integral(t, total, start_local, epsilon=0.08, power=1.6, amplitude=0.3, peak=21.0, floor=0.05, panels=16) -> np.ndarray:
    """Integral from 0 to t of availability times urgency, by composite Gauss-Legendre; all arguments are arrays of one length."""
    t, total, start_local = (np.asarray(a, float)[:, None, None] for a in (t, total, start_local))
    edge = np.arange(panels)[None, :, None] / panels
    s = t * (edge + (_X + 1)[None, None, :] / (2 * panels))
    a = np.maximum(1 + amplitude * np.cos(2 * np.pi * (s + start_local - peak) / 24), floor)
    u = (epsilon / (np.clip((total - s) / total, 0, 1) + epsilon)) ** power
    return ((a * u * _W).sum((1, 2)) * t[:, 0, 0] / (2 * panels))


def simplex_least_squares(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """argmin of m'Gm - 2 m'b over m >= 0, sum m = 1, exactly: the best feasible of the solutions on all supports (six unknowns at most)."""
    n = len(moment)
    best, value = np.full(n, 1 / n), np.inf
    for support in product((False, True), repeat=n):
        s = np.flatnonzero(support)
        if not len(s):
            continue
        k = len(s)
        a = np.zeros((k + 1, k + 1))
        a[:k, :k], a[:k, k], a[k, :k] = gram[np.ix_(s, s)], 1, 1
        x = np.linalg.lstsq(a, np.append(moment[s], 1), rcond=1e-13)[0][:k]
        if (x < -1e-10).any() or not np.isfinite(x).all():
            continue
        m = np.zeros(n)
        m[s] = np.maximum(x, 0)
        m /= m.sum() or 1
        if (v := m @ gram @ m - 2 * m @ moment) < value - 1e-15:
            best, value = m, v
    return best


#: For one to four unknowns: which are free (0), at the lower (1) or at the upper bound (2); those with few bounds first.
_STATES = {n: [np.array(s) for s in sorted(product((0, 1, 2), repeat=n), key=lambda s: sum(map(bool, s)))] for n in range(1, 5)}


def box_least_squares(gram: np.ndarray, moment: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """argmin of x'Gx - 2 x'b over a box, exactly: the best feasible of the solutions with each unknown free or at a bound (four at most)."""
    n = len(moment)
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g, b, lo, hi = gram / scale[:, None] / scale, moment / scale, lower * scale, upper * scale
    best, value = np.clip(np.zeros(n), lo, hi), np.inf
    for state in _STATES[n]:
        x = np.where(state == 1, lo, np.where(state == 2, hi, 0.0))
        f = np.flatnonzero(state == 0)
        if len(f):
            x[f] = np.linalg.lstsq(g[np.ix_(f, f)], b[f] - g[f] @ x, rcond=1e-13)[0]
            if (x[f] < lo[f] - 1e-9).any() or (x[f] > hi[f] + 1e-9).any():
                continue
            x[f] = np.clip(x[f], lo[f], hi[f])
        slope = g @ x - b
        if ((state != 1) | (slope >= -1e-12)).all() and ((state != 2) | (slope <= 1e-12)).all():
            return x / scale  # no bound pulls the wrong way: this is the minimum
        if (v := x @ g @ x - 2 * x @ b) < value:
            best, value = x, v
    return best / scale


def box_least_squares_many(gram: np.ndarray, moment: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """box_least_squares of many problems at once, gram (m, n, n), the others (m, n): for each set of unknowns at bounds one stacked solution."""
    scale = np.sqrt(np.maximum(np.einsum("mii->mi", gram), 1e-300))
    g, b, lo, hi = gram / scale[:, :, None] / scale[:, None, :], moment / scale, lower * scale, upper * scale
    best, value, inverse = np.clip(np.zeros_like(b), lo, hi), np.full(len(b), np.inf), {}
    for state in _STATES[b.shape[1]]:
        x, ok, f = np.where(state == 1, lo, np.where(state == 2, hi, 0.0)), True, np.flatnonzero(state == 0)
        if len(f):
            if (key := tuple(f)) not in inverse:
                inverse[key] = np.linalg.pinv(g[:, f[:, None], f], rcond=1e-13, hermitian=True)
            y = np.einsum("mij,mj->mi", inverse[key], b[:, f] - np.einsum("mij,mj->mi", g[:, f], x))
            ok = ((y >= lo[:, f] - 1e-9) & (y <= hi[:, f] + 1e-9)).all(1)
            x[:, f] = np.clip(y, lo[:, f], hi[:, f])
        v = np.einsum("mi,mij,mj->m", x, g, x) - 2 * (x * b).sum(1)
        better = ok & (v < value)
        best[better], value[better] = x[better], v[better]
    return best / scale


def profiled_loss(w: np.ndarray, g: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Mean over series of 1 - max(w.b, 0)^2 / (w'Gw E), for each row of w; g (series, 3, 3), b (series, 3), e (series)."""
    fit = np.maximum(w @ b.T, 0) ** 2
    norm = np.einsum("ki,sij,kj->ks", w, g, w) * e
    return (1 - np.where(norm > 0, fit / np.where(norm > 0, norm, 1), 0)).mean(1)


def simplex_minimum(loss, rounds: int = 40, side: int = 24) -> np.ndarray:
    """Minimum of a function of three shares: a grid over the triangle, refined around its best point."""
    i, j = np.meshgrid(np.arange(side + 1), np.arange(side + 1), indexing="ij")
    grid = np.stack([i, j, side - i - j], -1).reshape(-1, 3)
    grid = grid[grid[:, 2] >= 0] / side
    best = grid[loss(grid).argmin()]
    step, ring = 1 / side, np.array([(a, b, -a - b) for a in (-1, -0.5, 0, 0.5, 1) for b in (-1, -0.5, 0, 0.5, 1)])
    for _ in range(rounds):
        near = np.clip(best + step * ring, 0, 1)
        near = near / near.sum(1, keepdims=True)
        best = near[loss(near).argmin()]
        step *= 0.65
    return best


def skeleton(t: np.ndarray, p: np.ndarray, total: float) -> np.ndarray:
    """The growth curve without its floor at 0: base + a t + b t^2 + rise of the last p[4] hours."""
    return p[0] + p[1] * t + p[2] * t * t + p[3] * rise(t, p[4], total)


def rise(t: np.ndarray, panic: float, total: float) -> np.ndarray:
    begin = total - panic
    n = np.clip((t - begin) / panic, 0, 1)
    shape = np.where(t > begin, np.sin(n * np.pi / 2) ** 2.5 * np.clip((n - 0.5) / 0.5, 0, 1) ** 3, 0)
    return shape * np.clip((t - (begin - 4)) / max(1e-6, panic / 2 + 4), 0, 1)


#: The bounds of base, a, b and the final rise.
SKELETON_LOWER, SKELETON_UPPER = np.array([0, -0.01, -0.001, 0.0]), np.array([1, 0.01, 0.001, 10.0])


def fit_skeleton(t: np.ndarray, y: np.ndarray, total: float) -> tuple[np.ndarray, float]:
    """Bounded least squares of the growth curve of one series held in memory, the measure of the fit from sums: for each length of the final rise the rest is linear; lengths by a grid, then by golden section."""
    hi = min(72.0, total / 2)

    def at(panic: float):
        x = np.stack([np.ones_like(t), t, t * t, rise(t, panic, total)], 1)
        p = box_least_squares(x.T @ x, x.T @ y, SKELETON_LOWER, SKELETON_UPPER)
        return float(((y - np.maximum(x @ p, 0)) ** 2).mean()), p

    if hi <= 6:
        v, p = at(6.0)
        return np.append(p, 6.0), v
    grid = np.linspace(6, hi, 13)
    values = [at(g)[0] for g in grid]
    k = int(np.argmin(values))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    r = (np.sqrt(5) - 1) / 2
    for _ in range(12):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if at(c)[0] < at(d)[0] else (c, b)
    panic = float((a + b) / 2) if at((a + b) / 2)[0] <= values[k] else float(grid[k])
    v, p = at(panic)
    return np.append(p, panic), v
