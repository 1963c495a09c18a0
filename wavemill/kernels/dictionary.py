"""Dictionary steps on sufficient statistics: all arrays are as small as the dictionary."""

from __future__ import annotations

import numpy as np


def split(uv: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray]:
    return uv[:, :channels], uv[:, channels:]


def full(uv: np.ndarray, channels: int) -> np.ndarray:
    u, v = split(uv, channels)
    return u[:, :, None] * v[:, None, :]


def rank1(d: np.ndarray) -> np.ndarray:
    """uv of the best rank-1 atoms, signs fixed by the peak of v."""
    left, s, right = np.linalg.svd(d, full_matrices=False)
    return flip(np.concatenate([left[:, :, 0] * s[:, :1], right[:, 0, :]], axis=1), d.shape[1])


def flip(uv: np.ndarray, channels: int) -> np.ndarray:
    _, v = split(uv, channels)
    peak = v[np.arange(len(v)), np.abs(v).argmax(axis=1)]
    return uv * np.where(peak < 0, -1.0, 1.0)[:, None]


def project_d(d: np.ndarray) -> np.ndarray:
    return d / np.maximum(1.0, np.sqrt((d * d).sum(axis=(1, 2), keepdims=True)))


def project_uv(uv: np.ndarray, channels: int, constraint: str = "separate") -> np.ndarray:
    if constraint == "joint":
        return uv / np.maximum(1.0, np.linalg.norm(uv, axis=1, keepdims=True))
    u, v = split(uv, channels)
    return np.concatenate([u / np.maximum(1.0, np.linalg.norm(u, axis=1, keepdims=True)), v / np.maximum(1.0, np.linalg.norm(v, axis=1, keepdims=True))], axis=1)


def tukey(length: int, alpha: float = 0.5) -> np.ndarray:
    t = np.arange(length, dtype=float)
    edge = alpha * (length - 1) / 2
    out = np.ones(length)
    if edge > 0:
        up, down = t < edge, t > (length - 1) - edge
        out[up] = 0.5 * (1 + np.cos(np.pi * (t[up] / edge - 1)))
        out[down] = 0.5 * (1 + np.cos(np.pi * ((length - 1 - t[down]) / edge - 1)))
    out[[0, -1]] = 1e-9
    return out


def apply_ztz(ztz: np.ndarray, d: np.ndarray) -> np.ndarray:
    """ztz * D, (K, P, L)."""
    length = d.shape[2]
    out = np.zeros_like(d)
    for m in range(length):  # sample m of the other atom lands at l = m + lag
        out += np.einsum("kjl,jp->kpl", ztz[:, :, length - 1 - m : 2 * length - 1 - m], d[:, :, m])
    return out


def fit_cost(d: np.ndarray, ztz: np.ndarray, ztx: np.ndarray, xtx: float) -> float:
    return float(0.5 * np.sum(d * apply_ztz(ztz, d)) - np.sum(d * ztx) + 0.5 * xtx)


class Windower:
    """Multiplies the atoms' time courses by a Tukey window, and divides it out again; with ``on`` false it leaves them alone."""

    def __init__(self, on: bool, length: int, channels: int = 0) -> None:
        self.w = np.concatenate([np.ones(channels), tukey(length) if on else np.ones(length)])

    def apply(self, d: np.ndarray) -> np.ndarray:
        return d * self.w

    def remove(self, d: np.ndarray) -> np.ndarray:
        return np.where(self.w > 1e-6, d / self.w, 0.0)


def largest_eigenvalue(apply, shape: tuple[int, ...], seed: int = 0, rounds: int = 100) -> float:
    """Of a symmetric linear map, by power iteration."""
    v, value = np.random.RandomState(seed).randn(*shape), 0.0
    for _ in range(rounds):
        v = apply(v / max(float(np.linalg.norm(v)), 1e-300))
        new = float(np.linalg.norm(v))
        if abs(new - value) <= 1e-6 * new:
            break
        value = new
    return max(new, 1e-12)


def doubling_step(cost, value: float, x: np.ndarray, g: np.ndarray, prox, step: float, most: int = 30) -> tuple[np.ndarray, float, float]:
    """(point, its cost, step): the step is doubled while that lowers the cost further, or halved until it lowers it at all."""
    try_at = lambda s: (lambda new: (new, cost(new)))(prox(x - s * g))
    new, found = try_at(step)
    if found <= value:
        for _ in range(most):
            further, lower = try_at(2 * step)
            if lower >= found:
                break
            new, found, step = further, lower, 2 * step
        return new, found, step
    for _ in range(most):
        step /= 2
        new, found = try_at(step)
        if found <= value:
            return new, found, step
    return x, value, step


def descend(start: np.ndarray, cost, grad, prox, max_iter: int = 50, tol: float = 1e-8, momentum: bool = True, fixed_step: float | None = None, search: str = "bound") -> np.ndarray:
    """Projected gradient with momentum, and a restart whenever the cost would rise.

    Steps are halved until a quadratic bound holds ("bound") or doubled and halved by the cost ("doubling", without momentum), or fixed.
    """
    if search not in ("bound", "doubling"):
        raise ValueError(f"search must be bound or doubling, not {search!r}")
    x = prox(start)
    y, a, step, value = x.copy(), 1.0, fixed_step or 1.0, cost(x)
    if search == "doubling":
        for _ in range(max_iter):
            new, found, step = doubling_step(cost, value, x, grad(x), prox, step)
            done = value - found <= tol * max(abs(value), 1e-12)
            x, value = new, found
            if done:
                break
        return x
    for _ in range(max_iter):
        g, here = grad(y), cost(y)
        while True:
            new = prox(y - step * g)
            move = new - y
            if fixed_step or cost(new) <= here + np.sum(g * move) + np.sum(move * move) / (2 * step) + 1e-12 * abs(here) or step < 1e-18:
                break
            step /= 2
        found = cost(new)
        if found > value:
            if a == 1.0 and np.array_equal(y, x):
                break
            y, a = x.copy(), 1.0
            continue
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        y = new + (a - 1) / b * (new - x) if momentum else new
        a = b if momentum else 1.0
        done = value - found <= tol * max(abs(value), 1e-12)
        x, value, step = new, found, fixed_step or step * 2
        if done:
            break
    return x


def update_full(d, ztz, ztx, xtx, max_iter: int = 50, tol: float = 1e-8, momentum: bool = True, window: bool = False, search: str = "bound") -> np.ndarray:
    """Full-rank atoms (K, P, L) in the unit ball."""
    win = Windower(window, d.shape[2])
    cost = lambda e: fit_cost(win.apply(e), ztz, ztx, xtx)
    grad = lambda e: win.apply(apply_ztz(ztz, win.apply(e)) - ztx)
    prox = lambda e: project_d(win.apply(e)) / win.w
    return win.apply(descend(win.remove(d), cost, grad, prox, max_iter, tol, momentum, search=search))


def update_uv(uv, channels: int, ztz, ztx, xtx, solver: str = "alternate_adaptive", constraint: str = "separate", max_iter: int = 50, tol: float = 1e-8, window: bool = False) -> np.ndarray:
    """"joint" moves u and v together; "alternate", with a step of one over the largest curvature, and "alternate_adaptive" u, then v."""
    if solver not in ("joint", "alternate", "alternate_adaptive"):
        raise ValueError(f"solver_d must be joint, alternate or alternate_adaptive for rank-1 atoms, not {solver!r}")
    if solver != "joint" and constraint != "separate":
        raise ValueError("alternate solvers need uv_constraint='separate'")
    win = Windower(window, uv.shape[1] - channels, channels)

    def cost(x):
        return fit_cost(full(win.apply(x), channels), ztz, ztx, xtx)

    def pull(g, x):
        """The gradient g of the full atoms as one of u and v."""
        u, v = split(win.apply(x), channels)
        return win.apply(np.concatenate([np.einsum("kpl,kl->kp", g, v), np.einsum("kpl,kp->kl", g, u)], axis=1))

    def grad(x):
        return pull(apply_ztz(ztz, full(win.apply(x), channels)) - ztx, x)

    prox = lambda x: project_uv(win.apply(x), channels, constraint) / win.w
    x = prox(win.remove(uv))
    if solver == "joint":
        return win.apply(descend(x, cost, grad, prox, max_iter, tol))
    of_u = (np.arange(uv.shape[1]) < channels).astype(float)
    for mask in (of_u, 1 - of_u):
        fixed = x * (1 - mask)
        step = None
        if solver == "alternate":  # the cost is quadratic in either part
            curve = lambda y, m=mask, f=fixed: pull(apply_ztz(ztz, full(win.apply(y * m + f), channels)), y * m + f) * m
            step = 0.99 / largest_eigenvalue(curve, x.shape)
        x = descend(x, cost, lambda y, m=mask: grad(y) * m, lambda y, m=mask, f=fixed: prox(y) * m + f, max_iter, tol, momentum=False, fixed_step=step)
    return win.apply(x)


def unit_norm_dual(lhs: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """argmin of x'lhs x / 2 - rhs'x over the unit ball: one multiplier, found by bisection on the norm."""
    values, vectors = np.linalg.eigh(lhs)
    c = vectors.T @ rhs
    if values[0] > 1e-12 * max(values[-1], 1e-300) and np.linalg.norm(c / values) <= 1:
        return vectors @ (c / values)
    lo, hi = max(0.0, -values[0]), max(0.0, -values[0]) + float(np.linalg.norm(rhs)) + 1e-12
    for _ in range(200):
        mid = (lo + hi) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            size = np.linalg.norm(np.where(c == 0, 0.0, c / (values + mid)))
        lo, hi = (mid, hi) if size > 1 else (lo, mid)
    return vectors @ np.where(c == 0, 0.0, c / (values + hi))


def unit_norm_primal(lhs: np.ndarray, rhs: np.ndarray, start: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """The same by projected gradient."""
    x = np.zeros(len(rhs)) if start is None else start.copy()
    step = 1.0 / max(float(np.linalg.eigvalsh(lhs)[-1]), 1e-12)
    for _ in range(max_iter):
        new = x - step * (lhs @ x - rhs)
        new /= max(1.0, float(np.linalg.norm(new)))
        if np.abs(new - x).max() <= tol:
            return new
        x = new
    return x


def toeplitz_blocks(ztz: np.ndarray) -> np.ndarray:
    """(K, K, L, L) normal equations of the univariate atoms: block entry (l, m) is the lag l - m."""
    length = (ztz.shape[2] + 1) // 2
    at = length - 1 + np.arange(length)[:, None] - np.arange(length)[None, :]
    return ztz[:, :, at]


def update_block(d: np.ndarray, blocks: np.ndarray, ztx: np.ndarray, n_iter: int = 1, projection: str = "dual") -> np.ndarray:
    """Univariate atoms (K, L), one at a time in the unit ball."""
    d = d.copy()
    for _ in range(n_iter):
        for k in range(len(d)):
            rhs = ztx[k] - sum(blocks[k, j] @ d[j] for j in range(len(d)) if j != k)
            d[k] = unit_norm_dual(blocks[k, k], rhs) if projection == "dual" else unit_norm_primal(blocks[k, k], rhs, d[k])
    return d


def update_joint_dual(blocks: np.ndarray, ztx: np.ndarray, max_iter: int = 200, tol: float = 1e-9) -> np.ndarray:
    """All univariate atoms together: the normal equations with a multiplier for each norm.

    The dual is concave in the multipliers; projected Newton steps with backtracking climb it until its projected gradient vanishes.
    """
    k, _, length, _ = blocks.shape
    lhs, rhs = blocks.transpose(0, 2, 1, 3).reshape(k * length, k * length), ztx.reshape(-1)
    lhs = lhs + 1e-10 * max(float(np.trace(lhs)) / len(lhs), 1e-12) * np.eye(len(lhs))

    def dual(lam: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        m = lhs + np.diag(np.repeat(lam, length))
        d = np.linalg.solve(m, rhs)
        return -0.5 * float(rhs @ d) - 0.5 * float(lam.sum()), d.reshape(k, length), m

    lam = np.full(k, max(float(np.trace(lhs)) / len(lhs), 1e-12))
    value, d, m = dual(lam)
    for _ in range(max_iter):
        g = 0.5 * ((d * d).sum(axis=1) - 1)
        free = (lam > 0) | (g > 0)
        if np.abs(np.where(free, g, 0.0)).max(initial=0.0) <= tol:
            break
        sides = np.zeros((k * length, k))
        for i in range(k):
            sides[i * length : (i + 1) * length, i] = d[i]
        curve = (sides.T @ np.linalg.solve(m, sides))[np.ix_(free, free)]
        way = np.zeros(k)
        way[free] = np.linalg.solve(curve + 1e-14 * np.trace(curve) * np.eye(len(curve)), g[free])
        step = 1.0
        while step > 1e-12:
            new = np.maximum(lam + step * way, 0.0)
            higher, d_new, m_new = dual(new)
            if higher >= value + 1e-4 * float(g @ (new - lam)):
                break
            step /= 2
        else:
            break
        lam, value, d, m = new, higher, d_new, m_new
    return d / np.maximum(1.0, np.linalg.norm(d, axis=1, keepdims=True))


def assignment(loss: np.ndarray) -> np.ndarray:
    """For each row the column of the assignment of least total loss, rows not more than columns: shortest augmenting paths."""
    n, m = loss.shape
    row_price, column_price = np.zeros(n), np.zeros(m + 1)
    row_of = np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j = i, m
        dist, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, dtype=bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            reach = loss[r] - row_price[r] - column_price[:m]
            better = ~done[:m] & (reach < dist)
            dist[better], back[better] = reach[better], j
            at = np.where(done[:m], np.inf, dist)
            j = int(at.argmin())
            delta = at[j]
            row_price[row_of[done]] += delta
            column_price[done] -= delta
            dist[~done[:m]] -= delta
        while j != m:
            row_of[j], j = row_of[back[j]], back[j]
    out = np.zeros(n, dtype=int)
    out[row_of[:m][row_of[:m] >= 0]] = np.flatnonzero(row_of[:m] >= 0)
    return out


def recovery_score(v: np.ndarray, found: np.ndarray) -> float:
    """1 - largest cross-correlation, averaged over atoms under the best assignment; no fewer atoms are found than looked for."""
    loss = np.array([[1 - np.abs(np.correlate(a, b, "full")).max() / max(float(a @ a), 1e-300) for b in found] for a in v])
    return float(loss[np.arange(len(v)), assignment(loss)].mean())
