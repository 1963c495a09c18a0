"""Convolutional sparse coding of one trial: arrays x (P, T), atoms D (K, P, L), codes z (K, T - L + 1)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def gram(d: np.ndarray) -> np.ndarray:
    """(K, K, 2L - 1): correlation of every pair of atoms, lag 0 in the middle."""
    k, _, length = d.shape
    out = np.zeros((k, k, 2 * length - 1))
    for lag in range(length):
        out[:, :, length - 1 + lag] = np.einsum("kpl,jpl->kj", d[:, :, : length - lag], d[:, :, lag:])
        out[:, :, length - 1 - lag] = out[:, :, length - 1 + lag].T
    return out


def correlate(x: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(K, T - L + 1): each atom against each full patch."""
    patches = np.lib.stride_tricks.sliding_window_view(x, d.shape[2], axis=1)
    return np.einsum("ptl,kpl->kt", patches, d, optimize=True)


def reconstruct(z: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(P, T)."""
    _, channels, length = d.shape
    out = np.zeros((channels, z.shape[1] + length - 1))
    if np.count_nonzero(z) < 0.01 * z.size:  # few activations: add the atoms one by one
        for k, t in zip(*np.nonzero(z), strict=True):
            out[:, t : t + length] += z[k, t] * d[k]
        return out
    for lag in range(length):
        out[:, lag : lag + z.shape[1]] += d[:, :, lag].T @ z
    return out


def statistics(z: np.ndarray, x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ztz (K, K, 2L - 1), ztX (K, P, L)) of one trial, by the activations only."""
    k, n = z.shape
    ztz = np.zeros((k, k, 2 * length - 1))
    for lag in range(min(length, n)):
        part = z[:, : n - lag] @ z[:, lag:].T
        ztz[:, :, length - 1 + lag] = part
        ztz[:, :, length - 1 - lag] = part.T
    ztx = np.zeros((k, x.shape[0], length))
    for i, t in zip(*np.nonzero(z), strict=True):
        ztx[i] += z[i, t] * x[:, t : t + length]
    return ztz, ztx


def cost(x: np.ndarray, z: np.ndarray, d: np.ndarray, reg: np.ndarray | float, w: np.ndarray | None = None) -> float:
    r = x - reconstruct(z, d)
    return float(0.5 * np.sum(r * r if w is None else w * r * r) + np.sum(np.asarray(reg).reshape(-1, 1) * np.abs(z)))


def gradient(x: np.ndarray, z: np.ndarray, d: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Gradient of the fit in z."""
    r = reconstruct(z, d) - x
    return correlate(r if w is None else w * r, d)


def gram_gradient(x: np.ndarray, d: np.ndarray, dtd: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """``gradient`` as a function of the codes, without the channels: the Gram matrix against the codes around each place."""
    k, _, length = d.shape
    n = x.shape[1] - length + 1
    of_signal, taps = correlate(x, d), np.ascontiguousarray(dtd[:, :, ::-1]).reshape(k, -1)
    padded = np.zeros((k, n + 2 * length - 2))
    around = np.lib.stride_tricks.sliding_window_view(padded, n, axis=1)

    def slope(z: np.ndarray) -> np.ndarray:
        padded[:, length - 1 : length - 1 + n] = z
        return taps @ around.reshape(-1, n) - of_signal

    return slope


def shrink(v: np.ndarray, by, positive: bool) -> np.ndarray:
    return np.maximum(v - by, 0) if positive else np.sign(v) * np.maximum(np.abs(v) - by, 0)


def lgcd(x: np.ndarray, d: np.ndarray, reg, z0: np.ndarray | None = None, tol: float = 1e-3, max_iter: int = 100_000, positive: bool = True, frozen: bool = False, strategy: str = "greedy", n_seg: int | None = None, seed: int = 0, dtd: np.ndarray | None = None) -> np.ndarray:
    """Locally greedy coordinate descent: the best coordinate of one segment at a time, segments in turn.

    Segments without a move larger than the tolerance sleep until a neighbour's move reaches into them. "random" and "cyclic"
    take a coordinate of the whole signal instead.
    """
    k, _, length = d.shape
    n = x.shape[1] - length + 1
    dtd = gram(d) if dtd is None else dtd
    reg = np.broadcast_to(np.asarray(reg, dtype=float).reshape(-1, 1), (k, 1))
    norm = dtd[np.arange(k), np.arange(k), length - 1].reshape(-1, 1)
    norm = np.where(norm > 0, norm, 1.0)
    z = np.zeros((k, n)) if z0 is None else np.array(z0, dtype=float)
    support = z != 0 if frozen else None
    beta = gradient(x, z, d) - z * norm
    tol = tol * float(x.std())

    def move(lo: int, hi: int) -> np.ndarray:
        out = shrink(-beta[:, lo:hi], reg, positive) / norm - z[:, lo:hi]
        return out if support is None else np.where(support[:, lo:hi], out, 0.0)

    def update(k0: int, t0: int, step: float) -> tuple[int, int]:
        lo, hi = max(0, t0 - length + 1), min(n, t0 + length)
        kept = beta[k0, t0]
        z[k0, t0] += step
        beta[:, lo:hi] += dtd[:, k0, lo - t0 + length - 1 : hi - t0 + length - 1] * step
        beta[k0, t0] = kept
        return lo, hi

    if strategy != "greedy":
        rng, quiet, i = np.random.RandomState(seed), 0, 0
        while quiet < k * n and i < max_iter * max(1, n // (2 * length - 1)):
            k0, t0 = divmod(int(rng.randint(k * n)) if strategy == "random" else i % (k * n), n)
            step = float(move(t0, t0 + 1)[k0, 0])
            i += 1
            if abs(step) > tol:
                update(k0, t0, step)
                quiet = 0
            else:
                quiet += 1
        return z
    width = 2 * length - 1 if n_seg is None else -(-n // n_seg)
    cuts = np.arange(0, n, width)
    awake = np.ones(len(cuts), dtype=bool)
    moves = move(0, n)
    left, s = max_iter * len(cuts), 0
    while awake.any() and left > 0:
        left -= 1
        if awake[s]:
            lo, hi = cuts[s], min(cuts[s] + width, n)
            part = np.abs(moves[:, lo:hi])
            k0, t0 = divmod(int(part.argmax()), hi - lo)
            t0 += int(lo)
            if part[k0, t0 - lo] > tol:
                a, b = update(k0, t0, float(moves[k0, t0]))
                moves[:, a:b] = move(a, b)
                moves[k0, t0] = 0.0
                awake[a // width : (b - 1) // width + 1] = True
            else:
                awake[s] = False
        s = (s + 1) % len(cuts)
    return z


def lipschitz(d: np.ndarray, w: np.ndarray | None, n: int, seed: int = 0, rounds: int = 200) -> float:
    """Largest eigenvalue of z -> D'(w * D z), by power iteration."""
    v = np.random.RandomState(seed).randn(d.shape[0], n)
    value = 0.0
    for _ in range(rounds):
        v /= np.linalg.norm(v)
        r = reconstruct(v, d)
        v = correlate(r if w is None else w * r, d)
        new = float(np.linalg.norm(v))
        if abs(new - value) <= 1e-6 * new:
            break
        value = new
    return max(new, 1e-12)


def lipschitz_weighted(d: np.ndarray, w: np.ndarray, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """``lipschitz`` of many rows of weights (B, T) at once, each stopped at its own round; trials are the last axis, so a lag is one product."""
    k, channels, length = d.shape
    many, times = w.shape
    n, by = times - length + 1, np.ascontiguousarray(w.T)
    v = np.repeat(np.random.RandomState(seed).randn(k, n)[:, :, None], many, axis=2)
    norm, value, found, open_ = np.sqrt(np.sum(v * v, axis=(0, 1))), np.zeros(many), np.zeros(many), np.ones(many, dtype=bool)
    for _ in range(rounds):
        v /= norm
        r = np.zeros((channels, times, many))
        for lag in range(length):
            r[:, lag : lag + n] += (d[:, :, lag].T @ v.reshape(k, -1)).reshape(channels, n, many)
        r *= by
        v = np.zeros((k, n, many))
        for lag in range(length):
            v += (d[:, :, lag] @ r[:, lag : lag + n].reshape(channels, -1)).reshape(v.shape)
        new = np.sqrt(np.sum(v * v, axis=(0, 1)))
        found[open_] = new[open_]
        open_ &= ~(np.abs(new - value) <= 1e-6 * new)
        if not open_.any():
            break
        value, norm = new, np.where(new > 0, new, 1.0)
    return np.maximum(found, 1e-12)


class GramOperator:
    """z -> D'(w * D z) over flat codes of K * valid values, the block-circulant matrix of the normal equations, never formed.

    ``@`` applies it to a vector or to the columns of a matrix; ``dense`` forms it, for small problems.
    """

    def __init__(self, d: np.ndarray, valid: int, w: np.ndarray | None = None) -> None:
        self.d, self.valid, self.w = d, valid, None if w is None else np.asarray(w).reshape(1, -1)
        if self.w is not None and self.w.shape[1] != valid + d.shape[2] - 1:
            raise ValueError(f"w has {self.w.shape[1]} samples, not {valid + d.shape[2] - 1}")
        self.shape = (len(d) * valid,) * 2

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        if v.ndim == 2:
            return np.stack([self @ c for c in v.T], axis=1)
        r = reconstruct(v.reshape(len(self.d), self.valid), self.d)
        return correlate(r if self.w is None else self.w * r, self.d).ravel()

    def dense(self) -> np.ndarray:
        return self @ np.eye(self.shape[0])


def bound_step(d: np.ndarray, n: int, w: np.ndarray | None = None) -> float | np.ndarray:
    """A step of n places, by the curvature without weights over the largest weight; one for each row of weights (B, T)."""
    step = 0.99 / lipschitz(d, None, n)
    return step if w is None else step / largest_weights(w)


def largest_weights(w: np.ndarray) -> np.ndarray:
    """Of each row; 1 where all are zero."""
    top = w.max(axis=1)
    return np.where(top > 0, top, 1.0)


def proximal(x, d, reg, z0=None, tol: float = 1e-4, max_iter: int = 15_000, positive: bool = True, frozen: bool = False, momentum: bool = True, w=None, fixed_steps: int | None = None, restart: bool = False, adaptive: bool = False, step: float | str | None = None, dtd: np.ndarray | None = None) -> np.ndarray:
    """ISTA or FISTA with a fixed step, by default by the largest curvature; ``fixed_steps`` runs exactly so many iterations.

    A step "bound" is by a bound of that curvature, which takes no search of its own for each row of weights. ``adaptive`` doubles and halves the step as it goes. With no more atoms than channels and the Gram matrix ``dtd`` the gradient is taken from
    it and from one correlation with the signal.
    """
    slope = gram_gradient(x, d, dtd) if dtd is not None and w is None and len(d) <= len(x) else lambda y: gradient(x, y, d, w)
    n = x.shape[1] - d.shape[2] + 1
    z = np.zeros((d.shape[0], n)) if z0 is None else np.array(z0, dtype=float)
    support = z != 0 if frozen else None
    reg = np.asarray(reg, dtype=float).reshape(-1, 1)
    if step == "bound":
        step = float(np.min(bound_step(d, n, w)))
    step = step or (1.0 if adaptive else 0.99 / lipschitz(d, w, n))
    y, a = z.copy(), 1.0

    def moved(g: np.ndarray) -> np.ndarray:
        out = shrink(y - step * g, step * reg, positive)
        return out if support is None else np.where(support, out, 0.0)

    for _ in range(max_iter if fixed_steps is None else fixed_steps):
        g = slope(y)
        if adaptive:  # the longest step of 2s, s, s / 2 and so on under which the quadratic bound holds
            here, step = cost(x, y, d, 0.0, w), 2 * step
            while True:
                new = moved(g)
                by = new - y
                if step < 1e-18 or cost(x, new, d, 0.0, w) <= here + np.sum(g * by) + np.sum(by * by) / (2 * step) + 1e-12 * abs(here):
                    break
                step /= 2
        else:
            new = moved(g)
        change = new - z
        if momentum:
            if restart and np.sum((y - new) * change) > 0:
                a = 1.0
            b = (1 + np.sqrt(1 + 4 * a * a)) / 2
            y, a = new + (a - 1) / b * change, b
        else:
            y = new
        z = new
        if fixed_steps is None and np.abs(change).max(initial=0.0) <= tol * max(1e-12, np.abs(z).max(initial=0.0)):
            break
    return z


#: Entries of the matrix of all shifts of the atoms up to which trials are solved many at a time, and codes that are solved at once.
DENSE, ABREAST = 1 << 20, 1 << 15


def shifts(d: np.ndarray, n: int) -> np.ndarray:
    """(P * T, K * n): the reconstruction of n places as one matrix."""
    k, channels, length = d.shape
    out = np.zeros((channels, n + length - 1, k, n))
    for t in range(n):
        out[:, t : t + length, :, t] = d.transpose(1, 2, 0)
    return out.reshape(-1, k * n)


def proximal_many(x: np.ndarray, d: np.ndarray, reg, w: np.ndarray, z0: np.ndarray | None = None, tol: float = 1e-4, max_iter: int = 15_000, positive: bool = True, frozen: bool = False, momentum: bool = True, fixed_steps: int | None = None, restart: bool = False, step: float | str | np.ndarray | None = None) -> np.ndarray:
    """``proximal`` of many short trials x (B, P, T) with weights w (B, T) side by side: (B, K, T - L + 1), each trial stopped at its own round.

    A step may be given for all trials or for each.
    """
    many, channels, times = x.shape
    k, n = d.shape[0], times - d.shape[2] + 1
    if step is None or isinstance(step, str):
        step = 0.99 / lipschitz_weighted(d, w) if step is None else bound_step(d, n, w)
    step = np.broadcast_to(np.asarray(step, dtype=float), (many,))
    whole = shifts(d, n)
    turned, level = np.ascontiguousarray(whole.T), np.repeat(np.broadcast_to(np.asarray(reg, dtype=float).reshape(-1, 1), (k, 1)), n, axis=1).reshape(-1, 1)
    out, few = np.zeros((k * n, many)), max(1, ABREAST // (k * n))
    if z0 is not None:
        out[:] = z0.reshape(many, -1).T
    for start in range(0, many, few):
        at = np.arange(start, min(start + few, many))
        z, by = out[:, at], step[at]
        support = z != 0 if frozen else None
        weight = np.tile(w[at].T, (channels, 1))
        signal, y, a, open_ = weight * x[at].reshape(len(at), -1).T, z.copy(), np.ones(len(at)), np.ones(len(at), dtype=bool)
        for _ in range(max_iter if fixed_steps is None else fixed_steps):
            r = whole @ y
            r *= weight
            r -= signal
            new = shrink(y - by * (turned @ r), by * level, positive)
            if support is not None:
                new *= support
            change = new - z
            if momentum:
                if restart:
                    a = np.where(np.sum((y - new) * change, axis=0) > 0, 1.0, a)
                b = (1 + np.sqrt(1 + 4 * a * a)) / 2
                y, a = new + (a - 1) / b * change, b
            else:
                y = new
            z = new
            if fixed_steps is not None:
                continue
            done = open_ & (np.abs(change).max(axis=0, initial=0.0) <= tol * np.maximum(1e-12, np.abs(z).max(axis=0, initial=0.0)))
            if done.any():
                out[:, at[done]] = z[:, done]
                open_ &= ~done
                if not open_.any():
                    break
                if np.count_nonzero(open_) < 0.8 * len(open_):  # columns that are done are carried along until they are many
                    z, y, weight, signal = (v[:, open_] for v in (z, y, weight, signal))
                    support = support if support is None else support[:, open_]
                    at, by, a, open_ = at[open_], by[open_], a[open_], open_[open_]
        out[:, at[open_]] = z[:, open_]
    return np.ascontiguousarray(out.T).reshape(many, k, n)


def lbfgs(x, d, reg, z0=None, tol: float = 1e-5, max_iter: int = 500, frozen: bool = False, w=None, memory: int = 10) -> np.ndarray:
    """Projected L-BFGS for z >= 0: the two-loop direction on free coordinates, backtracking along the projection."""
    n = x.shape[1] - d.shape[2] + 1
    shape = (d.shape[0], n)
    z = np.zeros(shape) if z0 is None else np.maximum(np.array(z0, dtype=float), 0)
    upper = np.where(z != 0, np.inf, 0.0) if frozen else np.full(shape, np.inf)
    reg = np.broadcast_to(np.asarray(reg, dtype=float).reshape(-1, 1), shape)

    def value(z):
        return cost(x, z, d, reg[:, 0], w)

    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    f, g = value(z), gradient(x, z, d, w) + reg
    for _ in range(max_iter):
        free = ~(((z <= 0) & (g > 0)) | ((z >= upper) & (g < 0)))
        pg = np.where(free, g, 0.0)
        if np.abs(pg).max(initial=0.0) <= tol:
            break
        q, alphas = pg.copy(), []
        for s, y in reversed(pairs):
            rho = 1 / float(np.sum(s * y))
            alphas.append((rho, float(rho * np.sum(s * q))))
            q -= alphas[-1][1] * y
        if pairs:
            s, y = pairs[-1]
            q *= float(np.sum(s * y) / np.sum(y * y))
        for (s, y), (rho, alpha) in zip(pairs, reversed(alphas), strict=True):
            q += s * (alpha - rho * float(np.sum(y * q)))
        direction = np.where(free, -q, 0.0)
        if np.sum(direction * pg) >= 0:
            direction, pairs = -pg, []
        step = 1.0
        while step > 1e-14:
            new = np.clip(z + step * direction, 0, upper)
            f_new = value(new)
            if f_new <= f + 1e-4 * float(np.sum(g * (new - z))):
                break
            step /= 2
        else:
            break
        g_new = gradient(x, new, d, w) + reg
        s, y = new - z, g_new - g
        if np.sum(s * y) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        done = f - f_new <= 1e-12 * max(1.0, abs(f))
        z, f, g = new, f_new, g_new
        if done:
            break
    return z


SOLVERS = ("lgcd", "ista", "fista", "l-bfgs")


def encode(x, d, reg, z0=None, solver: str = "lgcd", positive: bool = True, frozen: bool = False, w=None, dtd=None, **options) -> np.ndarray:
    """z of one trial by any solver."""
    if solver == "lgcd":
        if w is not None:
            raise ValueError("lgcd takes no sample weights; use l-bfgs, ista or fista")
        return lgcd(x, d, reg, z0, positive=positive, frozen=frozen, dtd=dtd, **options)
    if solver in ("ista", "fista"):
        return proximal(x, d, reg, z0, positive=positive, frozen=frozen, momentum=solver == "fista", w=w, dtd=dtd, **options)
    if solver in ("l-bfgs", "l_bfgs"):
        if not positive:
            raise ValueError("l-bfgs codes are positive; use lgcd, ista or fista")
        return lbfgs(x, d, reg, z0, frozen=frozen, w=w, **options)
    raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, not {solver!r}")
