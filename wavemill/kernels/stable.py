"""Alpha-stable noise as a Gaussian of random scale.

Draws are counted, not streamed: a number is a hash of a seed, a trial, a time, a step and a stream, by multiplications and shifts of 32 bits that
other engines can do too. A chain gives the same weights however samples are dealt over tasks and batches.
"""

from __future__ import annotations

import numpy as np

#: The multipliers of the 32-bit mixer, both below 2**31 so that products fit in a signed 64-bit integer.
FIRST, SECOND = 0x21F0AAAD, 0x735A2D97
#: Streams of a step: the two numbers behind a proposal, and the one that decides about it.
ANGLE, HEIGHT, CHOICE = range(3)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers (held in 64)."""
    h = np.asarray(h, dtype=np.int64)
    h = ((h ^ (h >> 16)) * FIRST) & 0xFFFFFFFF
    h = ((h ^ (h >> 15)) * SECOND) & 0xFFFFFFFF
    return h ^ (h >> 15)


def key(seed: int, trial: np.ndarray | int, t: np.ndarray | int) -> np.ndarray:
    """What all draws of a sample begin with."""
    trial = np.asarray(trial, dtype=np.int64)
    h = mixed(np.int64(seed & 0xFFFFFFFF))
    for part in (trial, trial >> 32, np.asarray(t, dtype=np.int64)):
        h = mixed((h + (part & 0xFFFFFFFF)) & 0xFFFFFFFF)
    return h


def drawn(key: np.ndarray, step: int, stream: int) -> np.ndarray:
    """Numbers between 0 and 1."""
    return (mixed((key + 3 * step + stream) & 0xFFFFFFFF) + 0.5) / 2.0**32


def positive_stable(alpha: float, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Totally skewed stable variables of index alpha < 1 with Laplace transform exp(-s**alpha), of two uniform numbers each (Chambers, Mallows, Stuck)."""
    angle, height = np.pi * u, -np.log(w)
    return np.sin(alpha * angle) / np.sin(angle) ** (1 / alpha) * (np.sin((1 - alpha) * angle) / height) ** ((1 - alpha) / alpha)


def expected_precision(r: np.ndarray, alpha: float, n_iter: int, n_burnin: int, seed: int, trial: np.ndarray | int = 0, t: np.ndarray | None = None, start: np.ndarray | float = 2.0, state: bool = False):
    """Mean of 1 / Phi after burn-in for each residual, by independence Metropolis-Hastings with the prior as proposal; with ``state`` the last Phi too.

    Phi is such that sqrt(Phi) times a standard normal is symmetric alpha-stable of unit scale; each sample is a chain of its own, from ``start``.
    """
    if n_burnin >= n_iter:
        raise ValueError("n_burnin must be below n_iter")
    at = key(seed, trial, np.arange(len(r)) if t is None else t)
    phi, total = np.broadcast_to(np.asarray(start, dtype=float), r.shape), np.zeros(r.shape)
    for i in range(n_iter):
        new = 2.0 * positive_stable(alpha / 2, drawn(at, i, ANGLE), drawn(at, i, HEIGHT))
        gain = 0.5 * np.log(phi / new) + 0.5 * r * r * (1 / phi - 1 / new)
        phi = np.where(np.log(drawn(at, i, CHOICE)) < gain, new, phi)
        if i >= n_burnin:
            total += 1 / phi
    tau = total / (n_iter - n_burnin)
    return (tau, phi) if state else tau
