"""Two other ways to find recurring waveforms: aligned generative atoms, and windows matched by annealing."""

from __future__ import annotations

import numpy as np


def align(x: np.ndarray, atom: np.ndarray, max_shift: int | None = None) -> np.ndarray:
    """(N, L): of each series the patch whose mean-free, normalised correlation with the atom is largest in size."""
    length = len(atom)
    patches = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
    if max_shift is not None:
        patches = patches[:, : max_shift + 1]
    centred = atom - atom.mean()
    norm = np.sqrt(np.maximum((patches * patches).sum(axis=2) - length * patches.mean(axis=2) ** 2, 0.0)) + np.finfo(np.float32).eps
    c = (patches @ centred) / (norm * (np.linalg.norm(centred) or 1.0))
    return patches[np.arange(len(x)), np.abs(c).argmax(axis=1)]


def outer_sum(x: np.ndarray, atom: np.ndarray, max_shift: int | None = None) -> np.ndarray:
    """(L, L): the sum of outer products of the aligned patches; sums of parts of the series add up to that of all."""
    patches = align(x, atom, max_shift)
    return patches.T @ patches


def _top_generalised(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The generalised eigenvector of a v = s b v for the largest s, through a Cholesky factor of b."""
    root = np.linalg.cholesky(b + 1e-9 * np.trace(b) / len(b) * np.eye(len(b)))
    inner = np.linalg.solve(root, np.linalg.solve(root, a).T)
    v = np.linalg.eigh((inner + inner.T) / 2)[1][:, -1]
    v = np.linalg.solve(root.T, v)
    return v / np.linalg.norm(v)


def apart(atoms: list[np.ndarray], length: int) -> np.ndarray:
    """(L, L): what a new atom's energy is measured against, so that it stays apart from shifts of those before it."""
    b = np.eye(length)
    for old in atoms:
        for shift in range(1 - length, length):
            moved = np.zeros(length)
            lo, hi = max(0, shift), min(length, length + shift)
            moved[lo:hi] = old[lo - shift : hi - shift]
            b += np.outer(moved, moved)
    return b


def next_atom(total: np.ndarray, b: np.ndarray, atom: np.ndarray) -> np.ndarray:
    """The atom of most energy over the summed outer products, its sign that of the atom before."""
    new = _top_generalised(total, b)
    return new * (np.sign(new @ atom) or 1.0)


def motif_atoms(x: np.ndarray, n_atoms: int, length: int, n_iter: int = 10, max_shift: int | None = None, seed: int = 0) -> np.ndarray:
    """(K, L): atoms of most energy over aligned patches, each kept apart from shifts of those before it."""
    rng = np.random.RandomState(seed)
    atoms: list[np.ndarray] = []
    for _ in range(n_atoms):
        i, s = rng.randint(len(x)), rng.randint(x.shape[1] - length + 1)
        atom = x[i, s : s + length].copy()
        atom /= np.linalg.norm(atom) or 1.0
        b = apart(atoms, length)
        for _ in range(n_iter):
            new = next_atom(outer_sum(x, atom, max_shift), b, atom)
            done = np.abs(new - atom).max() < 1e-8
            atom = new
            if done:
                break
        atoms.append(atom)
    return np.array(atoms)


def scored(x: np.ndarray, start: int, length: int) -> np.ndarray:
    """A window less its mean over its deviation."""
    w = x[start : start + length]
    return (w - w.mean()) / (w.std() + 1e-12)


def window_cost(x: np.ndarray, starts: np.ndarray, length: int) -> float:
    """Sum of squared distances over pairs of scored windows, over length and number less one, in closed form."""
    w = np.stack([scored(x, s, length) for s in starts])
    s = w.sum(axis=0)
    return float((len(w) * np.sum(w * w) - s @ s) / (length * (len(w) - 1)))


class Windows:
    """Starts of windows with the sums that tell the cost of moving one of them, by its length alone."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, length: int) -> None:
        self.x, self.length, self.starts = x, length, np.array(starts)
        self.held = np.stack([scored(x, s, length) for s in self.starts])
        self.total, self.squares = self.held.sum(axis=0), float(np.sum(self.held**2))

    def _cost(self, total: np.ndarray, squares: float) -> float:
        n = len(self.starts)
        return float((n * squares - total @ total) / (self.length * (n - 1)))

    @property
    def cost(self) -> float:
        return self._cost(self.total, self.squares)

    def moved(self, k: int, start: int) -> tuple[float, np.ndarray]:
        """(the cost with window k at a start, that window)."""
        new = scored(self.x, start, self.length)
        old = self.held[k]
        return self._cost(self.total - old + new, self.squares - float(old @ old) + float(new @ new)), new

    def move(self, k: int, start: int, new: np.ndarray) -> None:
        old = self.held[k]
        self.total, self.squares = self.total - old + new, self.squares - float(old @ old) + float(new @ new)
        self.held[k], self.starts[k] = new, start


def match_windows(x: np.ndarray, length: int, gap: int, n_windows: int | None = None, max_iter: int = 2000, temperature: float = 1.0, starts: np.ndarray | None = None, seed: int = 0, cooling: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean window, starts, costs): windows moved one at a time to places more than ``gap`` from all others, by Metropolis steps.

    Without ``starts`` there is a window every two gaps, or ``n_windows`` evenly spread. The temperature is constant, or falls to zero with ``cooling``.
    """
    rng = np.random.RandomState(seed)
    if starts is None:
        starts = np.arange(0, len(x) - length, 2 * gap) if n_windows is None else np.arange(n_windows) * max(1, (len(x) - length) // n_windows)
    if len(starts) < 2:
        raise ValueError("matching needs two windows at least")
    windows, costs = Windows(x, starts, length), []
    for i in range(max_iter):
        k = rng.randint(len(windows.starts))
        for _ in range(1000):
            new = rng.randint(len(x) - length + 1)
            near = np.abs(windows.starts - new) <= gap
            near[k] = False
            if not near.any():
                break
        else:
            raise ValueError(f"there is no place more than {gap} from {len(windows.starts) - 1} windows; take a smaller gap or fewer windows")
        now = windows.cost
        found, window = windows.moved(k, new)
        heat = temperature * (1 - i / max_iter if cooling else 1.0)
        if found < now or rng.uniform() < np.exp(-(found - now) / max(heat, 1e-12)):
            windows.move(k, new, window)
        costs.append(windows.cost)
    starts = np.sort(windows.starts)
    return x[starts[:, None] + np.arange(length)].mean(axis=0), starts, np.array(costs)
