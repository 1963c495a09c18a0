"""Checks of arguments that fail early, with the names of what is wrong."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame


def needs(df: DataFrame, columns: list[str], absent: list[str] | None = None) -> None:
    """Raises unless df has the columns, and none of the absent ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    if extra := [c for c in absent or [] if c in df.columns]:
        raise ValueError(f"column {', '.join(extra)} is there already")


def check_dimensions(shape: tuple[int, ...], names: str, **fixed: int) -> tuple[int, ...]:
    """The shape, if it has as many dimensions as ``names`` has letters and each named one the size that is given for it."""
    if len(shape) != len(names):
        raise ValueError(f"the array has {len(shape)} dimensions, not {len(names)} ({names})")
    for name, size in zip(names, shape, strict=True):
        if fixed.get(name, size) != size:
            raise ValueError(f"dimension {name} has size {size}, not {fixed[name]}")
    return shape


def check_random_state(seed) -> np.random.RandomState:
    """A generator from None, a seed or a generator."""
    if seed is None or isinstance(seed, (int, np.integer)):
        return np.random.RandomState(seed)
    if isinstance(seed, np.random.RandomState):
        return seed
    raise ValueError(f"{seed!r} cannot seed a random state")


def check_same_length(**arrays) -> int:
    """The common length of the arrays."""
    sizes = {name: len(a) for name, a in arrays.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError("lengths differ: " + ", ".join(f"{n} {s}" for n, s in sizes.items()))
    return next(iter(sizes.values()), 0)
