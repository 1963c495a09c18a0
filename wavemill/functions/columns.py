"""Column functions: tapers, shifts and small integer arithmetic, all built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def tukey(t: Column, length: int, alpha: float = 0.5, floor: float | None = 1e-9) -> Column:
    """Tukey taper of sample t of ``length``; ``floor`` replaces both end samples, None keeps their zeros."""
    if length == 1:
        return F.lit(1.0 if floor is None else floor)
    edge = alpha * (length - 1) / 2.0
    rising = 0.5 * (1 + F.cos(math.pi * (t / F.lit(edge) - 1))) if edge else F.lit(1.0)
    falling = 0.5 * (1 + F.cos(math.pi * ((F.lit(length - 1) - t) / F.lit(edge) - 1))) if edge else F.lit(1.0)
    value = F.when(t < edge, rising).when(t > (length - 1) - edge, falling).otherwise(1.0)
    return value if floor is None else F.when((t == 0) | (t == length - 1), F.lit(floor)).otherwise(value)


def hamming(t: Column, length: int) -> Column:
    return 0.54 - 0.46 * F.cos(2 * math.pi * t / max(length - 1, 1)) if length > 1 else F.lit(1.0)


def blackman(t: Column, length: int) -> Column:
    if length == 1:
        return F.lit(1.0)
    turn = 2 * math.pi * t / (length - 1)
    return 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is n or more, by bits: no rounding of a logarithm."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long") - 1))))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.cast("long").bitwiseAND(n.cast("long") - 1) == 0)


def lags(length: int) -> Column:
    """Every lag of two atoms of ``length`` that overlap; exploded on a row it keeps a lag join an equi-join."""
    return F.explode(F.sequence(F.lit(1 - length), F.lit(length - 1)))


def offsets(length: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(length - 1)))


def atom_shape(shape: str, l: Column, length: int, cycles: int = 1) -> Column:
    """Sample l of a triangle from 0 to 1 and back, a square of 0.5 and -0.5, or a sin or cos whose last sample ends the last period.

    Half a period of a triangle or a square has length // (2 cycles) samples, both its ends among them; what is left behind the last is 0.
    """
    if shape in ("sin", "cos"):
        return (F.sin if shape == "sin" else F.cos)(2 * math.pi * cycles * l / F.lit(float(max(1, length - 1))))
    half = length // (2 * cycles)
    place, falls = l % max(half, 1), (F.floor(l / max(half, 1)) % 2) == 1
    if shape == "triangle":
        rise = place / F.lit(float(max(1, half - 1)))
        value = F.when(falls, (half - 1 - place) / F.lit(float(max(1, half - 1)))).otherwise(rise)
    elif shape == "square":
        value = F.when(falls, -0.5).otherwise(0.5)
    else:
        raise ValueError(f"shape must be triangle, square, sin or cos, not {shape!r}")
    return F.when(l < 2 * cycles * half, value).otherwise(0.0)


def uniform(salt: str, *of: Column | str) -> Column:
    """A number between 0 and 1 from the MD5 of a salt and some columns: alike in every run, on every executor and in other engines."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(salt), *of)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def gaussian(salt: str, *of: Column | str) -> Column:
    """A standard normal number from two such."""
    return F.sqrt(-2 * F.log(uniform(salt + "a", *of))) * F.cos(2 * math.pi * uniform(salt + "b", *of))
