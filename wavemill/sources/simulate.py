"""Simulated signals, made on the executors: random numbers are hashes of a seed and a place, samples are column arithmetic."""

from __future__ import annotations

import math
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import atom_shape, gaussian, tukey, uniform
from ..operators import convolution as C
from ..plans.model import atoms_table


def shape_cycle(length: int):
    """(shape, cycles): three shapes of one cycle, then of two, and so on; it never runs out, frequencies start again."""
    for i in count():
        yield ("triangle", "square", "sin")[i % 3], 1 + (i // 3) % max(1, length // 2 - 1)


def simulated_atoms(n_atoms: int, length: int) -> np.ndarray:
    """(K, L) without a mean, of unit norm."""
    out = []
    for (shape, cycles), _ in zip(shape_cycle(length), range(n_atoms)):
        if shape == "sin":
            out.append(np.sin(2 * np.pi * cycles * np.linspace(0, 1, length)))
            continue
        half = length // (2 * cycles)
        rise = np.linspace(0, 1, half) if shape == "triangle" else np.full(half, 0.5)
        period = np.concatenate([rise, rise[::-1] if shape == "triangle" else -rise])
        out.append(np.pad(np.tile(period, cycles), (0, length - 2 * cycles * half)))
    out = [d - d.mean() for d in out]
    d = np.array(out)
    size = np.linalg.norm(d, axis=1, keepdims=True)
    return d / np.where(size > 0, size, 1.0)


def _trials(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("trial"))


def simulate_data(spark: SparkSession, n_trials: int, n_times: int, n_times_atom: int, n_atoms: int, random_state: int = 42, constant_amplitude: bool = False) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(signal, atoms (K, L), code): one activation of each atom in each trial, uniform in place and height."""
    d = simulated_atoms(n_atoms, n_times_atom)
    each = _trials(spark, n_trials).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_atoms - 1))))
    place = F.floor(uniform(f"{random_state}t", "trial", "k") * (n_times - n_times_atom + 1)).cast("int")
    height = F.lit(1.0) if constant_amplitude else uniform(f"{random_state}z", "trial", "k")
    z = each.select("trial", "k", place.alias("t"), height.alias("z"))
    return C.reconstruct(z, atoms_table(spark, d[:, None, :])), d, z


def channel_map(n_channels: int, random_state: int) -> np.ndarray:
    """Positive weights of unit norm, one for each channel."""
    u = np.abs(np.random.RandomState(random_state).randn(n_channels))
    return u / np.linalg.norm(u)


def simulate_mu_wave(spark: SparkSession, n_trials: int = 40, n_channels: int = 4, n_times: int = 6, sigma: float = 0.01, sfreq: float = 300.0, random_state: int = 0) -> DataFrame:
    """A 10 Hz wave with bent crests in the middle second of each trial, mixed over channels, in noise, tapered; n_times in seconds."""
    samples = int(n_times * sfreq)
    maps = F.create_map(*[F.lit(v) for p, u in enumerate(channel_map(n_channels, random_state)) for v in (p, float(u))])
    phase = 2 * math.pi * uniform(f"{random_state}p", "trial")
    full = _trials(spark, n_trials).withColumn("phase", phase).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    full = full.withColumn("s", F.col("t") / sfreq)
    turn = 2 * math.pi * 10 * F.col("s") + F.col("phase")
    wave = F.when((F.col("s") >= 2) & (F.col("s") < 3), F.sin(turn + 0.8 * F.cos(turn))).otherwise(0.0)
    full = full.withColumn("wave", wave).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(n_channels - 1))))
    noise = gaussian(str(random_state), "trial", "channel", "t")
    value = (maps[F.col("channel")] * F.col("wave") + sigma * noise) * tukey(F.col("t"), samples, 0.05, floor=None)
    return full.select("trial", "channel", "t", value.alias("x"))


def shapes_table(spark: SparkSession, shape: str, length: int, cycles: int = 1, zero_mean: bool = False) -> DataFrame:
    """(l, x) of one shape."""
    at = spark.range(length).select(F.col("id").cast("int").alias("l")).withColumn("x", atom_shape(shape, F.col("l"), length, cycles))
    return at.crossJoin(F.broadcast(at.agg(F.avg("x").alias("m")))).select("l", (F.col("x") - F.col("m")).alias("x")) if zero_mean else at


def rank1_maps(n_channels: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): sine and cosine maps over the channels, a triangle and a square in time, all of unit norm."""
    p = np.linspace(0, np.pi, n_channels)
    u = np.stack([np.sin(p) + 1e-9, np.cos(p)])
    return u / np.linalg.norm(u, axis=1, keepdims=True), simulated_atoms(2, length)


def rank1_signals(spark: SparkSession, n_trials: int, n_channels: int, valid: int, length: int, density: float = 0.05, sigma: float = 0.1, random_state: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(signal, u, v): triangle and square atoms with random sparse activations on sine and cosine channel maps, in noise."""
    u, v = rank1_maps(n_channels, length)
    each = _trials(spark, n_trials).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(valid - 1))))
    z = each.where(uniform(f"{random_state}hit", "trial", "k", "t") < density).select("trial", "k", "t", uniform(f"{random_state}z", "trial", "k", "t").alias("z"))
    noise = C.grid(_trials(spark, n_trials), n_channels, valid + length - 1).withColumn("x", sigma * gaussian(str(random_state), "trial", "channel", "t"))
    both = C.reconstruct(z, atoms_table(spark, u[:, :, None] * v[:, None, :])).unionByName(noise)
    return both.groupBy("trial", "channel", "t").agg(F.sum("x").alias("x")), u, v
