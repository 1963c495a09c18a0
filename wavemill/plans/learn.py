"""Learners: an encoding job on the cluster, a dictionary step on the driver, in turn."""

from __future__ import annotations

import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checks import check_random_state
from ..kernels import dictionary as dic
from . import encode as E
from .long import LongSignal
from ..operators.shared import dropped, scratch, settled


@dataclass
class Learned:
    """A dictionary (K, P, L), its rank-1 form if it has one, the trace, the block table with the codes, and how often an atom was drawn anew."""

    d: np.ndarray
    uv: np.ndarray | None
    reg: np.ndarray
    trace: list[tuple[int, str, float, float]] = field(default_factory=list)
    table: DataFrame | None = None
    redrawn: int = 0
    scale: float = 1.0

    @property
    def pobj(self) -> list[float]:
        return [t[2] for t in self.trace]


LMBD_MAX = ("fixed", "scaled", "shared", "per_atom")
ALGORITHMS = ("batch", "greedy", "online", "stochastic")


def resolve_solver(solver_d: str, uv_constraint: str, rank1: bool) -> tuple[str, str]:
    """The dictionary solver and constraint that "auto" stands for."""
    if rank1:
        if uv_constraint not in ("auto", "joint", "separate"):
            raise ValueError("uv_constraint must be auto, joint or separate for rank-1 atoms")
        if solver_d == "auto":
            solver_d = "joint" if uv_constraint == "joint" else "alternate_adaptive"
        if solver_d not in ("joint", "alternate", "alternate_adaptive"):
            raise ValueError(f"solver_d={solver_d!r} does not fit rank-1 atoms")
        uv_constraint = ("joint" if solver_d == "joint" else "separate") if uv_constraint == "auto" else uv_constraint
        if solver_d != "joint" and uv_constraint == "joint":
            raise ValueError("alternate solvers need uv_constraint='separate'")
        return solver_d, uv_constraint
    if solver_d not in ("auto", "fista", "ista"):
        raise ValueError(f"solver_d={solver_d!r} does not fit full-rank atoms")
    if uv_constraint != "auto":
        raise ValueError("uv_constraint is for rank-1 atoms only")
    return ("fista" if solver_d == "auto" else solver_d), "auto"


def initial_dictionary(source: E.Trials | LongSignal, n_atoms: int, how="random", rank1: bool = False, constraint: str = "separate", window: bool = False, seed: int | None = None) -> np.ndarray:
    """"random", "chunk" (patches at random places), "greedy" (no atom yet) or an array; (K, P, L) or (K, P + L)."""
    length, channels = source.length, source.channels
    rng = check_random_state(seed)
    shape = (n_atoms, channels + length) if rank1 else (n_atoms, channels, length)
    if isinstance(how, np.ndarray):
        if how.shape != shape:
            raise ValueError(f"D_init has shape {how.shape}, not {shape}")
        return _project(how.copy(), rank1, channels, constraint)
    if how in (None, "random"):
        d = rng.randn(*shape)
    elif how == "greedy":
        return np.zeros((0, *shape[1:]))
    elif how == "chunk":
        d = source.random_patches(n_atoms, rng)
        d = dic.rank1(d) if rank1 else d
    else:
        raise ValueError(f"D_init must be random, chunk, greedy or an array, not {how!r}")
    if window:
        d = d * (np.concatenate([np.ones(channels), dic.tukey(length)]) if rank1 else dic.tukey(length))
    return _project(d, rank1, channels, constraint)


def ranked(table: DataFrame) -> DataFrame:
    """(trial, rank) of all trials in ascending order, from 0: trials are dealt over ranges and ranked in each, behind those before it."""
    dealt = settled(table.select("trial").repartitionByRange("trial").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("trial")) - 1
    return settled(dealt.withColumn("inside", inside).join(before, "part").select("trial", (F.col("before") + F.col("inside")).alias("rank")))


def batch_of(table: DataFrame, i: int, size: int, trials: int, selection: str, seed: int, ranks: DataFrame | None = None) -> DataFrame:
    """The blocks of the i-th batch of trials.

    "random" takes the ``size`` trials of the smallest hashes, others each time. "cyclic" takes the next ``size`` trials in ascending order and begins anew
    behind the last one, where a batch may be shorter; ``ranks`` is ``ranked(table)``.
    """
    if selection == "random":
        chosen = table.select("trial").orderBy(F.xxhash64("trial", F.lit(seed + i)), "trial").limit(size)
    else:
        first = i * size % trials
        chosen = (ranked(table) if ranks is None else ranks).where((F.col("rank") >= first) & (F.col("rank") < first + size)).select("trial")
    return table.join(chosen, "trial", "left_semi")


def resampled(source: E.Trials | LongSignal, how: str, d: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """(P, L): a patch for an atom that is not used: of largest error ("greedy"), at a random place ("chunk") or noise ("random")."""
    if how == "greedy":
        return source.worst_patch(d)
    if how == "chunk":
        return source.random_patches(1, rng)[0]
    if how == "random":
        return rng.randn(source.channels, source.length)
    raise ValueError(f"D_resample must be greedy, chunk or random, not {how!r}")


def online_step(part: E.Trials, encoder: E.Encoder, solver: DictionarySolver, d: np.ndarray, older: E.Statistics | None, alpha: float, how: str, rng: np.random.RandomState) -> tuple[np.ndarray, E.Statistics, int | None]:
    """One batch of online learning: (dictionary, decayed sums, the atom that was drawn anew or None).

    Uses of atoms decay like the sums, and so does the error of the worst patch seen, which is kept until a batch has a worse one. An atom
    of fewer than two uses is drawn anew, one a batch: "greedy" takes the kept patch. Its share of the sums is forgotten, since it was another atom's.
    """
    part.encode(encoder, warm=False)
    stats = encoder.partial_statistics(part.table, older, alpha)
    if not stats.trials:
        return d, older or stats, None
    patch, error = E.worst_patch_error(part.table, encoder.d, part.length, part.channels)
    kept = older is not None and older.patch is not None and alpha * older.error > error
    stats.patch, stats.error = (older.patch, alpha * older.error) if kept else (patch, error)
    if not stats.used.any():
        return d, stats, None
    d = solver.step(d, stats)
    dead = np.flatnonzero(stats.used < 2)
    if not len(dead):
        return d, stats, None
    k = int(dead[0])
    fresh = stats.patch if how == "greedy" else resampled(part, how, encoder.d, rng)
    d = d.copy()
    d[k] = solver.add(d[:0], fresh)[0]
    stats.ztz[k], stats.ztz[:, k], stats.ztx[k], stats.l1[k] = 0.0, 0.0, 0.0, 0.0
    stats.used[k] = 2 / alpha if alpha else 0.0  # the next batch has to use it
    if how == "greedy":
        stats.patch, stats.error = None, 0.0
    return d, stats, k


def converged(before: float, z: float, d: float, eps: float, raise_on_increase: bool) -> bool:
    """Whether neither the codes' step (from ``before`` to z) nor the dictionary's (to d) lowers the objective by the share eps; a rise is an error if asked for."""
    dz, du = (before - z) / max(min(before, z), 1e-300), (z - d) / max(min(z, d), 1e-300)
    if raise_on_increase and dz < -1e-9:
        raise RuntimeError(f"the codes' step raised the objective from {before} to {z}")
    if raise_on_increase and du < -1e-9:
        raise RuntimeError(f"the dictionary's step raised the objective from {z} to {d}")
    return dz < eps and du < eps


def _project(d: np.ndarray, rank1: bool, channels: int, constraint: str) -> np.ndarray:
    return dic.project_uv(d, channels, constraint) if rank1 else dic.project_d(d)


@dataclass
class DictionarySolver:
    """Dictionary steps of one kind: full-rank (K, P, L) or rank-1 (K, P + L) atoms, with or without a window.

    ``of`` chooses what "auto" stands for and refuses what does not fit together.
    """

    channels: int
    rank1: bool
    solver: str
    constraint: str
    window: bool = False
    options: dict = field(default_factory=dict)

    @classmethod
    def of(cls, channels: int, solver_d: str = "auto", uv_constraint: str = "auto", rank1: bool = True, window: bool = False, options: dict | None = None) -> DictionarySolver:
        return cls(channels, rank1, *resolve_solver(solver_d, uv_constraint, rank1), window, options or {})

    def full(self, d: np.ndarray) -> np.ndarray:
        return dic.full(d, self.channels) if self.rank1 else d

    def step(self, d: np.ndarray, stats: E.Statistics) -> np.ndarray:
        """The dictionary after one step from d, by the statistics of the codes."""
        sums = (stats.ztz, stats.ztx, stats.xtx)
        if self.rank1:
            return dic.update_uv(d, self.channels, *sums, self.solver, self.constraint, window=self.window, **self.options)
        return dic.update_full(d, *sums, momentum=self.solver == "fista", window=self.window, **self.options)

    def add(self, d: np.ndarray, patch: np.ndarray) -> np.ndarray:
        """d with an atom of a patch (P, L) behind the others."""
        return _add(d, patch, self.rank1, self.channels, self.constraint, self.window)


def _objective(d: np.ndarray, stats: E.Statistics, reg) -> float:
    return dic.fit_cost(d, stats.ztz, stats.ztx, stats.xtx) + float(np.sum(np.broadcast_to(np.asarray(reg).reshape(-1), stats.l1.shape) * stats.l1))


def learn(
    x: DataFrame,
    n_atoms: int,
    n_times_atom: int,
    channels: int,
    times: int,
    n_iter: int = 60,
    reg: float = 0.1,
    lmbd_max: str = "fixed",
    rank1: bool = True,
    uv_constraint: str = "auto",
    algorithm: str = "batch",
    algorithm_params: dict | None = None,
    solver_z: str = "lgcd",
    solver_z_kwargs: dict | None = None,
    solver_d: str = "auto",
    solver_d_kwargs: dict | None = None,
    D_init=None,
    D_resample: str = "greedy",
    eps: float = 1e-10,
    unbiased_z_hat: bool = False,
    sort_atoms: bool = False,
    stopping_pobj: float | None = None,
    raise_on_increase: bool = True,
    window: bool = False,
    rescale: bool = True,
    random_state: int | None = None,
    callback: Callable | None = None,
    block: int | None = None,
) -> Learned:
    """Learns a dictionary of a long signal (trial, channel, t, x); callback(iteration, Learned, trace) after each iteration.

    The signal is divided by its deviation first and codes and regularisation are scaled back at the end. "greedy" adds an atom an
    iteration; "online" and "stochastic" take a batch of trials an iteration and decay the statistics by alpha (0 for stochastic).
    Every iteration is tested: it ends where neither step lowers the objective by more than ``eps``, or at ``stopping_pobj``. A rise of
    the objective is an error where the regularisation is fixed, unless an atom was drawn anew just before. With ``block`` trials are too long for
    one task and are cut into blocks of so many places ("batch" and "greedy" only): all sums are those of the uncut trials, and
    ``Learned.table`` is their sparse code.
    """
    if lmbd_max not in LMBD_MAX:
        raise ValueError(f"lmbd_max must be one of {', '.join(LMBD_MAX)}, not {lmbd_max!r}")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}, not {algorithm!r}")
    solver = DictionarySolver.of(channels, solver_d, uv_constraint, rank1, window, solver_d_kwargs)
    constraint = solver.constraint
    params = {"alpha": 0.8, "batch_size": 1, "batch_selection": "random"} | (algorithm_params or {})
    if unknown := set(params) - {"alpha", "batch_size", "batch_selection"}:
        raise ValueError(f"algorithm_params has no {', '.join(sorted(unknown))}")
    if params["batch_selection"] not in ("random", "cyclic"):
        raise ValueError(f"batch_selection must be random or cyclic, not {params['batch_selection']!r}")
    if D_resample not in ("greedy", "chunk", "random"):
        raise ValueError(f"D_resample must be greedy, chunk or random, not {D_resample!r}")
    if block is not None and algorithm not in ("batch", "greedy"):
        raise ValueError("blocks of long trials are learned from all at once; use batch or greedy")
    rng = check_random_state(random_state)
    value = F.col("x").cast("double")
    s = x.agg(F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.countDistinct("trial").alias("trials")).first()
    if not s.trials:
        raise ValueError("the signal has no trial")
    n = s.trials * channels * times
    scale = float(np.sqrt(max(s.q / n - (s.s / n) ** 2, 0.0))) or 1.0 if rescale else 1.0
    source = E.Trials(settled(E.blocks(x, channels, times, scale=scale)), channels, n_times_atom) if block is None else LongSignal(x, channels, times, n_times_atom, block, scale)
    d = initial_dictionary(source, n_atoms, "greedy" if algorithm == "greedy" and D_init is None else D_init, rank1, constraint, window, random_state)
    if not len(d):
        d = solver.add(d, source.worst_patch(None))
    reg0 = np.asarray(reg, dtype=float)
    if lmbd_max == "scaled":
        reg0 = reg0 * source.lambda_max(solver.full(d)).max()
    out = Learned(solver.full(d), None, reg0)
    deal = int(rng.randint(2**31 - 1))
    online = algorithm in ("online", "stochastic")
    ranks = ranked(source.table) if online and params["batch_selection"] == "cyclic" else None
    older: E.Statistics | None = None
    before = None if online else source.energy()
    redrawn = None
    started = time.time()

    def note(i: int, step: str, value: float) -> float:
        nonlocal started
        out.trace.append((i, step, float(value), time.time() - started))
        started = time.time()
        return float(value)

    for i in range(n_iter):
        if algorithm == "greedy" and i and len(d) < n_atoms:
            d = solver.add(d, source.worst_patch(solver.full(d)))
        atoms, now = solver.full(d), reg0
        if lmbd_max in ("shared", "per_atom"):
            top = source.lambda_max(atoms)
            now = reg0 * (top if lmbd_max == "per_atom" else top.max())
        encoder = E.Encoder(atoms, now, solver_z, solver_z_kwargs or {})
        fresh = redrawn is not None
        if online:
            part = E.Trials(batch_of(source.table, i, params["batch_size"], s.trials, params["batch_selection"], deal, ranks), channels, n_times_atom)
            d, stats, redrawn = online_step(part, encoder, solver, d, older, params["alpha"] if algorithm == "online" else 0.0, D_resample, rng)
            used, older = stats.used, stats
            z_cost = note(i, "z", _objective(atoms, stats, now))
        else:
            source.encode(encoder)
            stats = source.statistics(encoder)
            used, redrawn = stats.nnz, None
            z_cost = note(i, "z", stats.cost)
        if not used.any():
            warnings.warn("all codes are zero; the regularisation is too strong", stacklevel=2)
            break
        if not online:
            d = solver.step(d, stats)
        out.d, out.reg = solver.full(d), now
        d_cost = note(i, "d", _objective(out.d, stats, now))
        if callback:
            callback(i, out, out.trace)
        if not online and len(dead := np.flatnonzero(stats.nnz < 2)):
            redrawn = int(dead[0])
            d = d.copy()
            d[redrawn] = solver.add(d[:0], resampled(source, D_resample, out.d, rng))[0]
        out.redrawn += redrawn is not None
        if len(d) == n_atoms:
            fixed = lmbd_max in ("fixed", "scaled")
            if fixed and before is not None and not (online and redrawn is not None) and converged(before, z_cost, d_cost, eps, raise_on_increase and not fresh and not online):
                break
            if stopping_pobj is not None and d_cost < stopping_pobj:
                break
        before = d_cost
    encoder = E.Encoder(out.d, out.reg, solver_z, solver_z_kwargs or {})
    source.encode(encoder, warm=not online) if block is None else source.encode(encoder)
    if sort_atoms:
        gain = explained_variances(out.d, source.statistics(encoder), channels * times)
        order = np.argsort(-gain, kind="stable")
        d, out.d = d[order], out.d[order]
        out.reg = out.reg[order] if np.ndim(out.reg) and len(np.ravel(out.reg)) == len(order) else out.reg
        encoder = E.Encoder(out.d, out.reg, solver_z, solver_z_kwargs or {})
        if block is not None:
            source.forget()
            source.encode(encoder)
        else:
            source.encode(encoder, warm=False)
    if unbiased_z_hat:
        source.encode(encoder, unbiased=True)
    out.uv = dic.flip(d, channels) if rank1 else None
    out.reg = out.reg * scale
    out.scale = scale
    if block is None:
        out.table = source.table
    else:
        out.table = settled(source.sparse())
        source.close()
    return out


def explained_variances(d: np.ndarray, stats: E.Statistics, samples: int) -> np.ndarray:
    """(K,): the variance of each atom's own part over all trials of so many samples, from the statistics of its (positive) codes."""
    n = stats.trials * samples
    squares = np.array([np.sum(dic.apply_ztz(stats.ztz[k : k + 1, k : k + 1], d[k : k + 1]) * d[k : k + 1]) for k in range(len(d))])
    sums = stats.l1 * d.sum(axis=(1, 2))
    return squares / n - (sums / n) ** 2


def init_dictionary(x: DataFrame, n_atoms: int, n_times_atom: int, channels: int, times: int, uv_constraint: str = "separate", rank1: bool = True, window: bool = False, D_init="random", random_state: int | None = None) -> np.ndarray:
    """A dictionary to begin with, of a long signal; "greedy" has none to give before anything is learned."""
    if isinstance(D_init, str) and D_init == "greedy":
        raise ValueError("a greedy dictionary begins without atoms; use random, chunk or an array")
    table = settled(E.blocks(x, channels, times)) if isinstance(D_init, str) and D_init == "chunk" else E.blocks(x, channels, times)
    return initial_dictionary(E.Trials(table, channels, n_times_atom), n_atoms, D_init, rank1, uv_constraint, window, random_state)


def _add(d: np.ndarray, patch: np.ndarray, rank1: bool, channels: int, constraint: str, window: bool) -> np.ndarray:
    length = patch.shape[1]
    atom = dic.rank1(patch[None]) if rank1 else patch[None]
    if window:
        atom = atom * (np.concatenate([np.ones(channels), dic.tukey(length)]) if rank1 else dic.tukey(length))
    size = np.sqrt((atom * atom).sum()) if not rank1 else 1.0
    atom = atom / (size or 1.0) if not rank1 else np.concatenate([p / (np.linalg.norm(p) or 1.0) for p in (atom[:, :channels], atom[:, channels:])], axis=1)
    return np.concatenate([d, _project(atom, rank1, channels, constraint)])


def learn_univariate(x: DataFrame, n_atoms: int, n_times_atom: int, times: int, reg: float = 0.1, lmbd_max: str = "fixed", n_iter: int = 60, func_d="block", projection: str = "dual", solver_z: str = "l-bfgs", solver_z_kwargs: dict | None = None, ds_init: np.ndarray | None = None, sample_weights: DataFrame | None = None, stopping_pobj: float | None = None, random_state: int | None = None, callback: Callable | None = None) -> Learned:
    """Univariate atoms (K, L) of (trial, t, x), with optional sample weights (trial, t, w); func_d is "block", "joint" or a callable.

    With weights the normal equations come from the weighted samples around each activation, summed over tasks.
    """
    signal = x.select("trial", F.lit(0).alias("channel"), "t", "x")
    table = settled(E.blocks(signal, 1, times, sample_weights))
    weighted = sample_weights is not None
    fit = _univariate(table, n_atoms, n_times_atom, reg, lmbd_max, n_iter, func_d, projection, solver_z, solver_z_kwargs, ds_init, weighted, stopping_pobj, random_state, callback)
    return _kept(fit) if weighted else fit


def _univariate(table: DataFrame, n_atoms: int, n_times_atom: int, reg: float = 0.1, lmbd_max: str = "fixed", n_iter: int = 60, func_d="block", projection: str = "dual", solver_z: str = "l-bfgs", solver_z_kwargs: dict | None = None, ds_init: np.ndarray | None = None, weighted: bool = False, stopping_pobj: float | None = None, random_state: int | None = None, callback: Callable | None = None) -> Learned:
    """``learn_univariate`` on a block table. With weights the last table is cached, not settled."""
    rng = check_random_state(random_state)
    d = (rng.randn(n_atoms, n_times_atom) if ds_init is None else ds_init.astype(float)).copy()
    d /= np.maximum(1.0, np.linalg.norm(d, axis=1, keepdims=True)) if ds_init is not None else np.linalg.norm(d, axis=1, keepdims=True)
    reg0 = np.asarray(reg, dtype=float)
    if lmbd_max == "scaled":
        reg0 = reg0 * E.lambda_max(table, d[:, None]).max()
    out, started = Learned(d[:, None], None, reg0), time.time()
    for i in range(n_iter):
        now = reg0
        if lmbd_max in ("shared", "per_atom"):
            top = E.lambda_max(table, d[:, None])
            now = reg0 * (top if lmbd_max == "per_atom" else top.max())
        encoder = E.Encoder(d[:, None], now, solver_z, solver_z_kwargs or {})
        if weighted:  # one job makes the codes, keeps them and sums
            older, table = table, encoder.encode(table).persist()
            sums = weighted_sums(table, n_atoms, n_times_atom)
            older.unpersist()
            nnz, before = sums.nnz, sums.cost(d, now)
        else:
            table = settled(encoder.encode(table))
            stats = encoder.statistics(table)
            nnz, before = stats.nnz, stats.cost
        out.trace.append((i, "z", float(before), time.time() - started))
        started = time.time()
        if not nnz.any():
            warnings.warn("all codes are zero; the regularisation is too strong", stacklevel=2)
            break
        equations, right = (sums.equations, sums.right) if weighted else (dic.toeplitz_blocks(stats.ztz), stats.ztx[:, 0])
        if callable(func_d):
            d = func_d(d, equations, right)
        else:
            d = dic.update_joint_dual(equations, right) if func_d == "joint" else dic.update_block(d, equations, right, 1, projection)
        after = sums.cost(d, now) if weighted else E.Encoder(d[:, None], now).statistics(table).cost
        out.d, out.reg = d[:, None], now
        out.trace.append((i, "d", float(after), time.time() - started))
        started = time.time()
        if callback:
            callback(i, out, out.trace)
        if stopping_pobj is not None and after < stopping_pobj:
            break
    out.table = table
    return out


def _kept(fit: Learned) -> Learned:
    """The fit with its cached table settled."""
    cached, fit.table = fit.table, settled(fit.table)
    cached.unpersist()
    return fit


@dataclass
class WeightedSums:
    """Of weighted trials and their codes: the normal equations (K, K, L, L) and (K, L) of the atoms, the energy, activations and their sum by atom."""

    equations: np.ndarray
    right: np.ndarray
    energy: float
    nnz: np.ndarray
    l1: np.ndarray

    def cost(self, d: np.ndarray, reg) -> float:
        """The objective of atoms (K, L) with these codes."""
        fit = 0.5 * np.einsum("kl,kjlm,jm->", d, self.equations, d) - np.sum(d * self.right) + 0.5 * self.energy
        return float(fit + np.sum(np.asarray(reg) * self.l1))


def weighted_sums(table: DataFrame, atoms: int, length: int) -> WeightedSums:
    """Sums of w (z-shift of k, l) (z-shift of j, m), of w x (z-shift of k, l), of w x x, and of the codes."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            total, few = 0.0, max(1, E.CHUNK // max(1, atoms * length * len(pdf["x"].iloc[0])))
            for start in range(0, len(pdf), few):
                part = pdf.iloc[start : start + few]
                x, w, z = (np.frombuffer(b"".join(part[c])).reshape(len(part), *shape) for c, shape in (("x", (-1,)), ("w", (-1,)), ("z", (atoms, -1))))
                shifted = np.zeros((atoms, length, *x.shape))
                for m in range(length):
                    shifted[:, m, :, m : m + z.shape[2]] = z.transpose(1, 0, 2)
                flat = shifted.reshape(atoms * length, -1)
                sums = [((flat * w.ravel()) @ flat.T).ravel(), flat @ (w * x).ravel(), [np.sum(w * x * x)], np.count_nonzero(z, axis=(0, 2)), np.abs(z).sum(axis=(0, 2))]
                total += np.concatenate(sums)
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    found = table.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # as large as the equations
    size = atoms * length
    v = np.zeros(size**2 + size + 1 + 2 * atoms)
    v[found["i"]] = found["v"]
    equations, right, energy, nnz, l1 = np.split(v, np.cumsum([size**2, size, 1, atoms]))
    return WeightedSums(equations.reshape(atoms, length, atoms, length).transpose(0, 2, 1, 3), right.reshape(atoms, length), float(energy[0]), nnz.astype(int), l1)


def learn_robust(x: DataFrame, n_atoms: int, n_times_atom: int, times: int, reg: float = 0.1, alpha: float = 1.9, n_iter_global: int = 10, n_iter_optim: int = 10, n_iter_mcmc: int = 100, n_burnin_mcmc: int = 50, init_tau: bool = False, lmbd_max: str = "fixed", random_state: int = 0, **kwargs) -> tuple[Learned, DataFrame]:
    """Alpha-stable noise by Monte Carlo EM: each round takes weights from a Metropolis-Hastings chain a sample, then fits with them.

    Returns the fit and the last weights (trial, t, w). Each sample has a chain of its own, whose draws are hashes of a seed, its trial and its time;
    the chain goes on from round to round, the first on the signal itself. ``init_tau`` begins it at the trial's variance.
    Chains and codes stay with the packed trials: nothing is shuffled after these are made.
    """
    if n_iter_global < 1:
        raise ValueError("n_iter_global must be at least 1")
    if n_burnin_mcmc >= n_iter_mcmc:
        raise ValueError("n_burnin_mcmc must be below n_iter_mcmc")
    signal = x.select("trial", F.lit(0).alias("channel"), "t", "x")
    spark = x.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism  # by the cores: a trial is few bytes and much work
    table = E.blocks(signal, 1, times).repartition(parts).withColumn("phi", F.lit(None).cast("binary"))
    ds, fit, rng, folder, kind = None, None, np.random.RandomState(random_state), scratch(spark, f"robust_{uuid.uuid4().hex}"), table.schema
    try:
        for g in range(n_iter_global):
            d, seed = None if fit is None else fit.d, int(rng.randint(2**31 - 1))
            table.mapInPandas(_chains(d, alpha, n_iter_mcmc, n_burnin_mcmc, seed, init_tau), kind).write.parquet(f"{folder}/{g}")
            table.unpersist()
            dropped(spark, f"{folder}/{g - 1}")
            table = spark.read.schema(kind).parquet(f"{folder}/{g}")
            fit = _univariate(table, n_atoms, n_times_atom, reg, lmbd_max, n_iter_optim, ds_init=ds, weighted=True, random_state=random_state, **kwargs)
            ds, reg, lmbd_max, table = fit.d[:, 0], fit.reg, "fixed", fit.table
        fit = _kept(fit)
    finally:
        table.unpersist()
        dropped(spark, folder)

    def samples(batches):
        import pandas as pd

        for pdf in batches:
            few = max(1, E.CHUNK // max(1, len(pdf["w"].iloc[0]))) if len(pdf) else 1
            for start in range(0, len(pdf), few):
                part = pdf.iloc[start : start + few]
                w = np.frombuffer(b"".join(part["w"])).reshape(len(part), -1)
                yield pd.DataFrame({"trial": np.repeat(part["trial"].to_numpy(), w.shape[1]), "t": np.tile(np.arange(w.shape[1], dtype=np.int32), len(part)), "w": w.ravel()})

    return fit, fit.table.select("trial", "w").mapInPandas(samples, "trial long, t int, w double")


def _chains(d: np.ndarray | None, alpha: float, n_iter: int, n_burnin: int, seed: int, by_variance: bool):
    """Block rows with the weights and the state of the chains of their residuals, and without codes; a narrow step. Without atoms the signal is the residual."""
    from ..kernels import csc
    from ..kernels.stable import expected_precision

    def run(batches):
        for pdf in batches:
            few = max(1, 16_384 * 8 // max(1, len(pdf["x"].iloc[0]))) if len(pdf) else 1  # many trials' chains side by side
            for start in range(0, len(pdf), few):
                part = pdf.iloc[start : start + few]
                x = np.frombuffer(b"".join(part["x"])).reshape(len(part), -1)
                r = x if d is None else x - np.concatenate([csc.reconstruct(np.frombuffer(z).reshape(len(d), -1), d) for z in part["z"]])
                if d is not None:
                    phi = np.frombuffer(b"".join(part["phi"])).reshape(r.shape)
                else:
                    var = x.var(axis=1, keepdims=True)
                    phi = np.broadcast_to(np.where(var > 0, var, 2.0), r.shape) if by_variance else np.full(r.shape, 2.0)
                trial, t = np.repeat(part["trial"].to_numpy(), r.shape[1]), np.tile(np.arange(r.shape[1]), len(part))
                tau, phi = expected_precision(r.ravel(), alpha, n_iter, n_burnin, seed, trial, t, phi.ravel(), state=True)
                w, phi = (2 * tau).reshape(r.shape), phi.reshape(r.shape)
                yield part.assign(w=[v.tobytes() for v in w], z=None, phi=[v.tobytes() for v in phi])

    return run


def robust_weights(r: DataFrame, alpha: float, n_iter: int, n_burnin: int, seed: int) -> DataFrame:
    """(trial, t, tau) of residuals (trial, t, r): the expected precision of each sample's noise, batch by batch, whatever the length of a trial."""
    import pandas as pd

    from ..kernels.stable import expected_precision

    def run(batches):
        for pdf in batches:
            trial, t = pdf["trial"].to_numpy(), pdf["t"].to_numpy()
            yield pd.DataFrame({"trial": trial, "t": t, "tau": expected_precision(pdf["r"].to_numpy(dtype=float), alpha, n_iter, n_burnin, seed, trial, t)})

    return r.select("trial", "t", F.col("r").cast("double").alias("r")).mapInPandas(run, "trial long, t int, tau double")
