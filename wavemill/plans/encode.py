"""The encoding step over a DataFrame of trials.

A block table holds one row for each trial, its samples as packed doubles; encoding it is a narrow map, so iterations shuffle
nothing but their sums. Sufficient statistics leave each task already summed, one row for each Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_dimensions, check_same_length
from ..kernels import csc
from ..operators.shared import settled

BLOCKS = "trial long, x binary, w binary, z binary"
#: Bytes of dense rows that a task makes at once.
CHUNK = 8 << 20


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches of a block table in slices of about CHUNK bytes."""
    for pdf in batches:
        few = max(1, CHUNK // max(1, len(pdf["x"].iloc[0]))) if len(pdf) else 1
        for start in range(0, len(pdf), few):
            yield pdf.iloc[start : start + few]


def blocks(x: DataFrame, channels: int, times: int, w: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """(trial, x, w, z) of a long signal over ``scale``; absent samples are zeros, w (trial, t, w) are sample weights, z is null.

    A trial's samples are gathered on the JVM as (place, value) pairs; Python only lays them out, many trials at a time.
    """
    rows = x.select("trial", (F.col("channel") * times + F.col("t")).cast("int").alias("i"), F.col("x").cast("double").alias("v"))
    if w is not None:
        rows = rows.unionByName(w.select("trial", (F.lit(channels * times) + F.col("t")).cast("int").alias("i"), F.col("w").cast("double").alias("v")))
    packed = rows.groupBy("trial").agg(F.collect_list(F.struct("i", "v")).alias("at"))
    size, weighted = channels * times, w is not None

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            bounds, pairs = lists.offsets.to_numpy(), lists.values
            place, value = (pairs.field(c).to_numpy(zero_copy_only=False)[pairs.offset :] for c in (0, 1))
            few = max(1, CHUNK // (8 * size))  # dense rows take far more memory than the samples of a batch
            for start in range(0, batch.num_rows, few):
                xs, ws = [], []
                for a, b in zip(bounds[start : start + few], bounds[start + 1 : start + few + 1]):
                    row = np.zeros(size + times * weighted)
                    row[place[a:b]] = value[a:b]
                    xs.append((row[:size] / scale).tobytes())
                    ws.append(row[size:].tobytes() if weighted else None)
                columns = [batch.column(0).slice(start, few), *(pa.array(c, pa.binary()) for c in (xs, ws, [None] * len(xs)))]
                yield pa.RecordBatch.from_arrays(columns, names=["trial", "x", "w", "z"])

    return packed.mapInArrow(lay, BLOCKS)


def _array(raw, rows: int) -> np.ndarray | None:
    return None if raw is None else np.frombuffer(raw, dtype=float).reshape(rows, -1)


def stacked(pdf: pd.DataFrame, k: int, channels: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """x (B, P, T), w (B, T) and codes (B, K, n), zeros where there are none, of weighted block rows; None if trials are long or of several lengths."""
    sizes = set(pdf["w"].map(len))
    times = min(sizes) // 8
    n = times - length + 1
    if len(sizes) > 1 or n < 1 or channels * times * k * n > csc.DENSE:
        return None
    x, w = (np.frombuffer(b"".join(pdf[c])).reshape(len(pdf), -1) for c in ("x", "w"))
    empty = bytes(8 * k * n)
    z = np.frombuffer(b"".join(z if z is not None and len(z) == len(empty) else empty for z in pdf["z"]))
    return x.reshape(len(pdf), channels, times), w, z.reshape(len(pdf), k, n)


@dataclass
class Encoder:
    """Encodes blocks with a dictionary (K, P, L) and a regularisation of one value or one for each atom."""

    d: np.ndarray
    reg: np.ndarray | float
    solver: str = "lgcd"
    options: dict = field(default_factory=dict)
    positive: bool = True

    def __post_init__(self) -> None:
        if self.solver not in (*csc.SOLVERS, "l_bfgs"):
            raise ValueError(f"solver_z must be one of {', '.join(csc.SOLVERS)}, not {self.solver!r}")
        check_dimensions(np.shape(self.d), "kpl")
        if np.size(self.reg) != 1:
            check_same_length(regularisations=np.ravel(self.reg), atoms=self.d)
        if np.min(self.reg) < 0:
            raise ValueError("the regularisation must not be negative")
        if not self.positive and self.solver in ("l-bfgs", "l_bfgs"):
            raise ValueError("l-bfgs codes are positive; use lgcd, ista or fista")

    def encode(self, table: DataFrame, warm: bool = True, unbiased: bool = False) -> DataFrame:
        """The block table with new codes; ``unbiased`` refits them on their support without regularisation."""
        d, reg, solver, options, positive = self.d, self.reg, self.solver, dict(self.options), self.positive
        k, channels, length = d.shape
        dtd = csc.gram(d)
        steps: dict[int, float] = {}
        own_step = solver in ("ista", "fista") and not options.get("step") and not options.get("adaptive")
        abreast, bound = solver in ("ista", "fista") and not options.get("adaptive"), options.get("step") == "bound"

        def step(n: int) -> float:
            """The step for n places without weights, found once for all trials of a task."""
            if n not in steps:
                steps[n] = 0.99 / csc.lipschitz(d, None, n)
            return steps[n]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in _slices(batches):
                if abreast and len(pdf) and pdf["w"].notna().all() and (several := stacked(pdf, k, channels, length)):
                    x, w, z = several
                    given = options | ({"step": step(x.shape[2] - length + 1) / csc.largest_weights(w)} if bound else {})
                    new = csc.proximal_many(x, d, 0.0 if unbiased else reg, w, z if warm or unbiased else None, positive=positive, frozen=unbiased, momentum=solver == "fista", **given)
                    yield pdf.assign(z=[row.tobytes() for row in new])
                    continue
                out, own = [], [None] * len(pdf)
                if own_step and pdf["w"].notna().all() and pdf["w"].map(len).nunique() == 1:
                    own = 0.99 / csc.lipschitz_weighted(d, np.stack([np.frombuffer(w) for w in pdf["w"]]))
                for x, w, z, by in zip(pdf["x"], pdf["w"], pdf["z"], own, strict=True):
                    x, w = _array(x, channels), _array(w, 1)
                    start = _array(z, k) if z is not None and len(z) and len(z) % (8 * k) == 0 else None
                    extra = {"dtd": dtd} if solver in ("lgcd", "ista", "fista") else {}
                    if by is not None:
                        extra["step"] = float(by)
                    elif bound or own_step and w is None:
                        extra["step"] = step(x.shape[1] - d.shape[2] + 1) / (1.0 if w is None else float(csc.largest_weights(w)[0]))
                    new = csc.encode(x, d, 0.0 if unbiased else reg, start if warm or unbiased else None, solver, positive, unbiased, w, **(options | extra))
                    out.append(np.ascontiguousarray(new).tobytes())
                yield pdf.assign(z=out)

        return table.mapInPandas(run, table.schema)

    def set_d(self, d: np.ndarray) -> None:
        """Takes another dictionary, of the same channels and length; a regularisation for each atom must fit it."""
        check_dimensions(d.shape, "kpl", p=self.d.shape[1], l=self.d.shape[2])
        if np.size(self.reg) != 1:
            check_same_length(regularisations=np.ravel(self.reg), atoms=d)
        self.d = d

    def update_reg(self, table: DataFrame, share: float, mode: str) -> None:
        """The regularisation as a share of the present lambda max: of all atoms ("scaled", "shared") or of each ("per_atom")."""
        if mode not in ("fixed", "scaled", "shared", "per_atom"):
            raise ValueError(f"mode must be fixed, scaled, shared or per_atom, not {mode!r}")
        if mode == "fixed":
            self.reg = np.asarray(share, dtype=float)
            return
        top = lambda_max(table, self.d)
        self.reg = np.asarray(share, dtype=float) * (top if mode == "per_atom" else top.max())

    def encode_partial(self, table: DataFrame, trials: DataFrame) -> DataFrame:
        """The blocks of some trials (a table with a trial column) with new codes, from zero."""
        return self.encode(table.join(trials.select("trial"), "trial", "left_semi"), warm=False)

    def partial_statistics(self, table: DataFrame, older: Statistics | None, alpha: float) -> Statistics:
        """Sums over the table's trials plus alpha times older ones."""
        new = self.statistics(table)
        new.used = new.nnz.astype(float)
        if older is not None:
            new.ztz, new.ztx, new.xtx = new.ztz + alpha * older.ztz, new.ztx + alpha * older.ztx, new.xtx + alpha * older.xtx
            new.l1, new.used = new.l1 + alpha * older.l1, new.used + alpha * (older.nnz if older.used is None else older.used)
        return new

    def statistics(self, table: DataFrame) -> Statistics:
        """Sums over all trials."""
        d, reg = self.d, np.broadcast_to(np.asarray(self.reg, dtype=float).reshape(-1), (self.d.shape[0],))
        k, channels, length = d.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                total = np.zeros(k * k * (2 * length - 1) + k * channels * length + 2 * k + 3)
                for x, w, z in zip(pdf["x"], pdf["w"], pdf["z"], strict=True):
                    x, w, z = _array(x, channels), _array(w, 1), _array(z, k)
                    ztz, ztx = csc.statistics(z, x, length)
                    own = [ztz.ravel(), ztx.ravel(), np.count_nonzero(z, axis=1), np.abs(z).sum(axis=1), [np.sum(x * x), csc.cost(x, z, d, reg, w), 1.0]]
                    total += np.concatenate(own)
                if len(pdf):
                    yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        summed = table.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # as large as the statistics
        return unpacked(summed, k, channels, length)

    def trial_costs(self, table: DataFrame) -> DataFrame:
        """(trial, nnz, loss, explained): the share of the trial's energy that its reconstruction takes away."""
        d, reg = self.d, np.broadcast_to(np.asarray(self.reg, dtype=float).reshape(-1), (self.d.shape[0],))
        k, channels, _ = d.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for trial, x, w, z in zip(pdf["trial"], pdf["x"], pdf["w"], pdf["z"], strict=True):
                    x, w, z = _array(x, channels), _array(w, 1), _array(z, k)
                    r, power = x - csc.reconstruct(z, d), float(np.sum(x * x))
                    rows.append((trial, np.count_nonzero(z), csc.cost(x, z, d, reg, w), 1 - float(np.sum(r * r)) / power if power else 0.0))
                yield pd.DataFrame(rows, columns=["trial", "nnz", "loss", "explained"])

        return table.mapInPandas(run, "trial long, nnz long, loss double, explained double")


def unpacked(summed: pd.DataFrame, k: int, channels: int, length: int) -> Statistics:
    """Statistics of their numbers (i, v) in one row: ztz, ztX, activations and their sum by atom, energy, cost, trials."""
    a, b = k * k * (2 * length - 1), k * channels * length
    v = np.zeros(a + b + 2 * k + 3)
    v[summed["i"]] = summed["v"]
    return Statistics(v[:a].reshape(k, k, -1), v[a : a + b].reshape(k, channels, length), v[-3], v[a + b : a + b + k].astype(int), v[a + b + k : a + b + 2 * k], v[-2], int(v[-1]))


@dataclass
class Statistics:
    """Sums over trials; ``used`` and ``patch`` (with its ``error``) are what online learning knows of earlier batches besides."""

    ztz: np.ndarray
    ztx: np.ndarray
    xtx: float
    nnz: np.ndarray
    l1: np.ndarray
    cost: float
    trials: int
    used: np.ndarray | None = None
    patch: np.ndarray | None = None
    error: float = 0.0


class Trials:
    """A block table and its codes, for learners; ``LongSignal`` is the same for signals that are cut in time."""

    def __init__(self, table: DataFrame, channels: int, length: int) -> None:
        self.table, self.channels, self.length = table, channels, length

    def encode(self, encoder: Encoder, warm: bool = True, unbiased: bool = False) -> None:
        self.table = settled(encoder.encode(self.table, warm, unbiased))

    def statistics(self, encoder: Encoder) -> Statistics:
        return encoder.statistics(self.table)

    def worst_patch(self, d: np.ndarray | None) -> np.ndarray:
        return worst_patch(self.table, d, self.length, self.channels)

    def lambda_max(self, d: np.ndarray) -> np.ndarray:
        return lambda_max(self.table, d)

    def random_patches(self, n: int, rng: np.random.RandomState) -> np.ndarray:
        return cut_patches(self.table.select("trial", "x"), ["trial"], self.channels, self.length, n, rng)

    def energy(self) -> float:
        """Half the (weighted) sum of all squares: the cost of no codes."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                squares = [np.frombuffer(x) ** 2 for x in pdf["x"]]
                yield pd.DataFrame({"v": [0.5 * sum(float(np.sum(s)) if w is None else float(np.sum(s.reshape(-1, len(w) // 8) * np.frombuffer(w))) for s, w in zip(squares, pdf["w"], strict=True))]})

        return self.table.select("x", "w").mapInPandas(run, "v double").agg(F.coalesce(F.sum("v"), F.lit(0.0))).first()[0]


def cut_patches(table: DataFrame, key: list[str], channels: int, length: int, n: int, rng: np.random.RandomState) -> np.ndarray:
    """(n, P, L): patches at random places of random rows (key, x), of different ones as far as there are so many.

    Rows are picked by a hash of their key and cut on the executors: the driver sees n keys and n patches.
    """
    order = F.xxhash64(*key, F.lit(int(rng.randint(2**31 - 1))))
    drawn = table.select(*key).orderBy(order, *key).limit(n).collect()
    if not drawn:
        raise ValueError("there is no trial to take a patch from")
    places = rng.uniform(size=n)
    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in key)
    wanted = table.sparkSession.createDataFrame([(*drawn[i % len(drawn)], i, float(u)) for i, u in enumerate(places)], f"{kinds}, i int, u double")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, u in zip(pdf["x"], pdf["u"], strict=True):
                x = _array(x, channels)
                t = int(u * (x.shape[1] - length + 1))
                out.append(np.ascontiguousarray(x[:, t : t + length]).tobytes())
            yield pd.DataFrame({"i": pdf["i"], "patch": out})

    patches = {r.i: r.patch for r in table.join(wanted, key).mapInPandas(cut, "i int, patch binary").collect()}
    return np.stack([np.frombuffer(patches[i]).reshape(channels, length) for i in range(n)])


def codes(table: DataFrame, atoms: int) -> DataFrame:
    """The sparse long code (trial, k, t, z) of a block table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for trial, raw in zip(pdf["trial"], pdf["z"], strict=True):
                z = _array(raw, atoms)
                k, t = np.nonzero(z)
                yield pd.DataFrame({"trial": trial, "k": k.astype(np.int32), "t": t.astype(np.int32), "z": z[k, t]})

    return table.select("trial", "z").mapInPandas(run, "trial long, k int, t int, z double")


def with_codes(table: DataFrame, z: DataFrame, atoms: int, valid: int) -> DataFrame:
    """A block table with the codes of a long one put in."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((atoms, valid))
        dense[pdf["k"], pdf["t"]] = pdf["z"]
        return pd.DataFrame({"trial": [pdf["trial"].iloc[0]], "z": [dense.tobytes()]})

    packed = z.groupBy("trial").applyInPandas(pack, "trial long, z binary")
    empty = np.zeros((atoms, valid)).tobytes()
    return table.drop("z").join(packed, "trial", "left").select("trial", "x", "w", F.coalesce("z", F.lit(empty)).alias("z"))


def worst_patch(table: DataFrame, d: np.ndarray | None, length: int, channels: int) -> np.ndarray:
    """(P, L): the signal where the reconstruction misses most; ties go to the first trial and start."""
    return worst_patch_error(table, d, length, channels)[0]


def worst_patch_error(table: DataFrame, d: np.ndarray | None, length: int, channels: int) -> tuple[np.ndarray, float]:
    """The worst patch and its squared error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for trial, x, z in zip(pdf["trial"], pdf["x"], pdf["z"], strict=True):
                x = _array(x, channels)
                r = x if d is None or z is None else x - csc.reconstruct(_array(z, d.shape[0]), d)
                e = np.convolve((r * r).sum(axis=0), np.ones(length), "valid")
                t = int(e.argmax())
                yield pd.DataFrame({"trial": [trial], "e": [float(e[t])], "patch": [np.ascontiguousarray(x[:, t : t + length]).tobytes()]})

    best = table.mapInPandas(run, "trial long, e double, patch binary").orderBy(F.desc("e"), "trial").limit(1).collect()
    if not best:
        raise ValueError("there is no trial to take a patch from")
    return np.frombuffer(best[0].patch, dtype=float).reshape(channels, length).copy(), best[0].e


def lambda_max(table: DataFrame, d: np.ndarray, q: float = 1.0) -> np.ndarray:
    """(K,): each atom's largest correlation with the (weighted) signal over all trials and places, or its q-quantile over them."""
    k, channels, _ = d.shape

    def correlations(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        for x, w in zip(pdf["x"], pdf["w"], strict=True):
            x, w = _array(x, channels), _array(w, 1)
            yield csc.correlate(x if w is None else w * x, d)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in correlations(pdf):
                yield pd.DataFrame({"k": np.arange(k), "lo": c.min(axis=1), "hi": c.max(axis=1), "n": c.shape[1]})

    found = table.mapInPandas(ends, "k int, lo double, hi double, n long").groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toPandas().set_index("k")
    if found.empty:
        return np.zeros(k)
    lo, hi, n = (found[c].reindex(range(k)).to_numpy() for c in ("lo", "hi", "n"))
    if q >= 1.0:
        return hi.astype(float)
    rank = q * (n - 1)
    below = np.floor(rank).astype(int)
    share = rank - below
    values = _nth(table, correlations, np.tile(np.arange(k), 2), np.tile(lo, 2), np.tile(hi, 2), np.append(below, below + (share > 0)))
    return np.where(share > 0, values[:k] + share * (values[k:] - values[:k]), values[:k])


def _nth(table: DataFrame, correlations, atoms: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray, bins: int = 4096) -> np.ndarray:
    """The values of ranks (from 0) of atoms: histograms over ever narrower ranges, until one value is left in each.

    A round counts all ranks at once and sends a histogram for each range and task; equal values count together, so ties need no further
    rounds, and ranks that lie in one range share it.
    """
    lo, hi, below = lo.astype(float).copy(), hi.astype(float).copy(), np.zeros(len(atoms), dtype=np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        ranges = sorted({(int(atoms[i]), lo[i], hi[i]) for i in open_})
        edges = [np.unique(np.linspace(a, b, bins + 1)) for _, a, b in ranges]

        def count(batches: Iterator[pd.DataFrame], ranges=ranges, edges=edges) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for c in correlations(pdf):
                    for j, ((a, _, _), e) in enumerate(zip(ranges, edges, strict=True)):
                        v = np.sort(c[a][(c[a] >= e[0]) & (c[a] <= e[-1])])
                        at, first, n = np.unique(np.searchsorted(e, v, side="right"), return_index=True, return_counts=True)
                        yield pd.DataFrame({"j": j, "i": at, "n": n, "lo": v[first], "hi": v[first + n - 1]})

        sums = table.mapInPandas(count, "j int, i int, n long, lo double, hi double").groupBy("j", "i").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()  # bins rows a range
        found = {j: mine.sort_values("i") for j, mine in sums.groupby("j")}
        for i in open_:
            mine = found[ranges.index((int(atoms[i]), lo[i], hi[i]))]
            upto = below[i] + mine["n"].cumsum().to_numpy()
            at = min(int(np.searchsorted(upto, rank[i], side="right")), len(mine) - 1)
            below[i] = upto[at] - mine["n"].iloc[at]
            lo[i], hi[i] = mine["lo"].iloc[at], mine["hi"].iloc[at]
    return lo


def encode_long_signal(x: DataFrame, d: np.ndarray, reg: float, channels: int, times: int, block: int, tol: float = 1e-3, rounds: int = 60) -> DataFrame:
    """The code of signals too long for one task: (trial, k, t, z), by blocks of at least two atom lengths (``LongSignal``).

    It ends when a round of all blocks moves nothing by more than the tolerance.
    """
    from .long import LongSignal

    with LongSignal(x, channels, times, d.shape[2], block) as signal:
        signal.encode(Encoder(d, reg, "lgcd", {"tol": tol}), rounds, tol)
        return settled(signal.sparse())
