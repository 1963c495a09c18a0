"""Estimators: fit, transform and back, with models that are saved as Parquet and JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import dictionary as dic
from ..operators import convolution as C
from . import encode as E
from .learn import Learned, learn
from ..operators.shared import settled


class ConvolutionalDictionaryLearning:
    """Base of the estimators; parameters are those of ``learn`` and the shape of the signal."""

    algorithm = "batch"
    defaults: dict = {"lmbd_max": "scaled", "solver_z": "lgcd"}

    def __init__(self, n_atoms: int, n_times_atom: int, channels: int, times: int, **params) -> None:
        self.n_atoms, self.n_times_atom, self.channels, self.times = n_atoms, n_times_atom, channels, times
        self.unbiased = params.pop("unbiased_z_hat", False)
        self.algorithm_params = {k: params.pop(k) for k in ("alpha", "batch_size", "batch_selection") if k in params}
        self.params = self.defaults | params
        self.learned: Learned | None = None

    def fit(self, x: DataFrame):
        """Learns from a long signal (trial, channel, t, x)."""
        self.learned = learn(x, self.n_atoms, self.n_times_atom, self.channels, self.times, algorithm=self.algorithm, algorithm_params=self.algorithm_params, **self.params)
        return self

    def fit_transform(self, x: DataFrame) -> DataFrame:
        return self.fit(x).z_hat_

    def _fitted(self) -> Learned:
        if self.learned is None:
            raise ValueError(f"{type(self).__name__} is not fitted yet")
        return self.learned

    def transform(self, x: DataFrame) -> DataFrame:
        """The code (trial, k, t, z) of a signal on the learned dictionary; the signal is not rescaled, the regularisation was."""
        got = self._fitted()
        encoder = E.Encoder(got.d, got.reg, self.params["solver_z"], self.params.get("solver_z_kwargs") or {})
        table = encoder.encode(E.blocks(x, self.channels, self.times), warm=False)
        if self.unbiased:
            table = encoder.encode(table, unbiased=True)
        return E.codes(table, len(got.d))

    def transform_inverse(self, z: DataFrame) -> DataFrame:
        """The reconstruction (trial, channel, t, x) of a code: one join with the dictionary, one sum."""
        return C.reconstruct(z, atoms_table(z.sparkSession, self._fitted().d))

    @property
    def D_hat_(self) -> np.ndarray:
        return self._fitted().d

    @property
    def uv_hat_(self) -> np.ndarray:
        uv = self._fitted().uv
        return dic.rank1(self._fitted().d) if uv is None else uv

    @property
    def u_hat_(self) -> np.ndarray:
        return self.uv_hat_[:, : self.channels]

    @property
    def v_hat_(self) -> np.ndarray:
        return self.uv_hat_[:, self.channels :]

    @property
    def z_hat_(self) -> DataFrame:
        got = self._fitted()
        z = got.table if "k" in got.table.columns else E.codes(got.table, len(got.d))  # long trials have a sparse code already
        return z.withColumn("z", F.col("z") * got.scale)

    @property
    def pobj_(self) -> list[float]:
        return self._fitted().pobj

    @property
    def times_(self) -> list[float]:
        return [t[3] for t in self._fitted().trace]

    def save(self, spark: SparkSession, path: str) -> None:
        """dictionary/, trace/, activations/ as Parquet and params as one JSON row."""
        got = self._fitted()
        atoms_table(spark, got.d).write.mode("overwrite").parquet(f"{path}/dictionary")
        spark.createDataFrame(got.trace or [(0, "init", 0.0, 0.0)], "iter int, step string, objective double, seconds double").write.mode("overwrite").parquet(f"{path}/trace")
        if got.table is not None:
            self.z_hat_.write.mode("overwrite").parquet(f"{path}/activations")
        plain = {k: v for k, v in self.params.items() if isinstance(v, (str, int, float, bool, type(None), dict))}
        about = {"class": type(self).__name__, "n_atoms": self.n_atoms, "n_times_atom": self.n_times_atom, "channels": self.channels, "times": self.times, "params": plain, "reg": np.ravel(got.reg).tolist()}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def load(spark: SparkSession, path: str) -> ConvolutionalDictionaryLearning:
    """A saved estimator, ready to transform."""
    about = json.loads(spark.read.text(f"{path}/params").first()[0])
    kind = {c.__name__: c for c in (BatchCDL, GreedyCDL, OnlineCDL)}[about["class"]]
    model = kind(about["n_atoms"], about["n_times_atom"], about["channels"], about["times"], **about["params"])
    rows = spark.read.parquet(f"{path}/dictionary").toPandas()  # a dictionary
    d = np.zeros((about["n_atoms"], about["channels"], about["n_times_atom"]))
    d[rows["k"], rows["channel"], rows["l"]] = rows["d"]
    model.learned = Learned(d, None, np.array(about["reg"]) if len(about["reg"]) > 1 else np.array(about["reg"][0]))
    return model


def atoms_table(spark: SparkSession, d: np.ndarray) -> DataFrame:
    """The long dictionary (k, channel, l, d) of an array."""
    k, p, l = np.indices(d.shape)
    return spark.createDataFrame(list(zip(k.ravel().tolist(), p.ravel().tolist(), l.ravel().tolist(), d.ravel().tolist(), strict=True)), "k int, channel int, l int, d double")


class BatchCDL(ConvolutionalDictionaryLearning):
    """Alternates over all trials."""


class GreedyCDL(ConvolutionalDictionaryLearning):
    """Adds one atom an iteration, where the reconstruction misses most."""

    algorithm = "greedy"


class OnlineCDL(ConvolutionalDictionaryLearning):
    """Takes a batch of trials an iteration and decays what it knew by ``alpha``; partial_fit takes the batch from the caller."""

    algorithm = "online"
    defaults = ConvolutionalDictionaryLearning.defaults | {"raise_on_increase": False}
    state: E.Statistics | None = None
    _d: np.ndarray | None = None

    def partial_fit(self, batch: DataFrame) -> DataFrame:
        """One step on a batch of trials, which the caller has normalised; returns their code.

        A batch of zero codes decays the statistics and leaves the dictionary alone, until an atom has been out of use for too long.
        """
        from . import learn as L

        p = self.params
        rank1 = p.get("rank1", True)
        solver = L.DictionarySolver.of(self.channels, p.get("solver_d", "auto"), p.get("uv_constraint", "auto"), rank1, p.get("window", False), p.get("solver_d_kwargs"))
        part = E.Trials(settled(E.blocks(batch, self.channels, self.times)), self.channels, self.n_times_atom)
        rng = np.random.RandomState(p.get("random_state"))
        if self._d is None:
            self._d = L.initial_dictionary(part, self.n_atoms, p.get("D_init"), rank1, solver.constraint, solver.window, p.get("random_state"))
            reg = p.get("reg", 0.1)
            if p["lmbd_max"] == "scaled":
                reg = reg * part.lambda_max(solver.full(self._d)).max()
            self.learned = Learned(solver.full(self._d), None, np.asarray(reg))
        got = self.learned
        encoder = E.Encoder(got.d, got.reg, p["solver_z"], p.get("solver_z_kwargs") or {})
        self._d, self.state, redrawn = L.online_step(part, encoder, solver, self._d, self.state, self.algorithm_params.get("alpha", 0.8), p.get("D_resample", "greedy"), rng)
        got.redrawn += redrawn is not None
        got.d = solver.full(self._d)
        got.uv = dic.flip(self._d, self.channels) if rank1 else None
        got.trace.append((len(got.trace), "partial", float(self.state.cost), 0.0))
        got.table = part.table
        return E.codes(part.table, len(got.d))
