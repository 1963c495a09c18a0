"""Encoders of many trials: steps found once, gradients by the Gram matrix, dense rows a few at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.kernels import csc
from wavemill.plans import encode as E


def _problem(seed: int = 0):
    rng = np.random.RandomState(seed)
    return rng, rng.randn(2, 3, 6), rng.randn(3, 40)


@pytest.mark.parametrize("solver", ["ista", "fista"])
def test_gram_gradient_gives_the_same_codes(solver):
    _, d, x = _problem()
    plain = csc.encode(x, d, 0.5, None, solver, tol=1e-6, max_iter=200)
    assert np.allclose(csc.encode(x, d, 0.5, None, solver, dtd=csc.gram(d), tol=1e-6, max_iter=200), plain, atol=1e-10)
    z = np.random.RandomState(1).randn(2, 35)
    assert np.allclose(csc.gram_gradient(x, d, csc.gram(d))(z), csc.gradient(x, z, d))


@pytest.mark.parametrize("weighted", [False, True])
def test_tables_get_the_codes_of_single_trials(spark, weighted):
    rng, d, _ = _problem()
    xs, w = rng.randn(7, 3, 40), rng.uniform(0.1, 3, size=(7, 40))
    rows = [(n, p, t, float(xs[n, p, t])) for n, p, t in np.ndindex(xs.shape)]
    weights = spark.createDataFrame([(n, t, float(w[n, t])) for n, t in np.ndindex(w.shape)], "trial long, t int, w double") if weighted else None
    table = E.blocks(spark.createDataFrame(rows, "trial long, channel int, t int, x double"), 3, 40, weights)
    got = E.Encoder(d, 0.5, "fista", {"tol": 1e-6, "max_iter": 100}).encode(table)
    for r in got.collect():
        want = csc.encode(xs[r.trial], d, 0.5, None, "fista", w=w[r.trial : r.trial + 1] if weighted else None, tol=1e-6, max_iter=100)
        assert np.allclose(np.frombuffer(r.z).reshape(2, -1), want, atol=1e-8)


def test_many_rows_of_weights_have_the_curvatures_of_each():
    rng, d, _ = _problem(2)
    w = rng.uniform(0, 3, size=(9, 40))
    w[3] = 0.0
    assert np.allclose(csc.lipschitz_weighted(d, w), [csc.lipschitz(d, row[None], 35) for row in w], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("kw", [{}, {"momentum": False}, {"restart": True}, {"positive": False}, {"fixed_steps": 7}, {"max_iter": 3}, {"frozen": True}, {"step": 0.005}, {"step": "bound"}])
@pytest.mark.parametrize("channels", [1, 2])
def test_trials_solved_side_by_side_are_as_one_by_one(kw, channels, monkeypatch):
    rng = np.random.RandomState(5)
    d, x, w = rng.randn(3, channels, 6), rng.randn(9, channels, 30), rng.uniform(0.1, 2, (9, 30))
    w[4] = 0.0
    z0 = np.abs(rng.randn(9, 3, 25)) * (rng.uniform(size=(9, 3, 25)) < 0.3)
    monkeypatch.setattr(csc, "ABREAST", 300)  # in several parts
    for start in (None, z0):
        got = csc.proximal_many(x, d, [0.1, 0.2, 0.3], w, start, **kw)
        for i in range(len(x)):
            alone = csc.proximal(x[i], d, [0.1, 0.2, 0.3], None if start is None else start[i], w=w[i : i + 1], **kw)
            assert np.allclose(got[i], alone, atol=1e-9)


def test_a_step_by_a_bound_leads_to_the_same_codes(spark, monkeypatch):
    """Of trials side by side and one by one, never longer than by the curvature itself."""
    rng, d, _ = _problem()
    xs, w = rng.randn(5, 40), rng.uniform(0.1, 3, size=(5, 40))
    assert (csc.bound_step(d[:, :1], 35, w) <= 0.99 / csc.lipschitz_weighted(d[:, :1], w) + 1e-12).all()
    x = spark.createDataFrame([(n, 0, t, float(xs[n, t])) for n, t in np.ndindex(xs.shape)], "trial long, channel int, t int, x double")
    table = E.blocks(x, 1, 40, spark.createDataFrame([(n, t, float(w[n, t])) for n, t in np.ndindex(w.shape)], "trial long, t int, w double")).cache()
    want = {n: csc.encode(xs[n : n + 1], d[:, :1], 0.5, None, "fista", w=w[n : n + 1], tol=1e-9) for n in range(5)}
    for side_by_side in (True, False):
        encoder = E.Encoder(d[:, :1], 0.5, "fista", {"tol": 1e-9, "step": "bound", "restart": True})
        if not side_by_side:
            monkeypatch.setattr(E, "stacked", lambda *_: None)
        for r in encoder.encode(table).collect():
            assert np.allclose(np.frombuffer(r.z).reshape(2, -1), want[r.trial], atol=1e-5)


def test_dense_rows_are_made_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 8 * 3 * 40 * 2)
    x = spark.range(9).select(F.col("id").alias("trial"), F.lit(1).alias("channel"), F.lit(7).alias("t"), (F.col("id") + 1.0).alias("x"))
    found = {r.trial: np.frombuffer(r.x) for r in E.blocks(x.coalesce(1), 3, 40).collect()}
    assert sorted(found) == list(range(9)) and all(v[47] == n + 1 and np.count_nonzero(v) == 1 for n, v in found.items())
    sizes = [len(p) for p in E._slices([__import__("pandas").DataFrame({"x": [b"0" * 960] * 5})])]
    assert sizes == [2, 2, 1]
