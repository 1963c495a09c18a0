"""Signals in blocks of time against the same signals in one piece."""

import numpy as np
import pytest
from wavemill.kernels import csc
from wavemill.plans import encode as E
from wavemill.plans import learn as L
from wavemill.plans.long import LongSignal

P, T, LENGTH, K, N = 2, 150, 6, 2, 2
SCHEMA = "trial long, channel int, t int, x double"


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.RandomState(1)
    d = rng.randn(K, P, LENGTH)
    d /= np.sqrt((d * d).sum(axis=(1, 2), keepdims=True))
    z = np.abs(rng.randn(N, K, T - LENGTH + 1)) * (rng.uniform(size=(N, K, T - LENGTH + 1)) < 0.05)
    x = np.stack([csc.reconstruct(a, d) for a in z]) + 0.02 * rng.randn(N, P, T)
    x[0, :, 40:80] = 0  # a block without a sample
    rows = [(n, p, t, float(x[n, p, t])) for n in range(N) for p in range(P) for t in range(T) if x[n, p, t]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache(), x, d


def dense(rows, atoms=K):
    out = np.zeros((N, atoms, T - LENGTH + 1))
    for r in rows.collect():
        out[r.trial, r.k, r.t] = r.z
    return out


@pytest.mark.parametrize("block", [16, 64, 500])
def test_codes_and_sums_are_those_of_the_uncut_signal(spark, made, block):
    rows, x, d = made
    encoder = E.Encoder(d, 0.1, "lgcd", {"tol": 1e-6})
    with LongSignal(rows, P, T, LENGTH, block, buckets=3) as signal:
        signal.encode(encoder, 20, 1e-3)
        z = dense(signal.sparse())
        whole = np.stack([csc.lgcd(a, d, 0.1, tol=1e-6) for a in x])
        assert np.allclose(z, whole, atol=1e-2)
        # Of these codes all sums are exact, at borders too.
        table = E.with_codes(E.blocks(rows, P, T), signal.sparse(), K, T - LENGTH + 1)
        want, got = encoder.statistics(table), signal.statistics(encoder)
        for name in ("ztz", "ztx", "xtx", "nnz", "l1", "cost", "trials"):
            assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9), name
        assert np.allclose(signal.worst_patch(d), E.worst_patch(table, d, LENGTH, P))
        assert np.allclose(signal.worst_patch(None), E.worst_patch(table, None, LENGTH, P))
        assert np.allclose(signal.lambda_max(d), E.lambda_max(table, d))
        assert np.allclose(signal.lambda_max(d, 0.3), E.lambda_max(table, d, 0.3))
        assert signal.energy() == pytest.approx(E.Trials(table, P, LENGTH).energy())
        names = list(signal.tables)
    assert names and not [t for t in spark.catalog.listTables() if t.name in names]


@pytest.mark.parametrize("kw", [{"rank1": False}, {"algorithm": "greedy", "rank1": False}])
def test_learning_gives_the_atoms_of_the_uncut_signal(made, kw):
    rows, _, d = made
    start = None if "algorithm" in kw else d + 0.05
    params = {"n_iter": 2, "reg": 0.1, "D_init": start, "random_state": 0, "solver_z_kwargs": {"tol": 1e-6}, "raise_on_increase": False} | kw
    one = L.learn(rows, K, LENGTH, P, T, **params)
    cut = L.learn(rows, K, LENGTH, P, T, block=64, **params)
    assert np.allclose(cut.d, one.d, atol=1e-2)
    assert np.allclose(cut.pobj, one.pobj, rtol=1e-3)
    assert np.abs(dense(cut.table) - dense(E.codes(one.table, K))).max() < 0.1


def test_estimator_on_long_trials(spark, made):
    from wavemill.plans.model import BatchCDL

    rows, x, _ = made
    model = BatchCDL(K, LENGTH, P, T, n_iter=1, reg=0.05, D_init="chunk", random_state=0, block=64).fit(rows)
    error = x.copy()
    for r in model.transform_inverse(model.z_hat_).collect():
        error[r.trial, r.channel, r.t] -= r.x
    assert (error**2).sum() < 0.7 * (x**2).sum()


def test_only_borders_travel(spark, made):
    """One exchange, below which there are codes and no samples; its bytes do not grow with the blocks."""
    rows, _, d = made
    with LongSignal(rows, P, T, LENGTH, 50, buckets=3) as signal:
        signal.encode(E.Encoder(d, 0.1), 1)
        plan = signal.views(0, lambda *a: None, "v binary")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Bucketed: true") >= 2
        below = plan[plan.index("Exchange hashpartitioning") :]
        assert "x#" not in below.split("FileScan")[1]
        for block in (0, 1):
            sizes = [len(r.border) for r in signal._borders(block).collect()]
            assert sizes and max(sizes) <= 8 * K * (LENGTH - 1)


def test_blocks_at_rest_are_not_solved_again(spark, made):
    rows, _, d = made
    with LongSignal(rows, P, T, LENGTH, 50) as signal:
        encoder = E.Encoder(d, 0.1, "lgcd", {"tol": 1e-6})
        assert signal.encode(encoder, 20, 1e-2) < 20
        before = dense(signal.sparse())
        assert signal.encode(encoder, 20, 1e-2) <= 2
        assert np.allclose(dense(signal.sparse()), before, atol=1e-2)
        more = np.concatenate([d, d[:1, ::-1]])  # another atom: codes are kept
        signal.encode(E.Encoder(more, 0.1, "lgcd", {"tol": 1e-6}), 1, 1e-2)
        assert signal.statistics(E.Encoder(more, 0.1)).nnz.shape == (K + 1,)
        signal.forget()
        assert signal.sparse().count() == 0 and signal.statistics(E.Encoder(d, 0.1)).cost == pytest.approx(signal.energy())


def test_refit_and_refusals(spark, made):
    rows, x, d = made
    with LongSignal(rows, P, T, LENGTH, 64) as signal:
        encoder = E.Encoder(d, 0.2, "lgcd", {"tol": 1e-6})
        signal.encode(encoder, 3, 1e-2)
        first = dense(signal.sparse())
        signal.encode(encoder, 3, 1e-2, unbiased=True)
        second = dense(signal.sparse())
        assert ((second != 0) <= (first != 0)).all() and second.sum() > first.sum()
    for bad in (lambda: LongSignal(rows, P, T, LENGTH, 11), lambda: LongSignal(rows, P, 5, LENGTH, 64), lambda: L.learn(rows, K, LENGTH, P, T, block=64, algorithm="online")):
        with pytest.raises(ValueError):
            bad()


def test_no_trial(spark):
    with LongSignal(spark.createDataFrame([], SCHEMA), P, T, LENGTH, 64) as signal:
        signal.encode(E.Encoder(np.ones((1, P, LENGTH)), 0.1))
        assert signal.sparse().count() == 0 and signal.statistics(E.Encoder(np.ones((1, P, LENGTH)), 0.1)).trials == 0
        with pytest.raises(ValueError, match="no trial"):
            signal.worst_patch(None)
