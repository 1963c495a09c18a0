import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.plans import encode as E
from wavemill.plans import learn as L
from wavemill.plans.model import BatchCDL, GreedyCDL, OnlineCDL, atoms_table, load
from wavemill.sources import simulate

N, T, LENGTH, K = 6, 100, 16, 2


@pytest.fixture(scope="module")
def signal(spark):
    x, d, z = simulate.simulate_data(spark, N, T, LENGTH, K, 42)
    return x.cache(), d, z


def test_blocks_codes_round_trip(spark, signal):
    x, d, z = signal
    table = E.with_codes(E.blocks(x, 1, T), z, K, T - LENGTH + 1)
    got = {(r.trial, r.k, r.t): r.z for r in E.codes(table, K).collect()}
    assert got == {(r.trial, r.k, r.t): r.z for r in z.collect()}
    stats = E.Encoder(d[:, None], 0.0).statistics(table)
    assert stats.trials == N and stats.cost == pytest.approx(0, abs=1e-12) and stats.nnz.sum() == N * K


@pytest.mark.parametrize("rank1", [True, False])
def test_batch_descends(signal, rank1):
    got = L.learn(signal[0], K, LENGTH, 1, T, n_iter=4, reg=0.05, lmbd_max="scaled", rank1=rank1, random_state=0, D_init="chunk")
    assert all(b <= a * (1 + 1e-6) for a, b in zip(got.pobj, got.pobj[1:], strict=False))


def test_greedy_grows(signal):
    model = GreedyCDL(K, LENGTH, 1, T, n_iter=3, reg=0.05, random_state=0).fit(signal[0])
    assert model.D_hat_.shape == (K, 1, LENGTH)


def test_model_saves_and_transforms(spark, signal, tmp_path):
    model = BatchCDL(K, LENGTH, 1, T, n_iter=2, reg=0.05, random_state=0, D_init="chunk").fit(signal[0])
    z = model.transform(signal[0])
    assert model.transform_inverse(z).count() > 0
    model.save(spark, str(tmp_path / "m"))
    again = load(spark, str(tmp_path / "m"))
    a = {(r.trial, r.k, r.t): round(r.z, 9) for r in z.collect()}
    assert a == {(r.trial, r.k, r.t): round(r.z, 9) for r in again.transform(signal[0]).collect()}
    with pytest.raises(ValueError, match="not fitted"):
        BatchCDL(K, LENGTH, 1, T).transform(signal[0])


def test_stream_equals_partial_fits(spark, signal, tmp_path):
    from pyspark.sql import functions as F
    from wavemill.streaming.online import learn_stream, trial_stream

    new = lambda: OnlineCDL(K, LENGTH, 1, T, reg=0.1, lmbd_max="fixed", random_state=0, alpha=0.5, D_init=np.eye(K, 1 + LENGTH) + 0.1)
    by_hand, streamed = new(), new()
    for i in range(2):
        part = signal[0].where(F.col("trial") % 2 == i)
        by_hand.partial_fit(part)
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    (tmp_path / "flat").mkdir()
    for i in range(2):
        src = next((tmp_path / "in" / f"{i}").glob("*.parquet"))
        src.rename(tmp_path / "flat" / f"{i}.parquet")
        import os

        os.utime(tmp_path / "flat" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    query = learn_stream(trial_stream(spark, str(tmp_path / "flat")), streamed, str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination()
    assert np.allclose(by_hand.D_hat_, streamed.D_hat_)


def test_univariate_and_weights(spark, signal):
    x = signal[0].select("trial", "t", "x")
    got = L.learn_univariate(x, K, LENGTH, T, reg=0.05, n_iter=2, solver_z="fista", solver_z_kwargs={"max_iter": 200}, random_state=0)
    assert got.pobj[-1] <= got.pobj[0]
    fit, w = L.learn_robust(x, K, LENGTH, T, reg=0.05, n_iter_global=2, n_iter_optim=1, n_iter_mcmc=6, n_burnin_mcmc=3, solver_z="fista", solver_z_kwargs={"max_iter": 20})
    assert fit.d.shape == (K, 1, LENGTH) and w.where("w <= 0").count() == 0


def test_robust_fit_runs_all_rounds_of_its_learner(spark, sf, monkeypatch):
    """The query leaves rounds, steps and chains to the learner's defaults, and codes to the tolerance of its solver."""
    import inspect

    from wavemill.plans import model_queries as M

    seen, known = {}, inspect.signature(L.learn_robust)

    def learn_robust(*args, **kw):
        seen.update(known.bind(*args, **kw).arguments)
        return L.Learned(np.zeros((2, 1, 8)), None, np.array(0.5)), None

    monkeypatch.setattr(L, "learn_robust", learn_robust)
    M.robust_fit(spark, sf)
    for name in ("n_iter_global", "n_iter_optim", "n_iter_mcmc", "n_burnin_mcmc"):
        assert seen.get(name, known.parameters[name].default) == known.parameters[name].default, name
    assert not {"max_iter", "fixed_steps", "tol"} & set(seen["kwargs"]["solver_z_kwargs"])
    assert seen["x"].count() == spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("sum(size(embedding)) AS n").first().n


def _robust_by_hand(x, k, length, reg, alpha, rounds, steps, mcmc, burnin, seed):
    """Plain loops over whole arrays x (N, T): chains before each fit, which go on where they were; codes from zero in each round."""
    from wavemill.kernels import csc, dictionary as dic, stable

    rng, n = np.random.RandomState(seed), x.shape[1] - length + 1
    d = np.random.RandomState(seed).randn(k, length)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    r, phi = x, np.full(x.shape, 2.0)
    trial, t = np.indices(x.shape)
    for _ in range(rounds):
        tau, phi = (v.reshape(x.shape) for v in stable.expected_precision(r.ravel(), alpha, mcmc, burnin, int(rng.randint(2**31 - 1)), trial.ravel(), t.ravel(), phi.ravel(), state=True))
        w, z = 2 * tau, np.zeros((len(x), k, n))
        for _ in range(steps):
            equations, right = np.zeros((k, k, length, length)), np.zeros((k, length))
            for i in range(len(x)):
                z[i] = csc.proximal(x[i : i + 1], d[:, None], reg, z[i], w=w[i : i + 1], step="bound")
                at = lambda a, m: np.concatenate([np.zeros(m), z[i, a], np.zeros(length - 1 - m)])  # noqa: B023, E731
                for a, m in np.ndindex(k, length):
                    right[a, m] += np.sum(w[i] * x[i] * at(a, m))
                    for b, j in np.ndindex(k, length):
                        equations[a, b, m, j] += np.sum(w[i] * at(a, m) * at(b, j))
            d = dic.update_block(d, equations, right, 1)
        r = x - np.stack([csc.reconstruct(z[i], d[:, None])[0] for i in range(len(x))])
    cost = sum(csc.cost(x[i : i + 1], z[i], d[:, None], reg, w[i : i + 1]) for i in range(len(x)))
    return d, w, z, cost


def test_robust_learner_equals_plain_loops(spark, signal):
    x = signal[0].select("trial", "t", F.round("x", 3).alias("x"))
    dense = np.zeros((N, T))
    for r in x.collect():
        dense[r.trial, r.t] = r.x
    d, w, z, cost = _robust_by_hand(dense, K, 8, 0.05, 1.5, 3, 2, 8, 3, 0)
    fit, weights = L.learn_robust(x, K, 8, T, reg=0.05, alpha=1.5, n_iter_global=3, n_iter_optim=2, n_iter_mcmc=8, n_burnin_mcmc=3, solver_z="fista", solver_z_kwargs={"step": "bound"})
    assert np.allclose(fit.d[:, 0], d, atol=1e-6) and fit.pobj[-1] == pytest.approx(cost, rel=1e-6)
    got = {(r.trial, r.t): r.w for r in weights.collect()}
    assert len(got) == N * T and np.allclose([got[i, t] for i, t in np.ndindex(N, T)], w.ravel(), rtol=1e-6)
    codes = {(r.trial, r.k, r.t): r.z for r in E.codes(fit.table, K).collect()}
    assert np.allclose([codes.get(i, 0.0) for i in np.ndindex(z.shape)], z.ravel(), atol=1e-5)


def test_robust_weights_come_before_the_first_fit(spark, signal):
    x = signal[0].select("trial", "t", "x")
    fit, w = L.learn_robust(x, K, LENGTH, T, reg=0.05, n_iter_global=1, n_iter_optim=1, n_iter_mcmc=6, n_burnin_mcmc=3, solver_z="fista")
    assert w.where("w <> 1").count() > 0 and not fit.table.is_cached
    _, by_variance = L.learn_robust(x, K, LENGTH, T, reg=0.05, n_iter_global=1, n_iter_optim=1, n_iter_mcmc=1, n_burnin_mcmc=0, init_tau=True, solver_z="fista")
    assert by_variance.where("w <= 0").count() == 0
    for bad in ({"n_iter_global": 0}, {"n_iter_mcmc": 3, "n_burnin_mcmc": 3}):
        with pytest.raises(ValueError, match="n_"):
            L.learn_robust(x, K, LENGTH, T, **bad)


def test_long_signal_equals_one_block(spark):
    from wavemill.kernels import csc

    rng = np.random.RandomState(1)
    d = rng.randn(2, 1, 8)
    d /= np.sqrt((d * d).sum(axis=(1, 2), keepdims=True))
    z = np.abs(rng.randn(2, 193)) * (rng.uniform(size=(2, 193)) < 0.05)
    x = csc.reconstruct(z, d) + 0.01 * rng.randn(1, 200)
    rows = spark.createDataFrame([(0, 0, t, float(v)) for t, v in enumerate(x[0])], "trial long, channel int, t int, x double")
    got = np.zeros_like(z)
    for r in E.encode_long_signal(rows, d, 0.1, 1, 200, 40, tol=1e-4, rounds=25).collect():
        got[r.k, r.t] = r.z
    assert csc.cost(x, got, d, 0.1) == pytest.approx(csc.cost(x, csc.lgcd(x, d, 0.1, tol=1e-6), d, 0.1), rel=1e-2)


@pytest.mark.parametrize("kw,match", [({"lmbd_max": "x"}, "lmbd_max"), ({"algorithm": "x"}, "algorithm"), ({"solver_z": "x"}, "solver"), ({"solver_d": "fista"}, "rank-1"), ({"D_init": np.ones((1, 1))}, "shape"), ({"D_init": "x"}, "D_init")])
def test_options_are_checked(signal, kw, match):
    with pytest.raises(ValueError, match=match):
        L.learn(signal[0], K, LENGTH, 1, T, n_iter=1, **kw)


def test_atoms_table_holds_the_array(spark):
    d = np.arange(12.0).reshape(2, 2, 3)
    assert {(r.k, r.channel, r.l): r.d for r in atoms_table(spark, d).collect()} == {i: float(v) for i, v in np.ndenumerate(d)}


def test_encoder_contract(spark, signal):
    """Partial codes, partial statistics, another dictionary, and what is refused."""
    x, d, _ = signal
    table = E.blocks(x, 1, T).cache()
    encoder = E.Encoder(d[:, None], 0.1)
    some = spark.createDataFrame([(0,), (3,)], "trial long")
    part = encoder.encode_partial(table, some).cache()
    whole = {r.trial: r.z for r in encoder.encode(table).collect()}
    assert {r.trial: r.z for r in part.collect()} == {t: whole[t] for t in (0, 3)}
    first = encoder.statistics(part)
    second = encoder.partial_statistics(part, first, 0.5)
    assert np.allclose(second.ztz, 1.5 * first.ztz) and np.allclose(second.ztx, 1.5 * first.ztx) and second.trials == 2
    encoder.set_d(np.concatenate([encoder.d, encoder.d[:1]]))
    assert encoder.statistics(encoder.encode(table)).ztz.shape[0] == K + 1
    encoder.update_reg(table, 0.5, "per_atom")
    assert np.allclose(encoder.reg, 0.5 * E.lambda_max(table, encoder.d))
    encoder.update_reg(table, 0.5, "shared")
    assert np.allclose(encoder.reg, 0.5 * E.lambda_max(table, encoder.d).max())
    for bad in (lambda: encoder.set_d(d[:, None, :-1]), lambda: E.Encoder(d, 0.1), lambda: E.Encoder(d[:, None], [0.1] * 3), lambda: E.Encoder(d[:, None], -1.0), lambda: E.Encoder(d[:, None], 0.1, "l-bfgs", positive=False), lambda: encoder.update_reg(table, 1.0, "x")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.9, 1.0])
def test_lambda_quantile_is_over_all_places(signal, q):
    from wavemill.kernels import csc

    x, d, _ = signal
    table = E.blocks(x, 1, T).cache()
    every = np.concatenate([csc.correlate(np.frombuffer(r.x).reshape(1, -1), d[:, None]) for r in table.collect()], axis=1)
    assert np.allclose(E.lambda_max(table, d[:, None], q), np.quantile(every, q, axis=1))


def test_weighted_blocks(spark, signal):
    from pyspark.sql import functions as F

    x, d, _ = signal
    w = x.select("trial", "t").distinct().withColumn("w", F.col("t") + 1.0)
    row = E.blocks(x, 1, T, w, scale=2.0).where("trial = 1").first()
    at = {r.t: r.x for r in x.where("trial = 1").collect()}
    assert np.allclose(np.frombuffer(row.x), [at.get(t, 0.0) / 2 for t in range(T)]) and np.allclose(np.frombuffer(row.w), [t + 1.0 if t in at else 0.0 for t in range(T)])


def test_batches_hold_every_trial_once(signal):
    table = E.blocks(signal[0], 1, T).cache()
    parts = [[r.trial for r in L.batch_of(table, i, 2, N, "cyclic", 7).collect()] for i in range(3)]
    assert sorted(t for p in parts for t in p) == list(range(N))
    assert [r.trial for r in L.batch_of(table, 4, 2, N, "cyclic", 7).collect()] == parts[1]
    assert all(len(L.batch_of(table, i, 2, N, "random", 7).collect()) == 2 for i in range(3))


def test_cyclic_batches_are_slices_in_order(spark):
    """Batches of exactly the asked size, of trials with gaps in their ids, over several ranges; the last before a new pass is shorter."""
    ids = [5, -3, 1 << 40, 8, 9, 700, 31, 2, 77, 1000, 12]
    table = spark.createDataFrame([(i,) for i in ids], "trial long").repartition(3)
    ranks = L.ranked(table)
    assert [r.trial for r in ranks.orderBy("rank").collect()] == sorted(ids) and {r.rank for r in ranks.collect()} == set(range(11))
    for i in range(7):
        want = sorted(ids)[i * 4 % 11 : i * 4 % 11 + 4]
        assert sorted(r.trial for r in L.batch_of(table, i, 4, 11, "cyclic", 0, ranks).collect()) == want


def test_patches_are_cut_where_trials_are(spark):
    """More patches than trials, one trial, none; every patch is a piece of some trial."""
    rows = [(i, 0, t, float(1000 * i + t)) for i in range(3) for t in range(30)]
    x = spark.createDataFrame(rows, "trial long, channel int, t int, x double")
    source = E.Trials(E.blocks(x, 1, 30), 1, 5)
    got = source.random_patches(7, np.random.RandomState(0))
    assert got.shape == (7, 1, 5) and (np.diff(got[:, 0]) == 1).all() and len({int(p[0, 0] // 1000) for p in got[:3]}) == 3
    assert (source.random_patches(7, np.random.RandomState(0)) == got).all()
    with pytest.raises(ValueError, match="no trial"):
        E.Trials(E.blocks(x.where("trial > 9"), 1, 30), 1, 5).random_patches(1, np.random.RandomState(0))


def test_stopping():
    """Both steps must have come to rest; rises are errors where they are asked for."""
    assert L.converged(10.0, 10.0 - 1e-12, 10.0 - 2e-12, 1e-10, True)
    assert not L.converged(10.0, 9.0, 9.0, 1e-10, True) and not L.converged(10.0, 10.0, 9.0, 1e-10, True)
    assert L.converged(10.0, 11.0, 11.0, 1e-10, False)
    for values in ((10.0, 11.0, 10.0), (10.0, 9.0, 9.5)):
        with pytest.raises(RuntimeError, match="raised the objective"):
            L.converged(*values, 1e-10, True)


def test_a_fit_at_rest_stops(signal):
    """Also in an iteration that drew an atom anew, and online."""
    x = signal[0]
    got = L.learn(x, K, LENGTH, 1, T, n_iter=50, reg=0.05, lmbd_max="scaled", rank1=False, D_init="chunk", random_state=0, eps=0.05)
    assert len(got.trace) < 100
    low = L.learn(x, K, LENGTH, 1, T, n_iter=50, reg=0.05, lmbd_max="scaled", rank1=False, D_init="chunk", random_state=0, stopping_pobj=got.pobj[0])
    assert len(low.trace) == 2
    params = {"batch_size": 3, "batch_selection": "cyclic", "alpha": 0.9}
    streamed = L.learn(x, K, LENGTH, 1, T, n_iter=12, reg=0.05, lmbd_max="scaled", rank1=False, D_init="chunk", random_state=0, eps=10.0, algorithm="online", algorithm_params=params)
    assert 2 < len(streamed.trace) < 24


@pytest.mark.parametrize("how", ["greedy", "chunk", "random"])
def test_online_draws_dead_atoms_anew(spark, signal, how):
    """An atom that batch after batch does not use gives way, and its share of the sums is forgotten."""
    x, d, _ = signal
    start = np.zeros((K, 1, LENGTH))
    start[0] = d[0]
    start[1, 0, 0] = -1e-6  # fits nothing
    model = OnlineCDL(K, LENGTH, 1, T, reg=0.05, lmbd_max="fixed", random_state=0, alpha=0.5, D_init=start, rank1=False, D_resample=how)
    model.partial_fit(x.where("trial < 3"))
    assert model.learned.redrawn == 1 and (model.state.ztz[1] == 0).all() and model.state.used[1] == 4
    if how == "greedy":
        assert np.abs(model.D_hat_[1]).max() > 0.1
        model.partial_fit(x.where("trial >= 3"))
        assert model.learned.redrawn == 1 and model.state.used[1] > 2 and (model.state.ztz[1, 1] > 0).any()


def test_worst_patch_outlives_batches_and_restarts(spark, signal, tmp_path):
    """The kept patch is of the batch that was worst after decay, and it, with the uses, comes back from the state table."""
    from wavemill.streaming.online import restore, store

    x = signal[0]
    new = lambda: OnlineCDL(K, LENGTH, 1, T, reg=0.05, lmbd_max="fixed", random_state=0, alpha=0.5, D_init=np.ones((K, 1, LENGTH)) / 4, rank1=False)
    model, again = new(), new()
    model.partial_fit(x.withColumn("x", x["x"] * 10))
    patch, error = model.state.patch, model.state.error
    store(spark, model, str(tmp_path / "s"), 0)
    model.partial_fit(x)
    restore(spark, again, str(tmp_path / "s"), 1)
    assert np.allclose(again.state.used, again.state.used) and np.allclose(again.state.patch, patch) and again.state.error == pytest.approx(error)
    again.partial_fit(x)
    assert np.allclose(model.state.patch, patch) and model.state.error == pytest.approx(error / 2)
    for name in ("ztz", "ztx", "used", "l1", "patch"):
        assert np.allclose(getattr(again.state, name), getattr(model.state, name))


@pytest.mark.parametrize("how", ["greedy", "chunk", "random"])
def test_unused_atoms_are_drawn_anew(signal, how):
    """An atom that never fires gives way, however its successor is drawn."""
    start = np.zeros((K, 1, LENGTH))
    start[0] = signal[1][0]
    start[1, 0, 0] = -1e-6
    got = L.learn(signal[0], K, LENGTH, 1, T, n_iter=1, reg=0.05, rank1=False, D_init=start, D_resample=how, random_state=0, rescale=False)
    assert got.d.shape == (K, 1, LENGTH) and got.redrawn == 1
    patch = L.resampled(E.Trials(E.blocks(signal[0], 1, T), 1, LENGTH), how, start, np.random.RandomState(0)) if how != "greedy" else np.ones((1, LENGTH))
    assert patch.shape == (1, LENGTH)  # of a sparse signal it may be all zeros
    with pytest.raises(ValueError, match="D_resample"):
        L.learn(signal[0], K, LENGTH, 1, T, n_iter=1, D_resample="x")


def test_atoms_are_sorted_by_variance(signal):
    from wavemill.kernels import csc

    got = L.learn(signal[0], K, LENGTH, 1, T, n_iter=2, reg=0.05, lmbd_max="scaled", sort_atoms=True, random_state=0, D_init="chunk")
    parts = [np.concatenate([csc.reconstruct(np.frombuffer(r.z).reshape(K, -1)[k : k + 1], got.d[k : k + 1]).ravel() for r in got.table.collect()]).var() for k in range(K)]
    stats = E.Encoder(got.d, 0.0).statistics(got.table)
    assert np.allclose(L.explained_variances(got.d, stats, T), parts) and parts[0] >= parts[1] * 0.99


def test_init_dictionary(signal):
    assert L.init_dictionary(signal[0], K, LENGTH, 1, T, D_init="chunk", random_state=0).shape == (K, 1 + LENGTH)
    with pytest.raises(ValueError, match="greedy"):
        L.init_dictionary(signal[0], K, LENGTH, 1, T, D_init="greedy")


def test_loaders(spark, tmp_path):
    from wavemill.sources import files, loaders
    from wavemill.streaming.online import trial_stream

    rng = np.random.RandomState(0)
    t = np.arange(400)
    rows = [(n, p, int(i), float(np.sin(2 * np.pi * 10 * i / 100) + 0.5 * np.sin(2 * np.pi * 30 * i / 100) + 0.01 * rng.randn())) for n in range(1) for p in range(2) for i in t]
    x = spark.createDataFrame(rows, "trial long, channel int, t int, x double")
    files.write_signal(x, str(tmp_path / "x"), 2)
    got = loaders.load_data(spark, str(tmp_path / "x"), 400, 100.0, n_splits=4, notch=(30.0,), low=None).toPandas()
    assert set(got["trial"]) == {0, 1, 2, 3} and got["t"].max() == 99 and got["x"].std(ddof=0) == pytest.approx(1)
    spectrum = np.abs(np.fft.rfft(got[(got["trial"] == 1) & (got["channel"] == 0)].sort_values("t")["x"]))
    assert spectrum[10] > 20 * spectrum[30]
    events = spark.createDataFrame([(50, 1), (200, 1), (395, 1)], "sample long, event_id int")
    cut = loaders.load_data(spark, str(tmp_path / "x"), 400, 100.0, events=events, epoch=(-10, 20), low=None, to_sfreq=100.0)
    assert {r.trial for r in cut.select("trial").distinct().collect()} == {50, 200} and cut.count() == 2 * 2 * 31
    assert loaders.epochs(x, events, -10, 20, reject=0.1).count() == 0
    one = loaders.load_one_record(spark, str(tmp_path / "x"), 100.0, channels=[1], to_sfreq=50.0)
    assert one.count() == 200 and {r.channel for r in one.select("channel").distinct().collect()} == {1}
    assert loaders.load_records(spark, str(tmp_path / "x"), 1).selectExpr("stddev_pop(x)").first()[0] == pytest.approx(1)
    (tmp_path / "in").mkdir()
    x.coalesce(1).write.parquet(str(tmp_path / "flat"))
    next((tmp_path / "flat").glob("*.parquet")).rename(tmp_path / "in" / "a.parquet")
    (tmp_path / "in" / "broken.parquet").write_bytes(b"no parquet")
    seen = []
    loaders.each_record(trial_stream(spark, str(tmp_path / "in")), lambda df, i: seen.append(df.selectExpr("stddev_pop(x)").first()[0]), str(tmp_path / "check")).awaitTermination()
    assert seen == [pytest.approx(1)]
