import numpy as np
import pytest
from wavemill.kernels import csc, motifs, signal, stable
from wavemill.kernels import dictionary as dic


@pytest.fixture
def data():
    rng = np.random.RandomState(42)
    return rng, rng.randn(3, 100), dic.project_d(rng.randn(4, 3, 6)), 0.5


def test_gram_is_naive(data):
    _, _, d, _ = data
    k, _, length = d.shape
    got = csc.gram(d)
    for i in range(k):
        for j in range(k):
            for lag in range(1 - length, length):
                want = sum(d[i, :, l] @ d[j, :, l + lag] for l in range(length) if 0 <= l + lag < length)
                assert np.isclose(got[i, j, length - 1 + lag], want)


@pytest.mark.parametrize("solver,options", [("fista", {"tol": 1e-8}), ("ista", {"tol": 1e-8}), ("l-bfgs", {"tol": 1e-7}), ("lgcd", {"tol": 1e-6, "strategy": "random"}), ("lgcd", {"tol": 1e-6, "strategy": "cyclic"}), ("lgcd", {"tol": 1e-6, "n_seg": 1})])
def test_solvers_agree(data, solver, options):
    _, x, d, reg = data
    best = csc.cost(x, csc.lgcd(x, d, reg, tol=1e-7), d, reg)
    assert np.isclose(csc.cost(x, csc.encode(x, d, reg, solver=solver, **options), d, reg), best, rtol=1e-5)


def test_lgcd_is_optimal(data):
    _, x, d, reg = data
    tol = 1e-5
    z = csc.lgcd(x, d, reg, tol=tol)
    g = csc.gradient(x, z, d) + reg
    norm = (d * d).sum(axis=(1, 2))[:, None] * tol * x.std() + 1e-9
    assert (np.abs(g)[z > tol * x.std()] <= np.broadcast_to(norm, g.shape)[z > tol * x.std()]).all()
    assert (g[z == 0] >= -np.broadcast_to(norm, g.shape)[z == 0]).all()


def test_frozen_support(data):
    _, x, d, reg = data
    z = csc.lgcd(x, d, reg)
    for solver in csc.SOLVERS:
        again = csc.encode(x, d, 0.0, z, solver, frozen=True)
        assert not again[z == 0].any()
        assert csc.cost(x, again, d, 0.0) <= csc.cost(x, z, d, 0.0) + 1e-6


def test_weights_scale_the_regularisation(data):
    _, x, d, reg = data
    w = np.full((1, x.shape[1]), 2.0)
    a = csc.lbfgs(x, d, 2 * reg, w=w, tol=1e-8)
    assert np.isclose(csc.cost(x, a, d, reg), csc.cost(x, csc.lbfgs(x, d, reg, tol=1e-8), d, reg), rtol=1e-6)


def test_statistics_give_the_cost_and_its_gradient(data):
    rng, x, d, reg = data
    z = csc.lgcd(x, d, reg)
    ztz, ztx = csc.statistics(z, x, 6)
    xtx = float((x * x).sum())
    assert np.isclose(dic.fit_cost(d, ztz, ztx, xtx), csc.cost(x, z, d, 0.0))
    e = rng.randn(*d.shape) * 1e-6
    numeric = (dic.fit_cost(d + e, ztz, ztx, xtx) - dic.fit_cost(d - e, ztz, ztx, xtx)) / 2
    assert np.isclose(numeric, np.sum((dic.apply_ztz(ztz, d) - ztx) * e), rtol=1e-5)


@pytest.mark.parametrize("solver,constraint", [("joint", "joint"), ("joint", "separate"), ("alternate", "separate"), ("alternate_adaptive", "separate")])
@pytest.mark.parametrize("window", [False, True])
def test_rank1_steps_descend(data, solver, constraint, window):
    rng, x, d, reg = data
    z = csc.lgcd(x, d, reg)
    ztz, ztx = csc.statistics(z, x, 6)
    w = np.concatenate([np.ones(3), dic.tukey(6)]) if window else 1.0
    uv = dic.project_uv(rng.randn(4, 9) * w, 3, constraint)
    new = dic.update_uv(uv, 3, ztz, ztx, float((x * x).sum()), solver, constraint, window=window)
    value = lambda u: dic.fit_cost(dic.full(u, 3), ztz, ztx, float((x * x).sum()))
    assert value(new) <= value(uv) + 1e-9
    assert np.allclose(dic.project_uv(new, 3, constraint), new)


def test_unit_norm_problems_agree():
    rng = np.random.RandomState(0)
    a = rng.randn(10, 10)
    a = a @ a.T
    for scale in (0.01, 5.0):
        b = rng.randn(10) * scale
        assert np.allclose(dic.unit_norm_dual(a, b), dic.unit_norm_primal(a, b, max_iter=50_000), atol=1e-5)


def test_rank1_and_flip(data):
    rng = data[0]
    uv = dic.flip(rng.randn(4, 9), 3)
    v = uv[:, 3:]
    assert (v[np.arange(4), np.abs(v).argmax(axis=1)] > 0).all()
    assert np.allclose(dic.full(dic.rank1(dic.full(uv, 3)), 3), dic.full(uv, 3))
    assert dic.recovery_score(v, v[::-1]) == pytest.approx(0)


def test_signal_kernels():
    t = np.arange(256) / 64.0
    x = np.sin(2 * np.pi * 8 * t)
    assert np.allclose(signal.envelope(x), 1, atol=0.2)
    assert np.abs(signal.notch(x, 64, 8, 2)).max() < 1e-9
    assert np.abs(signal.fir_filter(x, 64, 4, 12)[60:-60] - x[60:-60]).max() < 0.05
    assert np.abs(signal.fir_filter(x, 64, 16, 28)[60:-60]).max() < 0.05
    assert len(signal.resample(x, 128)) == 128
    rng = np.random.RandomState(0)
    a = np.array([0.5, -0.3])
    y = np.zeros(20_000)
    for i, e in enumerate(rng.randn(20_000)):
        y[i] = e + (a @ y[i - 2 : i][::-1] if i > 1 else 0)
    found, variance = signal.yule_walker(signal.periodogram(y, 512), 2)
    assert np.allclose(found, a, atol=0.05) and abs(variance - 1) < 0.1
    assert np.allclose(signal.parcor_to_ar(signal.ar_to_parcor(a)), a)
    assert [signal.next_power_of_two(n) for n in (0, 1, 2, 3, 64, 65)] == [1, 1, 2, 4, 64, 128]


def test_stable_weights_shrink_outliers():
    r = np.concatenate([np.zeros(50), np.full(50, 30.0)])
    tau = stable.expected_precision(r, 1.5, 200, 100, 0)
    assert tau[:50].mean() > 5 * tau[50:].mean()
    key = stable.key(3, 0, np.arange(200_000))
    u = [stable.drawn(key, 0, i) for i in range(3)]
    assert all(abs(v.mean() - 0.5) < 3e-3 and abs(v.var() - 1 / 12) < 1e-3 for v in u) and np.abs(np.corrcoef(u) - np.eye(3)).max() < 0.01
    s = stable.positive_stable(0.75, u[0], u[1])
    assert np.isclose(np.exp(-s).mean(), np.exp(-1), atol=5e-3)


def test_motifs_recover_a_shape():
    rng = np.random.RandomState(0)
    shape = np.sin(2 * np.pi * np.arange(16) / 16) * np.hanning(16)
    shape /= np.linalg.norm(shape)
    x = 0.02 * rng.randn(20, 100)
    for row in x:
        at = rng.randint(85)
        row[at : at + 16] += shape
    atom = motifs.motif_atoms(x, 1, 16, 20, seed=3)[0]
    assert np.abs(np.correlate(atom, shape, "full")).max() > 0.8
    _, starts, costs = motifs.match_windows(x.ravel()[:800], 16, 4, 6, 500)
    assert len(starts) == 6 and (np.diff(starts) > 4).all() and len(costs)


def test_chains_do_not_depend_on_batches():
    r = np.random.RandomState(0).randn(40)
    trial, t = np.repeat([-3, 1 << 40], 20), np.tile(np.arange(20), 2)
    whole = stable.expected_precision(r, 1.4, 20, 5, 11, trial, t)
    order = np.random.RandomState(1).permutation(40)
    parts = np.concatenate([stable.expected_precision(r[p], 1.4, 20, 5, 11, trial[p], t[p]) for p in np.split(order, [7, 19])])
    assert np.array_equal(whole[order], parts) and len(set(whole)) > 20
    with pytest.raises(ValueError):
        stable.expected_precision(r, 1.4, 5, 5, 0)


def test_moved_windows_cost_what_the_closed_form_says():
    rng = np.random.RandomState(0)
    x = rng.randn(500).cumsum()
    windows = motifs.Windows(x, np.arange(0, 400, 40), 25)
    for _ in range(200):
        k, start = rng.randint(10), rng.randint(476)
        cost, new = windows.moved(k, start)
        windows.move(k, start, new)
        assert windows.cost == pytest.approx(cost) == pytest.approx(motifs.window_cost(x, windows.starts, 25))
    pairs = [np.sum((motifs.scored(x, a, 25) - motifs.scored(x, b, 25)) ** 2) for i, a in enumerate(windows.starts) for b in windows.starts[i + 1 :]]
    assert windows.cost == pytest.approx(np.sum(pairs) / (25 * 9))


def test_matching_keeps_gaps_and_says_when_there_is_no_room():
    x = np.sin(np.arange(600) / 5) + 0.1 * np.random.RandomState(0).randn(600)
    _, starts, costs = motifs.match_windows(x, 30, 15, max_iter=800, temperature=0.05, cooling=True)
    assert len(starts) == len(range(0, 570, 30)) and (np.diff(starts) > 15).all() and costs[-1] < costs[0] / 2
    with pytest.raises(ValueError, match="no place"):
        motifs.match_windows(x, 30, 600, starts=np.array([0, 570]), max_iter=50)
    with pytest.raises(ValueError, match="two windows"):
        motifs.match_windows(x, 30, 290, n_windows=1)


def test_adaptive_proximal_steps_agree(data):
    _, x, d, reg = data
    best = csc.cost(x, csc.lgcd(x, d, reg, tol=1e-7), d, reg)
    for solver in ("ista", "fista"):
        assert np.isclose(csc.cost(x, csc.encode(x, d, reg, solver=solver, tol=1e-8, adaptive=True), d, reg), best, rtol=1e-5)
    with pytest.raises(ValueError, match="positive"):
        csc.encode(x, d, reg, solver="l-bfgs", positive=False)


@pytest.mark.parametrize("weighted", [False, True])
def test_gram_operator(data, weighted):
    rng, x, d, _ = data
    n = x.shape[1] - 5
    w = np.abs(rng.randn(x.shape[1])) if weighted else None
    op = csc.GramOperator(d, n, w)
    z = rng.randn(4, n)
    r = csc.reconstruct(z, d)
    assert np.allclose(op @ z.ravel(), csc.correlate(r if w is None else w * r, d).ravel())
    small = csc.GramOperator(d, 10, None if w is None else w[:15])
    full = small.dense()
    assert np.allclose(full, full.T) and np.linalg.eigvalsh(full)[0] > -1e-9
    assert np.isclose(csc.lipschitz(d, None if w is None else w[None, :15], 10), np.linalg.eigvalsh(full)[-1], rtol=1e-3)
    with pytest.raises(ValueError, match="samples"):
        csc.GramOperator(d, 10, np.ones(3))


@pytest.mark.parametrize("scale", [0.01, 1.0, 10.0])
def test_joint_dual_is_optimal(scale):
    rng = np.random.RandomState(0)
    z = np.abs(rng.randn(3, 60)) * (rng.uniform(size=(3, 60)) < 0.3)
    ztz, ztx = csc.statistics(z, csc.reconstruct(z, rng.randn(3, 1, 6) * scale) + 0.1 * rng.randn(1, 65), 6)
    blocks = dic.toeplitz_blocks(ztz)
    d = dic.update_joint_dual(blocks, ztx[:, 0])
    step = 1 / np.linalg.eigvalsh(blocks.transpose(0, 2, 1, 3).reshape(18, 18))[-1]
    moved = dic.project_d(d[:, None] - step * (dic.apply_ztz(ztz, d[:, None]) - ztx))
    assert np.abs(moved[:, 0] - d).max() < 1e-6 and np.linalg.norm(d, axis=1).max() <= 1 + 1e-9


def test_step_searches_and_windowers(data):
    rng, x, d, reg = data
    z = csc.lgcd(x, d, reg)
    ztz, ztx = csc.statistics(z, x, 6)
    args = (ztz, ztx, float((x * x).sum()))
    start = dic.project_d(rng.randn(*d.shape))
    a, b = (dic.fit_cost(dic.update_full(start, *args, max_iter=500, momentum=False, search=how), *args) for how in ("bound", "doubling"))
    assert np.isclose(a, b, rtol=1e-4) and b < dic.fit_cost(start, *args)
    with pytest.raises(ValueError, match="search"):
        dic.update_full(start, *args, search="x")
    win = dic.Windower(True, 6)
    assert np.allclose(win.remove(win.apply(d))[:, :, 1:-1], d[:, :, 1:-1]) and np.allclose(dic.Windower(False, 6, 3).apply(np.ones((1, 9))), 1)


def test_alternate_takes_the_step_of_its_curvature(data):
    """With enough steps both alternate solvers reach the same point of u, from where v goes on."""
    rng, x, d, reg = data
    z = csc.lgcd(x, d, reg)
    ztz, ztx = csc.statistics(z, x, 6)
    args = (ztz, ztx, float((x * x).sum()))
    uv = dic.project_uv(rng.randn(4, 9), 3)
    a, b = (dic.update_uv(uv, 3, *args, solver, "separate", max_iter=5000, tol=1e-14) for solver in ("alternate", "alternate_adaptive"))
    assert np.isclose(dic.fit_cost(dic.full(a, 3), *args), dic.fit_cost(dic.full(b, 3), *args), rtol=1e-4)


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.RandomState(0)
    for n, m in [(1, 1), (3, 3), (4, 6)]:
        loss = rng.randn(n, m)
        found = dic.assignment(loss)
        assert loss[np.arange(n), found].sum() == pytest.approx(min(sum(loss[i, p[i]] for i in range(n)) for p in permutations(range(m), n)))


def test_outer_sums_add_up():
    x, atom = np.random.RandomState(0).randn(10, 40), np.random.RandomState(1).randn(8)
    assert np.allclose(motifs.outer_sum(x[:4], atom) + motifs.outer_sum(x[4:], atom), motifs.outer_sum(x, atom))


def test_checks():
    from wavemill.functions import checks as C

    assert C.check_dimensions((2, 3, 4), "NPT", P=3) == (2, 3, 4) and C.check_same_length(a=[1], b=[2]) == 1
    assert C.check_random_state(3).randint(100) == np.random.RandomState(3).randint(100)
    for bad in (lambda: C.check_dimensions((2, 3), "NPT"), lambda: C.check_dimensions((2, 3), "NT", T=4), lambda: C.check_random_state("x"), lambda: C.check_same_length(a=[1], b=[])):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("ties", [False, True])
def test_quantiles_by_rank(spark, ties):
    """Against NumPy, with zeros that are left out, ties, nulls and a group of one."""
    from wavemill.operators.quantiles import quantiles

    rng = np.random.RandomState(0)
    values = {0: rng.randint(-3, 4, 500) if ties else rng.randn(500), 1: rng.randn(7), 2: np.array([5.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [(1, None)]
    zeros = spark.createDataFrame([(0, 90), (1, 0)], "g int, n long")
    values[0] = np.append(values[0], np.zeros(90))
    qs = {"a": 0.0, "b": 0.3, "c": 0.5, "d": 1.0}
    got = quantiles(spark.createDataFrame(rows, "g int, x double"), ["g"], "x", qs, zeros).collect()
    assert {r.g for r in got} == {0, 1, 2}
    for r in got:
        assert np.allclose([r[n] for n in qs], np.quantile(values[r.g], list(qs.values())))
    assert quantiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", qs).count() == 0
