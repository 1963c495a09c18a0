"""Series in blocks against whole ones, and tables that are computed once."""

import os

import numpy as np
import pytest
from wavemill.kernels import signal as S
from wavemill.operators import series as SE
from wavemill.sources.memo import Memo

SCHEMA = "trial long, channel int, t int, x double"
T = 700


@pytest.fixture(scope="module")
def made(spark):
    x = np.random.RandomState(0).randn(2, 2, T).cumsum(axis=2)
    rows = [(n, p, t, float(x[n, p, t])) for n in range(2) for p in range(2) for t in range(T)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache(), x


def dense(rows, times):
    out = np.full((2, 2, times), np.nan)
    for r in rows.collect():
        assert np.isnan(out[r.trial, r.channel, r.t])
        out[r.trial, r.channel, r.t] = r.x
    return out


@pytest.mark.parametrize("block", [101, 333, 5000])
def test_filter_in_blocks(made, block):
    rows, x = made
    got = dense(SE.band(rows, 100.0, 2.0, 20.0, 101, T, block), T)
    want = np.apply_along_axis(S.fir_filter, 2, x, 100.0, 2.0, 20.0, 101)
    assert np.allclose(got, want)


def test_absent_samples_are_zeros(spark, made):
    _, x = made
    hole = x.copy()
    hole[:, :, 150:180] = 0
    rows = spark.createDataFrame([(n, p, t, float(hole[n, p, t])) for n in range(2) for p in range(2) for t in range(T) if not 150 <= t < 180], SCHEMA)
    assert np.allclose(dense(SE.band(rows, 100.0, None, 20.0, 31, None, 100), T), np.apply_along_axis(S.fir_filter, 2, hole, 100.0, None, 20.0, 31))
    assert SE.band(rows.where("t < 0"), 100.0, None, 20.0, 31).count() == 0


def test_series_shorter_than_the_filter(spark):
    rows = spark.createDataFrame([(0, 0, t, float(t * t)) for t in range(9)], SCHEMA)
    got = [r.x for r in SE.fir(rows, S.fir_taps(1.0, None, 0.2, 11)).orderBy("t").collect()]
    assert np.allclose(got, S.fir_filter(np.arange(9.0) ** 2, 1.0, None, 0.2, 11))
    assert SE.fir(rows, np.ones(41) / 41).count() == 9
    with pytest.raises(ValueError, match="odd"):
        SE.fir(rows, np.ones(4))


def test_convolution_in_pieces():
    rng = np.random.RandomState(0)
    for taps in (3, 65, 201):
        for n in (taps, taps + 1, 5000):
            x, h = rng.randn(n), rng.randn(taps)
            assert np.allclose(S.convolved(x, h), np.convolve(x, h, "valid"))


def test_notch_and_resampling(spark):
    t = np.arange(2000)
    x = np.sin(2 * np.pi * 5 * t / 200) + np.sin(2 * np.pi * 50 * t / 200)
    rows = spark.createDataFrame([(0, 0, int(i), float(v)) for i, v in zip(t, x)], SCHEMA)
    quiet = np.array([r.x for r in SE.without_line(rows, 200.0, 50.0, 2.0, 2000, 700).orderBy("t").collect()])
    assert np.abs(quiet - np.sin(2 * np.pi * 5 * t / 200))[400:1600].max() < 0.02
    for to in (80.0, 300.0):
        out = SE.resampled(rows, 200.0, to, 2000, 300).orderBy("t").collect()
        m = np.array([r.t for r in out])
        assert (m == np.arange(2000 * to / 200)).all()
        want = np.sin(2 * np.pi * 5 * m / to) + (np.sin(2 * np.pi * 50 * m / to) if to > 100 else 0)
        assert np.abs(np.array([r.x for r in out]) - want)[50:-50].max() < 0.03
    one = SE.resampled(rows, 200.0, 80.0, 2000, 10_000).orderBy("t").collect()
    cut = SE.resampled(rows, 200.0, 80.0, 2000, 300).orderBy("t").collect()
    assert np.allclose([r.x for r in one], [r.x for r in cut])


def test_periodogram_by_windows(made):
    rows, x = made
    got = np.zeros((2, 2, 64))
    for r in SE.periodogram(rows, 64, 48, times=T).collect():
        got[r.trial, r.channel, r.f] = r.power
    assert np.allclose(got, np.apply_along_axis(S.periodogram, 2, x, 64, 48))
    model = {(r.trial, r.channel, r.i): r.a for r in SE.ar_models(SE.periodogram(rows, 64, 48, times=T), 64, 4).collect()}
    assert np.allclose([model[1, 0, i] for i in range(4)], S.yule_walker(got[1, 0], 4)[0])
    with pytest.raises(ValueError, match="shorter"):
        SE.periodogram(rows, T + 1, times=T)


def test_loader_in_blocks(spark, made, tmp_path):
    from wavemill.sources import files, loaders

    rows, _ = made
    files.write_signal(rows, str(tmp_path / "x"), 2)
    a, b = (loaders.load_data(spark, str(tmp_path / "x"), T, 100.0, n_splits=7, low=3.0, block=block).collect() for block in (None, 150))
    at = {(r.trial, r.channel, r.t): r.x for r in a}
    assert len(a) == len(b) and all(abs(at[r.trial, r.channel, r.t] - r.x) < 1e-9 for r in b)
    assert loaders.load_one_record(spark, str(tmp_path / "x"), 100.0, to_sfreq=50.0, notch=(30.0,), block=400).where("trial = 0 AND channel = 1").count() == T // 2


def doubled(spark, path, factor=2.0):
    return spark.read.parquet(path).selectExpr("trial", f"x * {factor} AS x")


def test_memo(spark, made, tmp_path):
    """An equal second call runs no job; another parameter, a changed, added or removed file and other code do."""
    rows, _ = made
    source, memo = str(tmp_path / "in"), Memo(spark, str(tmp_path / "memo"))
    rows.where("t < 5").coalesce(2).write.parquet(source)
    tracker = spark.sparkContext.statusTracker()

    def jobs(call):
        group = os.urandom(4).hex()
        spark.sparkContext.setJobGroup(group, group)
        try:
            return call(), len(tracker.getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    first, n = jobs(lambda: memo.table(doubled, [source]))
    again, m = jobs(lambda: memo.table(doubled, [source], factor=2.0))  # the default, said aloud
    assert n > 0 and m == 0 and again.inputFiles() == first.inputFiles() and again.schema == first.schema
    assert sorted(r.x for r in again.collect()) == pytest.approx(sorted(2 * r.x for r in rows.where("t < 5").collect()))
    assert jobs(lambda: memo.table(doubled, [source], factor=3.0))[1] > 0
    assert jobs(lambda: Memo(spark, str(tmp_path / "memo")).table(doubled, [source], factor=3.0))[1] == 0
    some = next((tmp_path / "in").glob("*.parquet"))
    os.utime(some, (1_000_000_000, 1_000_000_000))
    assert jobs(lambda: memo.table(doubled, [source]))[1] > 0
    rows.where("t = 6").coalesce(1).write.mode("append").parquet(source)
    changed, n = jobs(lambda: memo.table(doubled, [source]))
    assert n > 0 and changed.count() == 24
    table = spark.read.parquet(source)
    assert memo.key(doubled, [source], {"factor": table}) == memo.key(doubled, [source], {"factor": spark.read.parquet(source)})
    assert memo.key(doubled, [source], {"factor": table}) != memo.key(doubled, [source], {"factor": table.where("t = 1")})
    with pytest.raises(ValueError, match="no key"):
        memo.key(doubled, [source], {"factor": spark.createDataFrame([(1,)], "a int")})
    with pytest.raises(FileNotFoundError):
        memo.table(doubled, [source + "x"])
    with pytest.raises(TypeError):
        memo.key(doubled, [source], {"factor": object()})
    memo.forget()
    assert jobs(lambda: memo.table(doubled, [source]))[1] > 0


def test_memo_keeps_nothing_of_a_failure(spark, made, tmp_path):
    rows, _ = made
    source, memo = str(tmp_path / "in"), Memo(spark, str(tmp_path / "memo"))
    rows.where("t < 2").write.parquet(source)

    def fails(spark, path):
        return spark.read.parquet(path).selectExpr("raise_error('no') AS x")

    for _ in range(2):
        with pytest.raises(Exception, match="no"):
            memo.table(fails, [source])
    assert not list((tmp_path / "memo").glob("*/made.json"))
