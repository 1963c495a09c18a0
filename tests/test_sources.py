"""Sources, sinks and operators that no query holds against SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.functions import columns as K
from wavemill.kernels import signal as S
from wavemill.operators import analytics as A
from wavemill.operators import convolution as C
from wavemill.operators import preprocess as P
from wavemill.sources import files, simulate


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.RandomState(0)
    rows = [(n, p, t, float(rng.randn())) for n in range(5) for p in range(2) for t in range(40)]
    return spark.createDataFrame(rows, "trial long, channel int, t int, x double").cache()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_records_are_listed_without_being_read(spark, tmp_path):
    for name in ("s1/rest/1.fif", "s1/rest/2.fif", "s1/task/1.fif", "s2/rest/3.fif", "readme"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    got = {(r.data_type, r.subject): list(r.runs) for r in files.scan_records(spark, str(tmp_path / "in")).collect()}
    assert {k: v for k, v in got.items() if k[1] in ("s1", "s2")} == {("rest", "s1"): ["1", "2"], ("task", "s1"): ["1"], ("rest", "s2"): ["3"]}


def test_signals_and_results_come_back(spark, signal, tmp_path):
    path = str(tmp_path / "x")
    files.write_signal(signal, path, 3)
    assert rows(files.read_signal(spark, path)) == rows(signal)
    signal.coalesce(1).write.option("header", "true").csv(str(tmp_path / "csv"))
    assert rows(files.read_long_csv(spark, str(tmp_path / "csv"))) == rows(signal)
    result = spark.createDataFrame([("lgcd", 1.5)], "method string, seconds double")
    files.write_results(result, str(tmp_path / "r"))
    files.write_results(result, str(tmp_path / "r"))
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == [("lgcd", 1.5)] * 2


def test_picked_trials_are_the_same_in_every_run(signal):
    a, b, c = (rows(files.pick_trials(x, 2, seed)) for x, seed in ((signal, 3), (signal.repartition(7), 3), (signal, 4)))
    assert a == b and len({r[0] for r in a}) == 2 and len({r[0] for r in c}) == 2


def test_splits_are_tapered(signal):
    plain, soft = ({r[:3]: r[3] for r in rows(P.split_signal(signal, 40, 3, taper))} for taper in (False, True))
    assert set(plain) == set(soft) and max(k[2] for k in plain) == 12
    n, edge = 13, 0.1 * 12 / 2
    for (trial, p, t), v in soft.items():
        w = 0.5 * (1 + np.cos(np.pi * (t / edge - 1))) if t < edge else 0.5 * (1 + np.cos(np.pi * ((n - 1 - t) / edge - 1))) if t > n - 1 - edge else 1.0
        assert v == pytest.approx(w * plain[trial, p, t], abs=1e-12)


def test_shape_checks(signal):
    assert P.as_univariate(signal.where("channel = 0").drop("channel")).columns == ["trial", "channel", "t", "x"]
    assert P.as_multivariate(signal.where("trial = 0").drop("trial")).columns == ["trial", "channel", "t", "x"]
    for bad in (lambda: P.as_univariate(signal), lambda: P.as_multivariate(signal), lambda: P.as_univariate(signal.select("t", "x"))):
        with pytest.raises(ValueError, match="column"):
            bad()


def test_zero_mean_shapes(spark):
    for shape in ("triangle", "square", "sin", "cos"):
        x = np.array([r.x for r in simulate.shapes_table(spark, shape, 24, 2, zero_mean=True).orderBy("l").collect()])
        assert len(x) == 24 and abs(x.mean()) < 1e-12 and np.ptp(x) > 0.999


@pytest.mark.parametrize("length,cycles", [(24, 2), (33, 2), (7, 3), (10, 1)])
def test_shapes_by_their_definition(spark, length, cycles):
    """Ramps whose ends are both samples, halves of 0.5 and -0.5, and waves whose last sample ends their last period."""
    half = length // (2 * cycles)
    ramp = np.linspace(0, 1, half)
    turn = 2 * np.pi * cycles * np.linspace(0, 1, length)
    want = {"triangle": [*ramp, *ramp[::-1]] * cycles, "square": ([0.5] * half + [-0.5] * half) * cycles, "sin": np.sin(turn), "cos": np.cos(turn)}
    for shape, x in want.items():
        got = [r.x for r in simulate.shapes_table(spark, shape, length, cycles).orderBy("l").collect()]
        assert np.allclose(got, np.pad(np.asarray(x, dtype=float), (0, length - len(x))))


def test_uniform_and_gaussian_numbers(spark):
    got = spark.range(20_000).select(K.uniform("a", "id").alias("u"), K.gaussian("a", "id").alias("g")).toPandas()
    assert got["u"].between(0, 1).all() and abs(got["u"].mean() - 0.5) < 0.01 and got["u"].is_unique
    assert abs(got["g"].mean()) < 0.03 and abs(got["g"].std() - 1) < 0.03


def test_power_spectrum():
    x = np.cos(2 * np.pi * 3 * np.arange(32) / 32)
    assert S.power_spectrum(x).argmax() == 3 and S.power_spectrum(x)[3] == pytest.approx(256)


def test_patch_errors_agree(signal):
    r = signal.withColumnRenamed("x", "r")
    energy = r.groupBy("trial", "t").agg(F.sum(F.col("r") * F.col("r")).alias("e"))
    a, b, c = ({x[:2]: x[2] for x in rows(f.select("trial", "t", "e"))} for f in (C.patch_error(r, 6, 40), C.running_patch_error(r, 6, 40), C.patch_error(energy, 6, 40)))
    assert set(a) == set(b) == set(c) and all(a[k] == pytest.approx(b[k]) == pytest.approx(c[k]) for k in a)


@pytest.mark.parametrize("channels", [2, C.MOST_WIDE + 1])
def test_channels_as_columns_or_rows_are_alike(spark, channels):
    """Reconstruction, residual, its energy and correlations against NumPy, for few and for many channels, one of them without atoms."""
    from wavemill.kernels import csc
    from wavemill.plans.model import atoms_table

    rng = np.random.RandomState(0)
    d, z = rng.randn(2, channels, 4), rng.randn(2, 20) * (rng.uniform(size=(2, 20)) < 0.3)
    x = rng.randn(channels + 1, 23)
    signal = spark.createDataFrame([(0, p, t, float(v)) for (p, t), v in np.ndenumerate(x)], "trial long, channel int, t int, x double")
    codes = spark.createDataFrame([(0, int(k), int(t), float(z[k, t])) for k, t in zip(*np.nonzero(z))], "trial long, k int, t int, z double")
    atoms = atoms_table(spark, d)
    hat = np.zeros_like(x)
    hat[:channels] = csc.reconstruct(z, d)
    got = np.zeros_like(x)
    for r in C.residual(signal, codes, atoms).collect():
        got[r.channel, r.t] = r.r
    assert np.allclose(got, x - hat)
    energy = {r.t: r.e for r in C.residual_energy(signal, codes, atoms).collect()}
    assert np.allclose([energy[t] for t in range(23)], ((x - hat) ** 2).sum(axis=0))
    found = np.zeros((2, 20))
    for r in C.atom_correlation(signal, atoms, 20).collect():
        found[r.k, r.t] = r.c
    assert np.allclose(found, csc.correlate(x[:channels], d))


def test_sparse_atoms_give_the_same_rows_in_both_layouts(spark, monkeypatch):
    """Atoms on different channels and with gaps, a signal on one of them: rows where they meet, and every atom in lambda max."""
    from wavemill.operators import objective as O

    x = spark.createDataFrame([(n, p, t, float(n + t + 1)) for n in range(2) for p, t in ((0, 3), (0, 9), (2, 5))], "trial long, channel int, t int, x double")
    z = spark.createDataFrame([(0, 0, 2, 1.0), (1, 1, 4, 2.0)], "trial long, k int, t int, z double")
    d = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 2, -1.0), (1, 1, 0, 2.0), (1, 1, 3, 1.0), (2, 2, 1, 5.0), (2, 0, 0, 1.0)], "k int, channel int, l int, d double")
    found = []
    for most in (32, 0):
        monkeypatch.setattr(C, "MOST_WIDE", most)
        sets = [sorted(map(tuple, f.collect())) for f in (
            C.atom_correlation(x, d, 9), O.gradient_z(x, z, d, 0.5, 9), C.residual(x, z, d), C.residual_energy(x, z, d), C.reconstruct(z, d),
            O.lambda_max(x, d, 9, x), O.lambda_max(x, d, 9, x, 0.8), O.ista_step(x, z, d, 0.5, 0.1, 9),
        )]
        found.append(sets)
    assert found[0] == found[1] and all(found[0])
    assert not [r for r in found[0][0] if r[1] == 1] and [r[0] for r in found[0][5]] == [0, 1, 2] and found[0][5][1][1] == 0.0


def test_surrogates_lie_on_the_axis(spark):
    events = spark.createDataFrame([(i, 10 * i) for i in range(20)], "epoch long, sample long")
    got = A.surrogate_events(events, 7, 300, -3, 8, 5).toPandas()
    assert len(got) == 140 and got["sample"].between(3, 291).all() and got.groupby("surrogate").size().eq(20).all()


def test_windowed_energy_of_a_stream(spark, tmp_path):
    from wavemill.streaming.online import windowed_energy

    part = spark.createDataFrame([("2024-01-01 00:10:00", 0, 2.0), ("2024-01-01 00:50:00", 0, 1.0), ("2024-01-01 01:10:00", 0, 3.0), ("2024-01-01 00:20:00", 1, 1.0)], "ts string, channel int, x double")
    part.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, channel int, x double").parquet(str(tmp_path / "in"))
    query = windowed_energy(stream).writeStream.format("memory").queryName("energies").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window.start.hour, r.channel): (r.power, r.n) for r in spark.table("energies").collect()}
    assert got == {(0, 0): (5.0, 2), (1, 0): (9.0, 1), (0, 1): (1.0, 1)}
