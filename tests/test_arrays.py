"""Array files of every layout, in one range and in many."""

import struct
import zlib

import numpy as np
import pytest
from wavemill.sources import arrays as A


@pytest.fixture(scope="module")
def session(spark):
    return A.register(spark)


def dense(rows, shape):
    out = np.full(shape, np.nan)
    for r in rows:
        assert np.isnan(out[r.trial, r.channel, r.t])
        out[r.trial, r.channel, r.t] = r.x
    return out


@pytest.mark.parametrize("kind,order", [("<f8", "C"), (">f4", "F"), ("<i2", "F"), ("|u1", "C")])
def test_npy(session, tmp_path, kind, order):
    x = (np.random.RandomState(0).randn(3, 2, 50) * 50).astype(kind)
    path = str(tmp_path / "x.npy")
    np.save(path, np.asarray(x, order=order))
    for split in (64, 1 << 20):
        df = session.read.format("npy").option("splitBytes", split).load(path)
        assert np.array_equal(dense(df.collect(), x.shape), x)
        assert df.rdd.getNumPartitions() == -(-x.nbytes // split)


def test_npy_axes_and_folders(session, tmp_path):
    x = np.arange(40.0).reshape(4, 10)
    for i in range(3):
        np.save(tmp_path / f"part{i}.npy", x + 100 * i)
    np.save(tmp_path / "one.npy", x[0])
    as_trials = session.read.format("npy").option("axes", "trial,t").load(str(tmp_path / "part1.npy"))
    assert np.array_equal(dense(as_trials.collect(), (4, 1, 10))[:, 0], x + 100)
    assert np.array_equal(dense(session.read.format("npy").load(str(tmp_path / "one.npy")).collect(), (1, 1, 10))[0, 0], x[0])
    many = session.read.format("npy").load(str(tmp_path / "part*.npy"))
    assert {r[0][-9:]: r[1] for r in many.groupBy("file").sum("x").collect()} == {f"part{i}.npy": x.sum() + 4000 * i for i in range(3)}
    assert session.read.format("npy").load(f"file://{tmp_path}/one.npy").count() == 10
    np.save(tmp_path / "none.npy", np.zeros((0, 5)))
    assert session.read.format("npy").load(str(tmp_path / "none.npy")).count() == 0
    (tmp_path / "bad.npy").write_bytes(b"no array")
    np.save(tmp_path / "text.npy", np.array(["a"]))
    (tmp_path / "short.npy").write_bytes((tmp_path / "one.npy").read_bytes()[:-4])
    for name, option in (("bad", ""), ("text", ""), ("one", "trial,t"), ("absent", ""), ("short", "")):
        with pytest.raises(Exception, match="no NPY|not real|do not fit|absent|ends before"):
            reader = session.read.format("npy")
            (reader.option("axes", option) if option else reader).load(str(tmp_path / f"{name}.npy")).collect()


def element(kind, data, end="<"):
    if len(data) <= 4 and kind != 14:
        return struct.pack(end + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(end + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, x, number, kind, held=6, end="<"):
    """An array element by the published layout of MAT files of version 5."""
    flags = element(6, struct.pack(end + "II", held, 0), end)
    shape = element(5, struct.pack(f"{end}{x.ndim}i", *x.shape), end)
    return element(14, flags + shape + element(1, name.encode(), end) + element(number, x.astype(end + kind).tobytes(order="F"), end), end)


@pytest.mark.parametrize("end", ["<", ">"])
@pytest.mark.parametrize("compressed", [False, True])
def test_mat(session, tmp_path, end, compressed):
    rng = np.random.RandomState(1)
    x, y = rng.randint(0, 200, (2, 3, 40)), rng.randn(3, 30)
    parts = [element(14, element(6, struct.pack(end + "II", 4, 0), end) + element(5, struct.pack(end + "ii", 1, 1), end) + element(1, b"a name", end) + element(4, b"hi", end), end)]
    parts += [matrix("x", x, 2, "u1", end=end), matrix("longer_name", y, 9, "f8", end=end)]
    if compressed:
        parts = [struct.pack(end + "II", 15, len(z)) + z for z in map(zlib.compress, parts)]
    path = tmp_path / "m.mat"
    path.write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack(end + "H", 0x0100) + (b"IM" if end == "<" else b"MI") + b"".join(parts))
    df = session.read.format("mat").option("splitBytes", 50).load(str(path))
    assert np.array_equal(dense(df.collect(), x.shape), x)
    assert df.rdd.getNumPartitions() == (1 if compressed else 5)
    other = session.read.format("mat").option("variable", "longer_name").load(str(path))
    assert np.array_equal(dense(other.collect(), (1, 3, 30))[0], y)
    with pytest.raises(Exception, match="no array z; it holds"):
        session.read.format("mat").option("variable", "z").load(str(path)).collect()
    (tmp_path / "bad.mat").write_bytes(b"x" * 300)
    with pytest.raises(Exception, match="no MAT"):
        session.read.format("mat").load(str(tmp_path / "bad.mat")).collect()


def tag(kind, number, data, following=0):
    return struct.pack(">iiii", kind, number, len(data), following) + data


def fif(x, factors, kinds, number=4, kind=">f4", buffer=16, skip_after=None):
    """A raw recording by the published layout of FIF files."""
    out = tag(100, 31, b"\0" * 20) + tag(200, 3, struct.pack(">i", len(x))) + tag(201, 4, struct.pack(">f", 250.0))
    for i, (f, k) in enumerate(zip(factors, kinds)):
        out += tag(203, 30, struct.pack(">iiiff", i + 1, i + 1, k, f, 2.0) + b"\0" * 60 + f"CH {i}".encode().ljust(16, b"\0"))
    out += tag(208, 3, struct.pack(">i", 0))
    for i, t in enumerate(range(0, x.shape[1], buffer)):
        out += tag(300, number, x[:, t : t + buffer].T.astype(kind).tobytes())
        if skip_after == i:
            out += tag(301, 3, struct.pack(">i", 2))
    return out + tag(108, 0, b"", -1)


@pytest.mark.parametrize("number,kind", [(4, ">f4"), (2, ">i2"), (16, ">i2"), (5, ">f8")])
def test_fif(session, tmp_path, number, kind):
    x = np.random.RandomState(0).randint(-90, 90, (3, 70)).astype(float)
    x[2] = 0
    x[2, [10, 11, 40]], x[2, 41] = 5, 7
    path = tmp_path / "r_raw.fif"
    path.write_bytes(fif(x, [0.5, 2.0, 0.5], [1, 1, 3], number, kind))
    df = session.read.format("fif").option("splitBytes", 2 * 16 * 3 * np.dtype(kind).itemsize).load(str(path))
    assert np.allclose(dense(df.collect(), (1, 3, 70))[0], x * np.array([[1.0], [4.0], [1.0]]))
    assert df.rdd.getNumPartitions() == 3
    _, _, channels, sfreq = A.fif_header(str(path))
    assert channels == [("CH 0", 1), ("CH 1", 1), ("CH 2", 3)] and sfreq == 250.0
    events = sorted(tuple(r) for r in A.find_events(df, 2).collect())
    assert events == [(0, 10, 0, 5), (0, 40, 0, 5), (0, 41, 5, 7)]


def test_fif_skips_and_refusals(session, tmp_path):
    x = np.arange(40.0).reshape(1, 40)
    path = tmp_path / "s_raw.fif"
    path.write_bytes(fif(x, [0.5], [1], buffer=10, skip_after=1))
    got = {r.t: r.x for r in session.read.format("fif").load(str(path)).collect()}
    assert got == {t + (20 if t >= 20 else 0): float(t) for t in range(40)}
    (tmp_path / "bad.fif").write_bytes(b"\0" * 64)
    with pytest.raises(Exception, match="no FIF"):
        session.read.format("fif").load(str(tmp_path / "bad.fif")).collect()


def test_a_recording_becomes_trials(session, tmp_path):
    """FIF to epochs around its events, filtered in blocks: the chain of a recording's loader."""
    from wavemill.sources import loaders

    rng = np.random.RandomState(0)
    x = np.concatenate([rng.randn(2, 600), np.zeros((1, 600))])
    x[2, [100, 300, 590]] = 1
    path = tmp_path / "t_raw.fif"
    path.write_bytes(fif(x, [0.5, 0.5, 0.5], [1, 1, 3], 5, ">f8", buffer=50))
    df = session.read.format("fif").option("splitBytes", 4000).load(str(path)).drop("file")
    signal = loaders.filtered(df.where("channel < 2"), 250.0, low=2.0, block=200, times=600)
    cut = loaders.epochs(signal, A.find_events(df, 2).select("sample", "event_id"), -20, 29)
    assert {r.trial for r in cut.select("trial").distinct().collect()} == {100, 300} and cut.count() == 2 * 2 * 50
