"""Product codes against plain integer Lloyd rounds."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, rounds=6, scale=4096):
    """Rows of the result, by Python integers."""
    kept = [(i, [int(np.floor(scale * v)) for v in x], y) for i, x, y in rows if x and all(v is not None and np.isfinite(v) for v in x)]
    if not kept:
        return []
    key = lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes())
    size = len(min(kept, key=key)[1])
    kept = [r for r in kept if len(r[1]) == size]
    w = size // 8
    part = lambda x, p: x[p * w : p * w + w]
    books = [[part(r[1], p) for r in sorted(kept, key=key)[:16]] for p in range(8)]

    def nearest(x, entries):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries))

    for _ in range(rounds):
        for p in range(8):
            mine = [[] for _ in books[p]]
            for r in kept:
                mine[nearest(part(r[1], p), books[p])[1]].append(part(r[1], p))
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else e for m, e in zip(mine, books[p])]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by = [], Counter()
    for i, x, y in kept:
        found = [nearest(part(x, p), books[p]) for p in range(8)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), y))
        by[y] += out[-1][2]
    return [(i, c, e, by[y], digest) for i, c, e, y in out]


def table(n=300, seed=0, width=16, spread=0.2):
    rng = np.random.RandomState(seed)
    centres = rng.normal(0, 1, (7, width))
    return [(i, (centres[rng.randint(7)] + rng.normal(0, spread, width)).tolist(), None if rng.uniform() < 0.2 else int(rng.randint(3))) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_plain_lloyd(spark, seed):
    from wavemill.llm.vector_codes import vector_codes

    rows = table(seed=seed)
    got = vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows))


def test_ties_and_equal_vectors(spark):
    """Few different integers: equal seeds, equal distances and entries that no part uses."""
    from wavemill.llm.vector_codes import coded, vector_codes

    rng = np.random.RandomState(2)
    rows = [(i, (rng.randint(-2, 3, 8) / 4096).tolist(), 1) for i in range(200)] + [(200 + i, [0.0] * 8, None) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert Counter(map(tuple, vector_codes(df).collect())) == Counter(plain(rows))
    assert coded(df).scans[0] == 8 * 300


def test_bounds_save_measurements(spark):
    """Later rounds measure all entries for a part of the parts only."""
    from wavemill.llm.vector_codes import coded

    scans = coded(spark.createDataFrame(table(600, spread=0.05), SCHEMA)).scans
    assert len(scans) == 7 and scans[0] == 600 * 8 and scans[-1] < scans[0] / 4


def test_awkward_rows(spark):
    """Nulls, non-finite and empty vectors, other lengths, repeated and null ids, extra columns; few rows, and none."""
    from wavemill.llm.vector_codes import vector_codes

    rows = table(40)
    bad = [(-5, None, 1), (-4, [], 1), (-3, [float("nan")] * 16, 1), (-2, [1.0] * 15 + [float("inf")], 2), (-1, [1.0] * 15 + [None], 2)]
    rows += [*bad, rows[3], rows[3], (None, rows[5][1], None), (7, [0.5] * 24, 1), (3, rows[9][1], 1)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", id int, `x.y` int, code int").repartition(3)
    assert Counter(map(tuple, vector_codes(df).collect())) == Counter(plain(rows))
    few = rows[:5]
    assert Counter(map(tuple, vector_codes(spark.createDataFrame(few, SCHEMA)).collect())) == Counter(plain(few))
    one = rows[:1]
    assert Counter(map(tuple, vector_codes(spark.createDataFrame(one, SCHEMA)).collect())) == Counter(plain(one))
    for none in ([], bad):
        empty = vector_codes(spark.createDataFrame(none, SCHEMA))
        assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="12 components"):
        vector_codes(spark.createDataFrame([(1, [1.0] * 12, 1)], SCHEMA))


def test_very_large_components(spark):
    from wavemill.llm.vector_codes import largest, vector_codes

    most = largest(8)
    assert 8 * (2 * most) ** 2 < 2**63
    rows = [(i, [v] * 8, 0) for i, v in enumerate([1e300, -1e300, 0.0, 1.0])]
    got = {r.vec_id: r for r in vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].error for i in range(4)] == [0, 0, 0, 0] and got[0].code == "00" * 8


def test_assignment_with_any_bounds():
    """Bounds that were carried over many random moves never keep an entry that is not the first nearest."""
    from wavemill.llm.vector_codes import Codebooks, assigned, distances

    rng = np.random.RandomState(0)
    x = rng.randint(-20, 20, (500, 8, 2)).astype("<i4")
    books = Codebooks(rng.randint(-20, 20, (8, 5, 2)))
    code, upper, lower = np.zeros((500, 8), np.uint8), np.full((500, 8), np.inf, "f4"), np.full((500, 8), -np.inf, "f4")
    skipped = 0
    for _ in range(30):
        skipped += 4000 - assigned(x, books, code, upper, lower)
        for p in range(8):
            d = distances(x[:, p], books.entries[p])
            assert (code[:, p] == d.argmin(axis=1)).all()
            assert (upper[:, p].astype(float) ** 2 >= d.min(axis=1)).all() and (lower[:, p] <= np.sqrt(np.sort(d, axis=1)[:, 1])).all()
        books = books.following(books.entries + rng.randint(-1, 2, (8, 5, 2)))
    assert skipped > 10_000


def test_query_against_sql(spark, sf):
    import __spark_entry__ as registry

    name = "op13_hamerly_codes"
    got = registry.queries()[name](spark, sf)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = duck.execute(registry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
