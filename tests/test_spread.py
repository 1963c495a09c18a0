"""Sums over shifts by sorted blocks: the rows of the joins, at borders of blocks and without times, and no wide row that is hashed."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemill.operators import convolution as C
from wavemill.operators import objective as O
from wavemill.operators import spread as S
from wavemill.sources import views as V

L, T = 4, 3000


@pytest.fixture(scope="module")
def made(spark):
    """A long trial, many short ones, one without a number, samples without a time or value, a channel that no atom has."""
    rng = np.random.RandomState(3)
    x = [(0, int(c), int(t), int(v)) for c, t, v in zip(rng.randint(4, size=900), rng.randint(-5, T + 9, size=900), rng.randint(-50, 50, size=900), strict=True)]
    x += [(int(n), int(c), int(t), int(v)) for n, c, t, v in zip(rng.randint(1, 40, size=500), rng.randint(4, size=500), rng.randint(1000, 1050, size=500), rng.randint(-50, 50, size=500), strict=True)]
    x += [(None, 1, 5, 7), (None, 1, 6, 2), (2, 1, None, 9), (2, 3, None, 4), (3, None, 5, 9), (3, 0, 5, None)]
    x = list({(a, b, c): d for a, b, c, d in x}.items())
    z = {(int(n), int(k), int(t)): int(v) for n, k, t, v in zip(rng.randint(0, 40, size=600), rng.randint(2, size=600), rng.randint(1000, 1050, size=600), rng.randint(1, 5, size=600), strict=True)}
    z |= {(0, int(k), int(t)): 2 for k, t in zip(rng.randint(2, size=300), rng.randint(0, T - L + 1, size=300), strict=True)} | {(None, 1, 4): 3}
    atoms = [(k, p, l, int(rng.randint(-3, 4))) for k in range(2) for p in range(3) for l in range(L) if (k, p, l) != (0, 1, 2)]
    x = spark.createDataFrame([(*at, v) for at, v in x], "trial long, channel int, t int, x long")
    z = spark.createDataFrame([(*at, v) for at, v in z.items()], "trial long, k int, t int, z long")
    return x, z, spark.createDataFrame(atoms, "k int, channel int, l int, d long")


FORMS = {
    "reconstruct": lambda x, z, d: C.reconstruct(z, d),
    "reconstruct_atoms": lambda x, z, d: C.reconstruct_atoms(z, d),
    "residual": lambda x, z, d: C.residual(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d),
    "residual_energy": lambda x, z, d: C.residual_energy(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d),
    "patch_error": lambda x, z, d: C.residual_patch_error(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d, L, T),
    "residual_correlation": lambda x, z, d: C.residual_correlation(z.where("trial IS NOT NULL"), x.where("x IS NOT NULL AND channel IS NOT NULL"), d, L),
    "atom_correlation": lambda x, z, d: C.atom_correlation(x.where("x IS NOT NULL AND channel IS NOT NULL"), d, T - L + 1),
    "gradient_z": lambda x, z, d: O.gradient_z(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d, 3.0, T - L + 1),
    "ista_step": lambda x, z, d: O.ista_step(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d, 3.0, 2.0**-10, T - L + 1),
    "explained_variance": lambda x, z, d: O.explained_variance(z, d, 3, T, x),
    "score": lambda x, z, d: O.reconstruction_score(x.where("x IS NOT NULL AND channel IS NOT NULL"), z, d),
}


@pytest.mark.parametrize("name", sorted(FORMS))
def test_same_rows_as_the_joins(spark, made, monkeypatch, name):
    got = FORMS[name](*made)
    plan = got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "MOST_WIDE", 0)
    want = FORMS[name](*made)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "MapInArrow" in plan


@pytest.mark.parametrize("name", ["reconstruct", "reconstruct_atoms", "residual", "residual_energy", "patch_error", "gradient_z", "ista_step"])
def test_only_narrow_rows_are_shuffled_and_sorted(made, name):
    plan = FORMS[name](*made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "HashAggregate" not in plan and "Join" not in plan


def test_a_small_chunk_gives_the_same_rows(spark, made, monkeypatch):
    want = sorted(map(repr, FORMS["residual"](*made).collect()))
    seen = made[0].where("x IS NOT NULL AND channel IS NOT NULL"), made[1]
    taps, kind = C.blockwise(made[2], (made[0], "x"), (made[1], "z"))
    work = lambda c: S._long(c.own(c.table(-1)), c.taps.channels, "r")
    got = S.by_blocks(S._parts(*seen, None, taps), taps, kind, work, f"trial TRIAL, channel int, t int, r {kind}", 10**9)
    assert sorted(map(repr, got.collect())) == want


def test_integers_that_overflow_are_an_error(spark, made):
    z = spark.createDataFrame([(0, 0, 3, 2**62)], "trial long, k int, t int, z long")
    with pytest.raises(Exception, match="64 bits"):
        C.reconstruct(z, made[2].withColumn("d", F.lit(3).cast("long"))).collect()


def test_squares_of_gradients_may_need_more_than_64_bits(spark):
    g = spark.createDataFrame([(3_000_000_000,), (-4_000_000_000,)], "g long")
    assert O.gradient_norm(g, g).first().norm == 10_000_000_000.0


@pytest.mark.parametrize("signal", [V.event_signal, V.shipping_signal])
def test_large_tables_are_not_shuffled_by_a_column_of_few_values(spark, sf, signal):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as it is where the table is too large to be broadcast
    try:
        plan = signal(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", sorted(FORMS))
def test_rows_without_a_value_or_a_trial_are_those_of_the_joins(spark, made, monkeypatch, name):
    x, z, d = made
    some = spark.createDataFrame([(0, 1, 2000, None), (0, 2, 2001, None), (0, 2, None, None), (5, 1, 9, None), (5, 2, 12, None), (77, 0, 3, None), (None, 2, 5, None)], x.schema)
    x = x.where("channel IS NOT NULL").unionByName(some)
    forms = FORMS | {"residual": lambda x, z, d: C.residual(x, z, d), "residual_energy": lambda x, z, d: C.residual_energy(x, z, d)}
    forms |= {"patch_error": lambda x, z, d: C.residual_patch_error(x, z, d, L, T), "atom_correlation": lambda x, z, d: C.atom_correlation(x, d, T - L + 1)}
    forms |= {"residual_correlation": lambda x, z, d: C.residual_correlation(z, x, d, L), "gradient_z": lambda x, z, d: O.gradient_z(x, z, d, 3.0, T - L + 1)}
    forms |= {"ista_step": lambda x, z, d: O.ista_step(x, z, d, 3.0, 2.0**-10, T - L + 1), "score": lambda x, z, d: O.reconstruction_score(x, z, d)}
    z = z.unionByName(spark.createDataFrame([(5, 0, 300, None), (0, 1, 2500, None)], z.schema))
    got = sorted(map(repr, forms[name](x, z, d).collect()))
    monkeypatch.setattr(C, "MOST_WIDE", 0)
    assert got == sorted(map(repr, forms[name](x, z, d).collect()))
