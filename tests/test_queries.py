"""Every query with SQL gives DuckDB's rows; plans keep their shifts as equalities."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from wavemill.plans import model_queries as M
from wavemill.plans import queries as Q
from wavemill.plans import step_queries as T
from wavemill.sources import views as V


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in ("events", "embeddings", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(Q.QUERIES) + sorted(M.SQL) + sorted(T.SQL))
def test_matches_duckdb(spark, sf, duck, name):
    found, sql = Q.QUERIES | M.QUERIES | T.QUERIES, Q.SQL | M.SQL | T.SQL
    got, want = found[name](spark, sf).toPandas(), duck.execute(sql[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


@pytest.mark.parametrize("name", ["code_autocorrelation", "code_signal_correlation", "atom_gram", "epoch_codes"])
def test_shifts_are_equi_joins(spark, sf, name):
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_objective_forms_agree(spark, sf):
    a, b = (Q.QUERIES[n](spark, sf).first()[0] for n in ("objective", "fast_objective"))
    assert a == b


def test_scan_reads_only_needed_columns(spark, sf):
    plan = V.event_signal(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan


def test_events_are_read_once_and_dealt_before_they_are_summed(spark, sf):
    for df in (V.event_signal(spark, sf), V.event_codes(spark, sf, V.HOURS - V.LENGTH + 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [ts#") == 1
        first_sum = plan[plan.rindex("HashAggregate(keys=[user_id#") : plan.index("FileScan parquet [ts#")]
        assert "Exchange hashpartitioning(user_id#" in first_sum  # or a task's sums are as large as its split of the file


def test_reconstruction_of_odd_events_in_one_row_group_is_that_of_sql(spark, tmp_path):
    day, c = pd.Timestamp("2024-01-05"), duckdb.connect()
    rows = [(u, day + pd.Timedelta(hours=h), e, v) for u in (1, 2, None) for h in (0, 1, 2, 3) for e, v in (("buy", 1.5), ("view", -2.25), ("buy", 0.75), (None, 9.0))]
    rows += [(1, day + pd.Timedelta(hours=9), "buy", None), (1, day + pd.Timedelta(hours=9), "view", 3.0), (2, day, "cart", None), (2, day + pd.Timedelta(hours=30), "buy", 0.0)]
    rows += [(3, None, "buy", 4.0), (3, pd.Timestamp("2023-12-31 21:30"), "buy", 4.0), (3, pd.Timestamp("2024-01-30 18:59:59.9"), "buy", 4.0), (3, pd.Timestamp("2024-01-30 19:00"), "buy", 4.0)]
    events = pd.DataFrame(rows, columns=["user_id", "ts", "event_type", "value"]).astype({"user_id": "Int64", "ts": "datetime64[us]"})
    events.assign(event_id=range(len(events)), props="").to_parquet(tmp_path / "events.parquet")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = Q.QUERIES["reconstruct"](spark, str(tmp_path)).toPandas(), c.execute(Q.SQL["reconstruct"]).df()
    assert len(want)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))


def test_reconstruction_is_convolution(spark):
    from wavemill.kernels import csc
    from wavemill.operators import convolution as C
    from wavemill.plans.model import atoms_table

    rng = np.random.RandomState(0)
    d, z = rng.randn(3, 2, 5), rng.randn(3, 20) * (rng.uniform(size=(3, 20)) < 0.3)
    k, t = np.nonzero(z)
    rows = spark.createDataFrame([(0, int(a), int(b), float(z[a, b])) for a, b in zip(k, t, strict=True)], "trial long, k int, t int, z double")
    got = np.zeros((2, 24))
    for r in C.reconstruct(rows, atoms_table(spark, d)).collect():
        got[r.channel, r.t] = r.x
    assert np.allclose(got, csc.reconstruct(z, d))


@pytest.mark.parametrize("where", ["false", "ts >= '2024-01-30 20:00:00'", "hour(ts) % 3 <> 0 AND value < 0"])
def test_objectives_and_variances_of_few_rows_as_sql(spark, tmp_path, where):
    """No events; events, but no codes; codes of one atom alone or none."""
    events = f"{tmp_path}/events.parquet"
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    db.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet' WHERE {where}) TO '{events}'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{events}'")
    for name in ("objective", "objective_per_atom", "objective_feasible", "fast_objective", "explained_variance"):
        got = sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.execute(Q.SQL[name]).fetchall()), name
