"""Surrogate averages: the sums of brute force, and no table that goes through the driver."""

import numpy as np
from wavemill.operators import analytics as A


def test_surrogates_meet_the_axis_without_a_broadcast(spark):
    rng = np.random.RandomState(1)
    z = {(int(k), int(s)): int(v) for k, s, v in zip(rng.randint(2, size=300), rng.randint(400, size=300), rng.randint(1, 9, size=300), strict=True)}
    at = [(int(s), int(e), int(t)) for s, e, t in zip(rng.randint(3, size=200), range(200), rng.randint(3, 390, size=200), strict=True)]
    axis = spark.createDataFrame([(k, s, v) for (k, s), v in z.items()], "k int, sample long, z long")
    found = A.surrogate_evoked(axis, spark.createDataFrame(at, "surrogate int, epoch long, sample long"), -3, 8, 50)
    want: dict = {}
    for s, _, t in at:
        for o in range(-3, 9):
            for k in range(2):
                if (k, t + o) in z:
                    want[s, k, o] = want.get((s, k, o), 0) + z[k, t + o]
    assert {(r.surrogate, r.k, r.o): r["mean"] for r in found.collect()} == {at: v / 50.0 for at, v in want.items()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Sort" not in plan and dict(found.dtypes)["o"] == "int"
