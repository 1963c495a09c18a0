"""Registered queries of encoders and learners that take a stated number of steps, so that SQL can replay them.

The series are the vectors' samples in units of 128 thousandths and the atoms are small integers (over a power of two where they have to
lie in the unit ball): sums are exact, and every choice between coordinates falls alike in both engines.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import preprocess as P
from ..sources import views as V
from . import encode as E
from . import learn as L
from .model import atoms_table
from .model_queries import SERIES

QUERIES: dict = {}
SQL: dict[str, str] = {}

VALID = V.EMBEDDING - V.LENGTH + 1
ATOMS = np.array(V.ATOM_TIMES, dtype=float)[:, None, :]
K, SPAN = len(ATOMS), 2 * V.LENGTH - 1

_X = f"{SERIES}, x AS (SELECT trial, t, x / 128 AS x FROM e)"
_ZERO = f"SELECT trial, k, CAST(t AS INTEGER) AS t, 0.0::DOUBLE AS z FROM (SELECT DISTINCT trial FROM x), range({K}) w(k), range({VALID}) r(t)"
_CODES = "SELECT trial, CAST(k AS INTEGER) AS k, CAST(t AS INTEGER) AS t, z"


def _atoms_sql(atoms: np.ndarray) -> str:
    rows = ", ".join(f"({k}, {l}, {v!r}::DOUBLE)" for k, a in enumerate(atoms[:, 0].tolist()) for l, v in enumerate(a))
    return f"(SELECT * FROM (VALUES {rows}) v(k, l, d))"


def _series(s: SparkSession, d: str) -> DataFrame:
    return P.as_univariate(V.embedding_signal(s, d).withColumn("x", F.col("x") / 128.0))


def replayed(sql: str):
    """Registers a query with its SQL."""

    def keep(f):
        SQL[f.__name__] = sql
        QUERIES[f.__name__] = f
        return f

    return keep


def _gradient(name: str, z: str, atoms: str, x: str = "x") -> str:
    """CTEs: ``name`` (trial, k, t, c) holds the correlations of what the codes ``z`` leave of the series."""
    return f""", r{name} AS (SELECT trial, t, sum(x) AS r FROM (SELECT trial, t, x FROM {x} UNION ALL
        SELECT trial, t + l, -z * d FROM {z} JOIN {atoms} USING (k)) GROUP BY ALL),
    {name} AS (SELECT trial, k, t - l AS t, sum(r * d) AS c FROM r{name}, {atoms} WHERE t - l BETWEEN 0 AND {VALID - 1} GROUP BY trial, k, t - l)"""


# Proximal steps -------------------------------------------------------------------------------------------------------------------

#: Fixed values of the steps: step length, regularisation and how many.
STEP, REG, STEPS = 2.0**-7, 0.5, 3


def _weights(steps: int) -> list[float]:
    """How far each step is carried on."""
    a, out = 1.0, []
    for _ in range(steps):
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        out.append(float((a - 1) / b))
        a = b
    return out


def _fista_sql() -> str:
    out = f"WITH {_X}, d AS {_atoms_sql(ATOMS)}, z0 AS ({_ZERO}), y0 AS (SELECT * FROM z0)"
    for i, far in enumerate(_weights(2 * STEPS)):
        out += _gradient(f"c{i}", f"y{i}", "d")
        out += f""", z{i + 1} AS MATERIALIZED (SELECT trial, k, t, sign(v) * greatest(abs(v) - {STEP * REG}, 0) AS z
            FROM (SELECT trial, k, t, z + {STEP} * c AS v FROM y{i} JOIN c{i} USING (trial, k, t))),
        y{i + 1} AS MATERIALIZED (SELECT trial, k, t, n.z + {far!r} * (n.z - o.z) AS z FROM z{i + 1} n JOIN z{i} o USING (trial, k, t))"""
    return out + f" SELECT trial, k, t, round(z, 6) AS z FROM ({_CODES} FROM z{2 * STEPS}) WHERE round(z, 6) <> 0"


@replayed(_fista_sql())
def fista_fixed_steps(s, d):
    """Six accelerated proximal steps from zero, codes of either sign."""
    encoder = E.Encoder(ATOMS, REG, "fista", {"fixed_steps": 2 * STEPS, "step": STEP}, positive=False)
    found = E.codes(encoder.encode(E.blocks(_series(s, d), 1, V.EMBEDDING)), K)
    return found.withColumn("z", F.round("z", 6)).where("z <> 0")


def _refit_sql() -> str:
    out = f"WITH {_X}, d AS {_atoms_sql(ATOMS)}, z0 AS ({_ZERO})"
    for i in range(2 * STEPS):
        free, reg = ("true", REG) if i < STEPS else (f"(trial, k, t) IN (SELECT (trial, k, t) FROM z{STEPS} WHERE z > 0)", 0.0)
        out += _gradient(f"c{i}", f"z{i}", "d")
        out += f""", z{i + 1} AS MATERIALIZED (SELECT trial, k, t, CASE WHEN {free} THEN greatest(z + {STEP} * (c - {reg}), 0) ELSE 0 END AS z
            FROM z{i} JOIN c{i} USING (trial, k, t))"""
    return f"{out} {_CODES} FROM z{2 * STEPS} WHERE z > 0"


@replayed(_refit_sql())
def refit_fixed_steps(s, d):
    """Three proximal steps, then three without regularisation on the support that they found."""
    encoder = E.Encoder(ATOMS, REG, "ista", {"fixed_steps": STEPS, "step": STEP})
    table = encoder.encode(E.blocks(_series(s, d), 1, V.EMBEDDING))
    return E.codes(encoder.encode(table, unbiased=True), K)


# Coordinate steps -----------------------------------------------------------------------------------------------------------------

#: Rounds over the segments, and steps of the other orders in whole sweeps.
ROUNDS = 5


def _coordinates_sql(pick: str, steps: int, positive: bool) -> str:
    """A recursion over coordinate steps; ``pick`` ranks the coordinates of a trial at step i."""
    shrunk = f"greatest(-beta - {REG}, 0)" if positive else f"sign(-beta) * greatest(abs(beta) - {REG}, 0)"
    move = f"{shrunk} / n - z"
    return f"""WITH RECURSIVE {_X}, d AS {_atoms_sql(ATOMS)},
        g AS (SELECT a.k, b.k AS j, CAST(b.l - a.l AS INTEGER) AS lag, sum(a.d * b.d) AS v FROM d a, d b GROUP BY ALL),
        zero AS ({_ZERO}) {_gradient("c", "zero", "d")},
        s AS (SELECT 0 AS i, trial, k, t, beta, n, z, {move} AS m
              FROM (SELECT trial, c.k, CAST(t AS INTEGER) AS t, -c AS beta, v AS n, 0.0::DOUBLE AS z FROM c JOIN g ON g.k = c.k AND g.j = c.k AND lag = 0)
            UNION ALL
            SELECT i + 1, trial, k, t, beta, n, z, CASE WHEN own THEN 0 WHEN near THEN {move} ELSE m END
            FROM (SELECT s.i, s.trial, s.k, s.t, s.n, s.m, v IS NOT NULL AS near, coalesce(s.k = b.k AND s.t = b.t, false) AS own,
                         s.z + CASE WHEN s.k = b.k AND s.t = b.t THEN b.m ELSE 0 END AS z,
                         s.beta + CASE WHEN (s.k = b.k AND s.t = b.t) OR v IS NULL THEN 0 ELSE v * b.m END AS beta
                  FROM s LEFT JOIN (SELECT trial, k, t, m FROM s WHERE {pick}) b USING (trial)
                       LEFT JOIN g ON g.k = s.k AND g.j = b.k AND g.lag = s.t - b.t)
            WHERE i < {steps})
        SELECT trial, k, t, round(z, 6) AS z FROM ({_CODES} FROM s WHERE i = {steps}) WHERE round(z, 6) <> 0"""


_SEGMENTS = -(-VALID // SPAN)


@replayed(_coordinates_sql(f"t // {SPAN} = i % {_SEGMENTS} AND abs(m) > 0 QUALIFY row_number() OVER (PARTITION BY trial ORDER BY abs(m) DESC, k, t) = 1", ROUNDS * _SEGMENTS, True))
def lgcd_fixed_steps(s, d):
    """Five rounds of locally greedy coordinate descent: the best move of each segment in turn."""
    encoder = E.Encoder(ATOMS, REG, "lgcd", {"tol": 0.0, "max_iter": ROUNDS})
    found = E.codes(encoder.encode(E.blocks(_series(s, d), 1, V.EMBEDDING)), K)
    return found.withColumn("z", F.round("z", 6)).where("z <> 0")


@replayed(_coordinates_sql("abs(m) > 0 QUALIFY row_number() OVER (PARTITION BY trial ORDER BY abs(m) DESC, k, t) = 1", 4 * ROUNDS, False))
def greedy_fixed_steps(s, d):
    """Twenty greedy steps over the whole series, codes of either sign."""
    encoder = E.Encoder(ATOMS, REG, "lgcd", {"tol": 0.0, "max_iter": 4 * ROUNDS, "n_seg": 1}, positive=False)
    found = E.codes(encoder.encode(E.blocks(_series(s, d), 1, V.EMBEDDING)), K)
    return found.withColumn("z", F.round("z", 6)).where("z <> 0")


# Learners -------------------------------------------------------------------------------------------------------------------------

#: The atoms to begin with lie in the unit ball; steps of the codes are short enough for any such atoms.
START = ATOMS / 8
LEARN = {"solver_z": "ista", "solver_z_kwargs": {"fixed_steps": STEPS, "step": 2.0**-4}, "solver_d_kwargs": {"max_iter": 1}, "rank1": False, "rescale": False, "reg": 2.0**-5}


def _learner_sql(iterations: int, batches: int | None, alpha: float) -> str:
    """Proximal steps, sums and one projected step of the atoms, the longest of 1, 1/2, 1/4 and so on under which the quadratic bound holds."""
    step, reg = LEARN["solver_z_kwargs"]["step"], LEARN["reg"]
    out = f"WITH {_X}, d0 AS MATERIALIZED {_atoms_sql(START)}, ranks AS (SELECT trial, row_number() OVER (ORDER BY trial) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT trial FROM x))"
    last = f"({_ZERO})"
    for i in range(iterations):
        x = "x"
        if batches:
            part = f"SELECT trial FROM ranks WHERE rank // ((n + {batches - 1}) // {batches}) = {i % batches}"
            x, last = f"x{i}", f"({_ZERO.replace('FROM x', f'FROM x{i}')})"
            out += f", x{i} AS MATERIALIZED (SELECT * FROM x WHERE trial IN ({part}))"
        out += f", z{i}_0 AS MATERIALIZED {last}"
        for j in range(STEPS):
            out += _gradient(f"c{i}_{j}", f"z{i}_{j}", f"d{i}", x)
            out += f", z{i}_{j + 1} AS MATERIALIZED (SELECT trial, k, t, greatest(z + {step} * (c - {reg}), 0) AS z FROM z{i}_{j} JOIN c{i}_{j} USING (trial, k, t))"
        last = f"(SELECT * FROM z{i}_{STEPS})"
        older = [f" UNION ALL SELECT k, {c}, {alpha} * v FROM {t}{i - 1}" if batches and i else "" for t, c in (("ztz", "j, lag"), ("ztx", "l"))]
        out += f""", on{i} AS MATERIALIZED (SELECT * FROM z{i}_{STEPS} WHERE z > 0),
        ztz{i} AS MATERIALIZED (SELECT k, j, lag, sum(v) AS v FROM (SELECT a.k, b.k AS j, a.lag, a.z * b.z AS v
            FROM (SELECT trial, k, t, z, unnest(range({1 - V.LENGTH}, {V.LENGTH})) AS lag FROM on{i}) a JOIN on{i} b ON a.trial = b.trial AND b.t = a.t + a.lag{older[0]}) GROUP BY ALL),
        ztx{i} AS MATERIALIZED (SELECT k, l, sum(v) AS v FROM (SELECT k, l, z * x AS v
            FROM (SELECT trial, k, t, z, unnest(range({V.LENGTH})) AS l FROM on{i}) a JOIN {x} b ON a.trial = b.trial AND b.t = a.t + l{older[1]}) GROUP BY ALL),
        g{i} AS MATERIALIZED (SELECT k, l, sum(v) AS g FROM (SELECT q.k, q.lag + b.l AS l, q.v * b.d AS v
            FROM ztz{i} q JOIN d{i} b ON b.k = q.j WHERE q.lag + b.l BETWEEN 0 AND {V.LENGTH - 1}
            UNION ALL SELECT k, l, -v FROM ztx{i}) GROUP BY ALL),
        p{i} AS MATERIALIZED (SELECT n, k, l, e / greatest(1, sqrt(sum(e * e) OVER (PARTITION BY n, k))) AS d, was
            FROM (SELECT n, k, l, d - pow(2, -n) * g AS e, d AS was FROM d{i} JOIN g{i} USING (k, l), range(60) r(n))),
        bend{i} AS (SELECT a.n, sum(q.v * (a.d - a.was) * (b.d - b.was)) AS bend FROM p{i} a JOIN p{i} b USING (n) JOIN ztz{i} q ON q.k = a.k AND q.j = b.k AND q.lag = a.l - b.l GROUP BY a.n),
        size{i} AS (SELECT n, sum((d - was) * (d - was)) * pow(2, n) AS size FROM p{i} GROUP BY n),
        d{i + 1} AS MATERIALIZED (SELECT k, l, d FROM p{i} WHERE n = (SELECT min(n) FROM bend{i} JOIN size{i} USING (n) WHERE bend <= size))"""
    return f"{out} SELECT CAST(k AS INTEGER) AS k, CAST(0 AS INTEGER) AS channel, CAST(l AS INTEGER) AS l, round(d, 6) AS d FROM d{iterations}"


def _learned(s: SparkSession, d: str, iterations: int, **kw) -> DataFrame:
    got = L.learn(_series(s, d), K, V.LENGTH, 1, V.EMBEDDING, n_iter=iterations, D_init=START, random_state=0, **LEARN, **kw)
    return atoms_table(s, got.d).withColumn("d", F.round("d", 6))


@replayed(_learner_sql(2, None, 0.0))
def batch_two_iterations(s, d):
    """Atoms after two iterations of batch learning on all series."""
    return _learned(s, d, 2)


@replayed(_learner_sql(3, 3, 0.5))
def online_three_batches(s, d):
    """Atoms after online learning from three batches that hold every series once; older sums count half."""
    trials = V.table(s, d, "embeddings").count()
    return _learned(s, d, 3, algorithm="online", algorithm_params={"batch_size": -(-trials // 3), "batch_selection": "cyclic", "alpha": 0.5})
