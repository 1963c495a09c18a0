"""Registered queries of the relational operators, each with DuckDB SQL that must give the same rows.

Inputs are integers wherever an operator allows it, so both engines compute exactly; only roots and ratios are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as K
from ..operators import analytics as A
from ..operators import atoms as AT
from ..operators import convolution as C
from ..operators import objective as O
from ..operators import preprocess as P
from ..sources import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

L, P5, T, TV = V.LENGTH, V.EVENT_TYPES, V.HOURS, V.HOURS - V.LENGTH + 1
E, EV = V.EMBEDDING, V.EMBEDDING - V.LENGTH + 1
REG = 3

_ATOMS = ", ".join(f"({k}, {l}, {x})" for k, a in enumerate(V.ATOM_TIMES) for l, x in enumerate(a))
_EVENTS = f"""
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS channel FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT user_id AS trial, channel, CAST(floor((epoch(ts) - {V.EPOCH_2024}) / 3600) AS INTEGER) AS t,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS x FROM events JOIN types USING (event_type) GROUP BY ALL),
hour AS (SELECT trial, t, sum(x) AS s, count(*) AS n FROM x WHERE t < {TV} GROUP BY ALL),
z AS (SELECT trial, 0 AS k, t, CAST(1 AS BIGINT) AS z FROM hour WHERE s > 0 UNION ALL SELECT trial, 1, t, n FROM hour WHERE t % 3 = 0),
a AS (SELECT * FROM (VALUES {_ATOMS}) v(k, l, v)),
u AS (SELECT k, CAST(c AS INTEGER) AS channel, CAST(c + 1 AS BIGINT) AS u FROM (VALUES (0), (1)) w(k), range({P5}) r(c)),
d AS (SELECT k, channel, l, CAST(u * v AS BIGINT) AS d FROM a JOIN u USING (k)),
trials AS (SELECT DISTINCT trial FROM x),
hat AS (SELECT trial, channel, t + l AS t, CAST(sum(z * d) AS BIGINT) AS x FROM z JOIN d USING (k) GROUP BY ALL),
r AS (SELECT trial, channel, t, CAST(sum(x) AS BIGINT) AS r FROM (SELECT trial, channel, t, x FROM x UNION ALL SELECT trial, channel, t, -x FROM hat) GROUP BY ALL),
ztz AS (SELECT p.k, q.k AS k2, CAST(q.t - p.t AS INTEGER) AS dt, CAST(sum(p.z * q.z) AS BIGINT) AS v FROM z p JOIN z q ON p.trial = q.trial AND abs(q.t - p.t) < {L} GROUP BY ALL),
ztx AS (SELECT k, channel, CAST(x.t - z.t AS INTEGER) AS l, CAST(sum(z * x) AS BIGINT) AS v FROM z JOIN x ON z.trial = x.trial AND x.t - z.t BETWEEN 0 AND {L - 1} GROUP BY ALL),
zd AS (SELECT ztz.k, d.channel, CAST(l + dt AS INTEGER) AS l, CAST(sum(v * d) AS BIGINT) AS v FROM ztz JOIN d ON ztz.k2 = d.k WHERE l + dt BETWEEN 0 AND {L - 1} GROUP BY ALL),
gz AS (SELECT trial, k, CAST(t - l AS INTEGER) AS t, CAST({REG} - sum(r * d) AS BIGINT) AS g FROM r JOIN d USING (channel) WHERE t - l BETWEEN 0 AND {TV - 1} GROUP BY ALL),
gd AS (SELECT k, channel, l, CAST(sum(v) AS BIGINT) AS g FROM (SELECT * FROM zd UNION ALL SELECT k, channel, l, -v FROM ztx) GROUP BY ALL)"""
#: The same names for atoms that are drawn from the events.
_DRAWN = f"""
types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS channel FROM (SELECT DISTINCT event_type FROM events)),
x AS (SELECT user_id AS trial, channel, CAST(floor((epoch(ts) - {V.EPOCH_2024}) / 3600) AS INTEGER) AS t,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS x FROM events JOIN types USING (event_type) GROUP BY ALL),
p AS (SELECT CAST(trial % 2 AS INTEGER) AS k, channel, CAST(t % {L} AS INTEGER) AS l, t, x FROM x WHERE t >= 0),
u AS (SELECT k, channel, CAST(sum(CASE WHEN x % 3 = 0 THEN 2 ELSE -1 END) AS BIGINT) AS u FROM p GROUP BY k, channel),
a AS (SELECT k, l, CAST(sum(CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM p GROUP BY k, l),
d AS (SELECT k, channel, l, CAST(sum(CASE WHEN x % 2 = 0 THEN 1 + t % 3 ELSE -1 END) AS BIGINT) AS d FROM p GROUP BY k, channel, l),
uv AS (SELECT k, channel, l, CAST(u * v AS BIGINT) AS d FROM u JOIN a USING (k))"""
_EMBEDDINGS = f"""
e AS (SELECT vec_id AS trial, CAST(i - 1 AS INTEGER) AS t, CAST(round(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT) AS x FROM embeddings, range(1, {E + 1}) r(i)),
z AS (SELECT trial, CASE WHEN x > 0 THEN 0 ELSE 1 END AS k, t, CAST(1 AS BIGINT) AS z FROM e WHERE t < {EV} AND abs(x) > 150),
d AS (SELECT k, l, CAST(v AS BIGINT) AS d FROM (VALUES {_ATOMS}) v(k, l, v)),
hat AS (SELECT trial, t + l AS t, CAST(sum(z * d) AS BIGINT) AS x FROM z JOIN d USING (k) GROUP BY ALL),
r AS (SELECT trial, t, CAST(sum(x) AS BIGINT) AS r FROM (SELECT * FROM e UNION ALL SELECT trial, t, -x FROM hat) GROUP BY ALL)"""
_SHIPPING = f"""
flags AS (SELECT l_returnflag, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS channel FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
s AS (SELECT CAST(0 AS BIGINT) AS trial, channel, CAST(date_diff('day', DATE '{V.FIRST_SHIPDAY}', CAST(l_shipdate AS DATE)) AS INTEGER) AS t,
             CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS x FROM lineitem JOIN flags USING (l_returnflag) GROUP BY ALL)"""


def query(base: str, sql: str):
    """Registers a query under its function's name with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {base.strip()}\n{sql}"
        return f

    return keep


def _xzd(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return V.event_signal(s, d), V.event_codes(s, d, TV), V.integer_atoms(s, P5)


def _univariate(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    atoms = s.createDataFrame([(k, l, x) for k, a in enumerate(V.ATOM_TIMES) for l, x in enumerate(a)], "k int, l int, d long")
    return V.embedding_signal(s, d), V.embedding_codes(s, d, EV), atoms


# Convolution and statistics


@query(_EVENTS, "SELECT trial, channel, t, x FROM hat")
def reconstruct(s, d):
    _, z, atoms = _xzd(s, d)
    return C.reconstruct(z, atoms)


@query(_EMBEDDINGS, "SELECT trial, t, x FROM hat")
def reconstruct_univariate(s, d):
    _, z, atoms = _univariate(s, d)
    return C.reconstruct_univariate(z, atoms)


@query(_EVENTS, "SELECT k, trial, channel, t + l AS t, CAST(sum(z * d) AS BIGINT) AS x FROM z JOIN d USING (k) GROUP BY ALL")
def reconstruct_by_atom(s, d):
    _, z, atoms = _xzd(s, d)
    return C.reconstruct_atoms(z, atoms)


@query(_EVENTS, "SELECT trial, channel, t, r FROM r")
def residual(s, d):
    return C.residual(*_xzd(s, d))


@query(_EVENTS, "SELECT k, k2, dt, v FROM ztz")
def code_autocorrelation(s, d):
    return C.code_correlation(V.event_codes(s, d, TV), L)


@query(_EVENTS, "SELECT k, channel, l, v FROM ztx")
def code_signal_correlation(s, d):
    x, z, _ = _xzd(s, d)
    return C.signal_correlation(z, x, L)


@query(_DRAWN, f"SELECT p.k, q.k AS k2, CAST(q.l - p.l AS INTEGER) AS dt, CAST(sum(p.d * q.d) AS BIGINT) AS v FROM d p JOIN d q ON p.channel = q.channel AND abs(q.l - p.l) < {L} GROUP BY ALL")
def atom_gram(s, d):
    return C.atom_gram(V.event_atoms(s, d, L), L)


@query(_DRAWN, f"SELECT p.k, q.k AS k2, CAST(q.l - p.l AS INTEGER) AS dt, CAST(sum(p.d * q.d) AS BIGINT) AS v FROM uv p JOIN uv q ON p.channel = q.channel AND abs(q.l - p.l) < {L} GROUP BY ALL")
def atom_gram_rank1(s, d):
    return C.rank1_gram(*V.event_uv(s, d, L), L)


@query(_EVENTS, "SELECT k, channel, l, v FROM zd")
def statistics_times_atoms(s, d):
    return C.convolve_statistics(C.code_correlation(V.event_codes(s, d, TV), L), V.integer_atoms(s, P5), L)


@query(_EVENTS, "SELECT k, channel, l, v FROM zd")
def statistics_times_rank1(s, d):
    return C.convolve_statistics_rank1(C.code_correlation(V.event_codes(s, d, TV), L), *V.integer_uv(s, P5), L)


@query(_EVENTS, f"SELECT k, channel, CAST(r.t - z.t AS INTEGER) AS l, CAST(sum(z * r) AS BIGINT) AS v FROM z JOIN r ON z.trial = r.trial AND r.t - z.t BETWEEN 0 AND {L - 1} GROUP BY ALL")
def residual_code_correlation(s, d):
    x, z, atoms = _xzd(s, d)
    return C.residual_correlation(z, x, atoms, L)


@query(_EVENTS, f"SELECT trial, k, CAST(t - l AS INTEGER) AS t, CAST(sum(x * d) AS BIGINT) AS c FROM x JOIN d USING (channel) WHERE t - l BETWEEN 0 AND {TV - 1} GROUP BY ALL")
def atom_signal_correlation(s, d):
    x, _, atoms = _xzd(s, d)
    return C.atom_correlation(x, atoms, TV)


@query(_EVENTS, f"SELECT trial, k, CAST(t - l AS INTEGER) AS t, CAST(sum(x * d) AS BIGINT) AS c FROM x JOIN d USING (channel) WHERE t - l BETWEEN 0 AND {TV - 1} GROUP BY ALL")
def rank1_signal_correlation(s, d):
    return C.rank1_correlation(V.event_signal(s, d), *V.integer_uv(s, P5), TV)


_PATCH = f"pe AS (SELECT trial, CAST(t - o AS INTEGER) AS t, CAST(sum(r * r) AS BIGINT) AS e FROM r, range({L}) q(o) WHERE t - o BETWEEN 0 AND {T - L} GROUP BY ALL)"


@query(_EVENTS + ",\n" + _PATCH, "SELECT trial, t, e FROM pe")
def patch_error(s, d):
    return C.residual_patch_error(*_xzd(s, d), L, T)


@query(_EVENTS + ",\n" + _PATCH + ", best AS (SELECT * FROM pe ORDER BY e DESC, trial, t LIMIT 1)", f"SELECT channel, CAST(x.t - best.t AS INTEGER) AS l, x AS d FROM x JOIN best ON x.trial = best.trial AND x.t - best.t BETWEEN 0 AND {L - 1}")
def max_error_patch(s, d):
    x, z, atoms = _xzd(s, d)
    return C.worst_patch(C.residual_patch_error(x, z, atoms, L, T), x, L)


@query(_EVENTS, f"SELECT (SELECT CAST(sum(v) AS BIGINT) FROM ztz) AS ztz, (SELECT CAST(sum(v) AS BIGINT) FROM ztx) AS ztx, (SELECT CAST(sum(x * x) AS BIGINT) FROM x) AS xtx, {P5} AS channels")
def d_step_constants(s, d):
    x, z, _ = _xzd(s, d)
    ztz, ztx, xtx = C.constants(z, x, L)
    return ztz.agg(F.sum("v").alias("ztz")).crossJoin(ztx.agg(F.sum("v").alias("ztx"))).crossJoin(xtx).withColumn("channels", F.lit(P5))


# Objective and gradients

_OBJECTIVE = f"SELECT CAST((SELECT sum(r * r) FROM r) AS DOUBLE) / 2 + {float(REG)} * CAST((SELECT sum(abs(z)) FROM z) AS DOUBLE) AS objective"


@query(_EVENTS, _OBJECTIVE)
def objective(s, d):
    return O.objective(*_xzd(s, d), float(REG), none=None)


@query(_EVENTS, _OBJECTIVE)
def fast_objective(s, d):
    x, z, atoms = _xzd(s, d)
    ztz, ztx, xtx = C.constants(z, x, L)
    return O.fast_objective(ztz, ztx, xtx, z, atoms, L, REG, none=None)


@query(_EVENTS, "SELECT CAST((SELECT sum(r * r) FROM r) AS DOUBLE) / 2 + (SELECT CAST(sum(CASE WHEN k = 0 THEN 2.0 ELSE 5.0 END * z) AS DOUBLE) FROM z) AS objective")
def objective_per_atom(s, d):
    return O.per_atom_objective(*_xzd(s, d), s.createDataFrame([(0, 2.0), (1, 5.0)], "k int, reg double"), none=None)


@query(_EMBEDDINGS, f"SELECT (SELECT CAST(sum((1 + t % 3) * r * r) AS DOUBLE) / 2 FROM r) + {float(REG)} * (SELECT CAST(sum(z) AS DOUBLE) FROM z) AS objective")
def objective_weighted(s, d):
    x, z, atoms = _univariate(s, d)
    w = x.select("trial", "t", (1 + F.col("t") % 3).cast("long").alias("w"))
    return O.weighted_objective(x, z, atoms, w, float(REG), none=None)


@query(_EVENTS, f"""SELECT round(sum(e) / 2 + {float(REG)} * (SELECT sum(z * n) FROM z JOIN (SELECT k, greatest(1, sqrt(sum(d * d))) AS n FROM d GROUP BY k) USING (k)), 2) AS objective
FROM (SELECT CAST(r * r AS DOUBLE) AS e FROM r)""")
def objective_feasible(s, d):
    found = O.feasible_objective(*_xzd(s, d), float(REG), none=None)
    return found.select(F.round("objective", 2).alias("objective"))


@query(_EMBEDDINGS, f"""SELECT round(sum(e) / 2 + {float(REG)} * (SELECT sum(z * n) FROM z JOIN (SELECT k, greatest(1, sqrt(sum(d * d))) AS n FROM d GROUP BY k) USING (k)), 2) AS objective
FROM (SELECT CAST(r * r AS DOUBLE) AS e FROM r)""")
def objective_feasible_univariate(s, d):
    return O.feasible_objective_univariate(*_univariate(s, d), float(REG), none=None).select(F.round("objective", 2).alias("objective"))


@query(_EVENTS, "SELECT trial, k, t, CAST(g AS DOUBLE) AS g FROM gz")
def grad_z(s, d):
    return O.gradient_z(*_xzd(s, d), float(REG), TV)


@query(_EMBEDDINGS, f"SELECT trial, k, CAST(t - l AS INTEGER) AS t, CAST({REG} - sum((1 + t % 3) * r * d) AS DOUBLE) AS g FROM r, d WHERE t - l BETWEEN 0 AND {EV - 1} GROUP BY trial, k, t - l")
def grad_z_weighted(s, d):
    x, z, atoms = _univariate(s, d)
    w = x.select("trial", "t", (1 + F.col("t") % 3).cast("long").alias("w"))
    return O.weighted_gradient_z(x, z, atoms, w, float(REG), EV)


@query(_EVENTS, "SELECT k, channel, l, g FROM gd")
def grad_d(s, d):
    x, z, atoms = _xzd(s, d)
    return O.gradient_d(C.code_correlation(z, L), C.signal_correlation(z, x, L), atoms, L)


@query(_EVENTS, "SELECT k, channel, l, g FROM gd")
def grad_d_from_residual(s, d):
    return O.gradient_d_from_residual(*_xzd(s, d), L)


@query(_EVENTS, "SELECT k, 0 AS part, channel AS i, CAST(sum(g * v) AS BIGINT) AS g FROM gd JOIN a USING (k, l) GROUP BY ALL UNION ALL SELECT k, 1, l, CAST(sum(g * u) AS BIGINT) FROM gd JOIN u USING (k, channel) GROUP BY ALL")
def grad_uv(s, d):
    x, z, atoms = _xzd(s, d)
    g = O.gradient_d(C.code_correlation(z, L), C.signal_correlation(z, x, L), atoms, L)
    gu, gv = O.gradient_uv(g, *V.integer_uv(s, P5))
    return gu.select("k", F.lit(0).alias("part"), F.col("channel").alias("i"), "g").union(gv.select("k", F.lit(1), "l", "g"))


@query(_EVENTS, "SELECT round((SELECT sqrt(CAST(sum(g * g) AS DOUBLE)) FROM gd) + (SELECT sqrt(CAST(sum(g * g) AS DOUBLE)) FROM gz), 3) AS norm")
def grad_norm(s, d):
    x, z, atoms = _xzd(s, d)
    gd = O.gradient_d(C.code_correlation(z, L), C.signal_correlation(z, x, L), atoms, L)
    return O.gradient_norm(O.gradient_z(x, z, atoms, REG, TV), gd).select(F.round("norm", 3).alias("norm"))


_CORRELATION = f"c AS (SELECT trial, k, t - l AS t, CAST(sum(x * d) AS BIGINT) AS c FROM x JOIN d USING (channel) WHERE t - l BETWEEN 0 AND {TV - 1} GROUP BY ALL)"


@query(_EVENTS + ",\n" + _CORRELATION, "SELECT k, CAST(max(c) AS DOUBLE) AS lambda_max FROM c GROUP BY k")
def lambda_max(s, d):
    x, _, atoms = _xzd(s, d)
    return O.lambda_max(x, atoms, TV, x)


@query(_EVENTS + ",\n" + _CORRELATION, f"""SELECT k, quantile_cont(CAST(coalesce(c, 0) AS DOUBLE), 0.9) AS lambda_max
FROM (SELECT trial, k, t FROM trials, (VALUES (0), (1)) w(k), range({TV}) q(t)) LEFT JOIN c USING (trial, k, t) GROUP BY k""")
def lambda_quantile(s, d):
    x, _, atoms = _xzd(s, d)
    return O.lambda_max(x, atoms, TV, x, 0.9)


@query(_EVENTS, f"""SELECT k, round(variance, 6) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, k) AS INTEGER) AS rank FROM (
SELECT k, CAST(sum(x * x) AS DOUBLE) / n - (CAST(sum(x) AS DOUBLE) / n) * (CAST(sum(x) AS DOUBLE) / n) AS variance
FROM (SELECT k, trial, channel, t + l AS t, sum(z * d) AS x FROM z JOIN d USING (k) GROUP BY ALL), (SELECT CAST(count(*) * {P5 * T} AS DOUBLE) AS n FROM trials) GROUP BY k, n)""")
def explained_variance(s, d):
    x, z, atoms = _xzd(s, d)
    return O.explained_variance(z, atoms, P5, T, x, unused=False).withColumn("variance", F.round("variance", 6))


@query(_EVENTS, f"SELECT k, count(*) AS nnz, count(*) / ((SELECT count(*) FROM trials) * {float(TV)}) AS density FROM z GROUP BY k")
def nnz_per_atom(s, d):
    x, z, atoms = _xzd(s, d)
    return O.nnz_per_atom(z, atoms, TV, x)


@query(_EVENTS, """SELECT trial, round(CASE WHEN xx > 0 AND hh > 0 THEN xh / sqrt(xx * hh) END, 9) AS score FROM (
SELECT trial, CAST(sum(x * h) AS DOUBLE) AS xh, CAST(sum(x * x) AS DOUBLE) AS xx, CAST(sum(h * h) AS DOUBLE) AS hh FROM (
SELECT trial, channel, t, sum(x) AS x, sum(h) AS h FROM (SELECT trial, channel, t, x, 0 AS h FROM x UNION ALL SELECT trial, channel, t, 0, x FROM hat) GROUP BY ALL) GROUP BY trial)""")
def correlation_score(s, d):
    x, z, atoms = _xzd(s, d)
    return O.reconstruction_score(x, z, atoms).withColumn("score", F.round("score", 9))


_STEP = 2.0**-10


@query(_EVENTS, f"SELECT trial, k, t, sum(z) AS z FROM (SELECT trial, k, t, CAST(z AS DOUBLE) AS z FROM z UNION ALL SELECT trial, k, t, {-_STEP} * CAST(g AS DOUBLE) FROM gz) GROUP BY ALL HAVING sum(z) > 0")
def ista_step(s, d):
    return O.ista_step(*_xzd(s, d), float(REG), _STEP, TV)


# Atoms


@query(_DRAWN, "SELECT k, channel, l, round(d / norm, 9) AS d, round(norm, 9) AS norm FROM d JOIN (SELECT k, greatest(1.0, sqrt(CAST(sum(d * d) AS DOUBLE))) AS norm FROM d GROUP BY k) USING (k)")
def project_d(s, d):
    found = AT.project_d(V.event_atoms(s, d, L))
    return found.select("k", "channel", "l", F.round("d", 9).alias("d"), F.round("norm", 9).alias("norm"))


def _uv(u: DataFrame, v: DataFrame) -> DataFrame:
    return u.select("k", F.lit(0).alias("part"), F.col("channel").alias("i"), F.round("u", 9).alias("x")).union(v.select("k", F.lit(1), "l", F.round("v", 9)))


_NORMS = "nu AS (SELECT k, CAST(sum(u * u) AS DOUBLE) AS q FROM u GROUP BY k), nv AS (SELECT k, CAST(sum(v * v) AS DOUBLE) AS q FROM a GROUP BY k)"


@query(_DRAWN + ",\n" + _NORMS, "SELECT k, 0 AS part, channel AS i, round(u / greatest(1.0, sqrt(q)), 9) AS x FROM u JOIN nu USING (k) UNION ALL SELECT k, 1, l, round(v / greatest(1.0, sqrt(q)), 9) FROM a JOIN nv USING (k)")
def project_uv(s, d):
    return _uv(*AT.project_uv(*V.event_uv(s, d, L), "separate"))


@query(_DRAWN + ",\n" + _NORMS + ", nj AS (SELECT k, nu.q + nv.q AS q FROM nu JOIN nv USING (k))", "SELECT k, 0 AS part, channel AS i, round(u / greatest(1.0, sqrt(q)), 9) AS x FROM u JOIN nj USING (k) UNION ALL SELECT k, 1, l, round(v / greatest(1.0, sqrt(q)), 9) FROM a JOIN nj USING (k)")
def project_uv_joint(s, d):
    return _uv(*AT.project_uv(*V.event_uv(s, d, L), "joint"))


@query(_DRAWN, "SELECT k, channel, l, d FROM uv")
def uv_to_full(s, d):
    return AT.uv_to_full(*V.event_uv(s, d, L))


@query(_DRAWN, """SELECT k, 0 AS part, channel AS i, CAST(-u * s AS BIGINT) AS x FROM u JOIN g USING (k) UNION ALL SELECT k, 1, l, CAST(-v * s AS BIGINT) FROM a JOIN g USING (k)""".replace("g USING", "(SELECT k, CASE WHEN arg_max(-v, abs(v) * 100 - l) < 0 THEN -1 ELSE 1 END AS s FROM a GROUP BY k) USING"))
def flip_uv(s, d):
    u, v = V.event_uv(s, d, L)
    u, v = AT.flip_uv(u.withColumn("u", -F.col("u")), v.withColumn("v", -F.col("v")))
    return u.select("k", F.lit(0).alias("part"), F.col("channel").alias("i"), F.col("u").alias("x")).union(v.select("k", F.lit(1), "l", "v"))


@query(_DRAWN, "SELECT CAST(max(k) + 1 AS INTEGER) AS atoms, CAST(max(channel) + 1 AS INTEGER) AS channels, CAST(max(l) + 1 AS INTEGER) AS length FROM d")
def dictionary_shape(s, d):
    return AT.dictionary_shape(V.event_atoms(s, d, L)).select(*(F.col(c).cast("int").alias(c) for c in ("atoms", "channels", "length")))


@query(_EVENTS, f"SELECT k, channel, CAST(x.t - t0 AS INTEGER) AS l, x AS d FROM x JOIN (VALUES (0, 1, 10), (1, 3, 200), (2, 5, 500)) w(k, trial, t0) ON x.trial = w.trial AND x.t - t0 BETWEEN 0 AND {L - 1}")
def chunk_dictionary(s, d):
    return AT.chunk_dictionary(V.event_signal(s, d), s.createDataFrame([(0, 1, 10), (1, 3, 200), (2, 5, 500)], "k int, trial long, t0 int"), L)


# Preprocessing


@query(_SHIPPING, f"SELECT CAST(trial * 10 + t // {V.SHIPDAYS // 10} AS BIGINT) AS trial, channel, CAST(t % {V.SHIPDAYS // 10} AS INTEGER) AS t, x FROM s WHERE t < {V.SHIPDAYS // 10 * 10}")
def split_signal(s, d):
    return P.split_signal(V.shipping_signal(s, d), V.SHIPDAYS, 10)


def _taper_sql(kind: str) -> str:
    n, m = E, E - 1
    edge = 0.5 * m / 2
    return {
        "tukey": f"CASE WHEN t = 0 OR t = {m} THEN 1e-9 WHEN t < {edge} THEN 0.5 * (1 + cos(pi() * (t / {edge} - 1))) WHEN t > {m - edge} THEN 0.5 * (1 + cos(pi() * (({m} - t) / {edge} - 1))) ELSE 1 END",
        "hamming": f"0.54 - 0.46 * cos(2 * pi() * t / {m})",
        "blackman": f"0.42 - 0.5 * cos(2 * pi() * t / {m}) + 0.08 * cos(4 * pi() * t / {m})",
    }[kind]


for _kind in ("tukey", "hamming", "blackman"):

    def _taper(s, d, kind=_kind):
        return P.taper(P.as_univariate(V.embedding_signal(s, d)), E, kind).select("trial", "t", F.round("x", 6).alias("x"))

    QUERIES[f"taper_{_kind}"] = _taper
    SQL[f"taper_{_kind}"] = f"WITH {_EMBEDDINGS.strip()}\nSELECT trial, t, round(x * ({_taper_sql(_kind)}), 6) AS x FROM e"


@query(_EMBEDDINGS, "SELECT trial, 0 AS channel, t, round(x / stddev_pop(x) OVER (), 6) AS x FROM e")
def rescale(s, d):
    return P.rescale(P.as_univariate(V.embedding_signal(s, d))).withColumn("x", F.round("x", 6))


@query(_EVENTS, f"SELECT round(sqrt(CAST(sum(x * x) AS DOUBLE) / n - (CAST(sum(x) AS DOUBLE) / n) * (CAST(sum(x) AS DOUBLE) / n)), 6) AS std FROM x, (SELECT CAST(count(*) * {P5 * T} AS DOUBLE) AS n FROM trials) GROUP BY n")
def spread_with_zeros(s, d):
    x = V.event_signal(s, d)
    return P.spread(x, x.select("trial").distinct().count() * P5 * T).select(F.round("std", 6).alias("std"))


@query(_EVENTS, "SELECT trial, channel, t, x FROM x WHERE channel < 3")
def pick_channels(s, d):
    return P.pick_channels(V.event_signal(s, d), 3)


@query(_EVENTS, "SELECT trial, channel, t, x FROM x WHERE t <= (SELECT min(m) FROM (SELECT max(t) AS m FROM x GROUP BY trial))")
def equalize_crop(s, d):
    return P.equalize(V.event_signal(s, d), "crop")


@query(_EVENTS, "SELECT trial, channel, t, coalesce(x, 0) AS x FROM (SELECT DISTINCT trial, channel FROM x), (SELECT unnest(range(0, max(t) + 1))::INTEGER AS t FROM x) LEFT JOIN x USING (trial, channel, t)".replace("FROM (SELECT DISTINCT trial, channel FROM x), (SELECT unnest(range(0, max(t) + 1))::INTEGER AS t FROM x) LEFT", "FROM (SELECT * FROM (SELECT DISTINCT trial, channel FROM x), (SELECT unnest(range(0, max(t) + 1))::INTEGER AS t FROM x)) LEFT"))
def equalize_zeropad(s, d):
    return P.equalize(V.event_signal(s, d), "zeropad")


@query(_SHIPPING, f"SELECT trial, CAST(w AS INTEGER) AS window, channel, CAST(t - w * 75 AS INTEGER) AS t, x FROM s, range({(V.SHIPDAYS - 100) // 75 + 1}) r(w) WHERE t - w * 75 BETWEEN 0 AND 99")
def trial_windows(s, d):
    return P.sliding_trials(V.shipping_signal(s, d), V.SHIPDAYS, 100, 25)


@query(_EMBEDDINGS, f"SELECT trial, 0 AS channel, CAST(t - i * 2 AS INTEGER) AS t, CAST(i AS INTEGER) AS i, x FROM e, range(5) r(i) WHERE t - i * 2 BETWEEN 0 AND {E - 1 - 8}")
def lag_embedding(s, d):
    return P.lag_embedding(P.as_univariate(V.embedding_signal(s, d)), 5, 2)


@query(_EVENTS, "SELECT trial, CAST(sum(x * x) AS BIGINT) AS power FROM x GROUP BY trial")
def trial_energy(s, d):
    return P.energy(V.event_signal(s, d))


@query(_EVENTS, "SELECT trial, n, CAST(CASE WHEN n <= 1 THEN 1 ELSE 2 ** ceil(log2(n)) END AS BIGINT) AS p, (n & (n - 1)) = 0 AS is_power FROM (SELECT trial, count(*) AS n FROM x GROUP BY trial)")
def power_of_two(s, d):
    n = V.event_signal(s, d).groupBy("trial").agg(F.count("*").alias("n"))
    return n.select("trial", "n", K.next_power_of_two(F.col("n")).alias("p"), K.is_power_of_two(F.col("n")).alias("is_power"))


@query(_EVENTS, """SELECT s AS shape, CAST(l AS INTEGER) AS l, round(CASE s WHEN 'sin' THEN sin(4 * pi() * l / 32) WHEN 'cos' THEN cos(4 * pi() * l / 32)
    ELSE CASE WHEN l >= 32 THEN 0 WHEN s = 'square' THEN CASE WHEN (l // 8) % 2 = 0 THEN 0.5 ELSE -0.5 END WHEN (l // 8) % 2 = 0 THEN (l % 8) / 7.0 ELSE 1 - (l % 8) / 7.0 END END, 9) AS x
FROM (VALUES ('triangle'), ('square'), ('sin'), ('cos')) w(s), range(33) r(l)""")
def atom_shapes(s, d):
    at = s.range(33).select(F.col("id").cast("int").alias("l"))
    parts = [at.select(F.lit(n).alias("shape"), "l", F.round(K.atom_shape(n, F.col("l"), 33, 2), 9).alias("x")) for n in ("triangle", "square", "sin", "cos")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# Analytics

_LO, _HI = -3, 8
_AXIS = f"axis AS (SELECT k, CAST(trial * {TV} + t AS BIGINT) AS sample, z FROM z), ev AS (SELECT row_number() OVER (ORDER BY trial, t) - 1 AS epoch, CAST(trial * {TV} + t AS BIGINT) AS sample FROM (SELECT DISTINCT trial, t FROM x JOIN types USING (channel) WHERE event_type = 'purchase' AND t BETWEEN 3 AND {TV - 9}))"


def _epochs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    axis = A.on_one_axis(V.event_codes(s, d, TV), TV)
    bought = V.table(s, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("trial"), F.floor((F.unix_timestamp("ts") - V.EPOCH_2024) / 3600).cast("int").alias("t")).distinct()
    bought = bought.where((F.col("t") >= 3) & (F.col("t") <= TV - 9)).select((F.col("trial") * TV + F.col("t")).cast("long").alias("sample"))
    return axis, bought.select(F.col("sample").alias("epoch"), "sample")  # the sample itself names an event


@query(_EVENTS + ",\n" + _AXIS, f"SELECT ev.sample AS epoch, k, CAST(axis.sample - ev.sample AS INTEGER) AS o, z FROM axis JOIN ev ON axis.sample - ev.sample BETWEEN {_LO} AND {_HI}")
def epoch_codes(s, d):
    return A.epoch_codes(*_epochs(s, d), _LO, _HI)


@query(_EVENTS + ",\n" + _AXIS, f"SELECT k, CAST(axis.sample - ev.sample AS INTEGER) AS o, CAST(sum(z) AS DOUBLE) / (SELECT count(*) FROM ev) AS mean FROM axis JOIN ev ON axis.sample - ev.sample BETWEEN {_LO} AND {_HI} GROUP BY k, axis.sample - ev.sample")
def evoked_average(s, d):
    axis, ev = _epochs(s, d)
    return A.evoked(A.epoch_codes(axis, ev, _LO, _HI), ev.count())


N_SURROGATES, _SEED = 100, 5
#: As many times for each surrogate as there are events, anywhere on the axis, by the first 32 bits of an MD5 that both engines have.
_SURROGATE_SQL = _AXIS + f""", whole AS (SELECT (max(trial) + 1) * {TV} AS samples FROM trials),
su AS (SELECT CAST(s AS INTEGER) AS surrogate, sample AS epoch, {-_LO} + CAST('0x' || substr(md5({_SEED} || '/' || s || '/' || sample), 1, 8) AS BIGINT) % (samples - {_HI - _LO}) AS sample
       FROM (SELECT ev.sample, samples, s FROM ev, whole, range({N_SURROGATES}) r(s))),
sm AS (SELECT surrogate, k, CAST(axis.sample - su.sample AS INTEGER) AS o, sum(z) / CAST((SELECT count(*) FROM ev) AS DOUBLE) AS mean
       FROM (SELECT surrogate, sample, unnest(range({_LO}, {_HI + 1})) + sample AS at FROM su) su JOIN axis ON axis.sample = su.at GROUP BY ALL)"""


def _surrogate_means(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    axis, ev = _epochs(s, d)
    samples = V.event_signal(s, d).agg(((F.max("trial") + 1) * TV).alias("samples")).first().samples
    drawn = A.surrogate_events(ev, N_SURROGATES, samples, _LO, _HI, _SEED)
    return drawn, A.surrogate_evoked(axis, drawn, _LO, _HI, ev.count())


@query(_EVENTS + ",\n" + _SURROGATE_SQL, "SELECT surrogate, k, o, round(mean, 9) AS mean FROM sm")
def surrogate_average(s, d):
    return _surrogate_means(s, d)[1].withColumn("mean", F.round("mean", 9))


@query(_EVENTS + ",\n" + _SURROGATE_SQL, f"""SELECT k, round(quantile_cont(lo, 0.1), 9) AS low, round(quantile_cont(hi, 0.9), 9) AS high FROM (
SELECT surrogate, k, min(coalesce(mean, 0)) AS lo, max(coalesce(mean, 0)) AS hi FROM (SELECT DISTINCT surrogate FROM su), (VALUES (0), (1)) w(k), (SELECT CAST(o AS INTEGER) AS o FROM range({_LO}, {_HI + 1}) r(o)) q LEFT JOIN sm USING (surrogate, k, o) GROUP BY ALL) GROUP BY k""".replace("FROM (SELECT DISTINCT surrogate FROM su), (VALUES (0), (1)) w(k), (SELECT CAST(o AS INTEGER) AS o FROM range", "FROM (SELECT surrogate, k, o FROM (SELECT DISTINCT surrogate FROM su), (VALUES (0), (1)) w(k), (SELECT CAST(o AS INTEGER) AS o FROM range").replace(") r(o)) q LEFT", ") r(o)) q) LEFT"))
def surrogate_thresholds(s, d):
    ev, means = _surrogate_means(s, d)
    return A.evoked_thresholds(means, V.integer_atoms(s, 1), ev, _HI - _LO + 1, 0.1).select("k", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(_EVENTS, """SELECT k, CAST(t + o - 3 AS INTEGER) AS t, round(sum(z * (0.42 - 0.5 * cos(2 * pi() * o / 6) + 0.08 * cos(4 * pi() * o / 6))), 6) AS density
FROM (SELECT * FROM (SELECT k, t, CAST(sum(z) AS DOUBLE) AS z FROM z GROUP BY k, t) QUALIFY z > 0.25 * max(z) OVER (PARTITION BY k)), range(7) r(o) GROUP BY k, t + o""")
def activation_density(s, d):
    return A.activation_density(V.event_codes(s, d, TV), 7, 0.25).withColumn("density", F.round("density", 6))


@query(_EVENTS, """SELECT k, CAST(t + o - 3 AS INTEGER) AS t, round(sum(z / total * (0.42 - 0.5 * cos(2 * pi() * o / 6) + 0.08 * cos(4 * pi() * o / 6)) / 2.52), 9) AS density
FROM (SELECT k, t, CAST(sum(z) AS DOUBLE) AS z FROM z GROUP BY k, t) JOIN (SELECT k, CAST(sum(z) AS DOUBLE) AS total FROM z GROUP BY k) USING (k), range(7) r(o) GROUP BY k, t + o""")
def kernel_density(s, d):
    return A.kernel_density(V.event_codes(s, d, TV), 7).withColumn("density", F.round("density", 9))


_DENSE = f"dz AS (SELECT trial, k, CAST(t AS INTEGER) AS t, coalesce(z.z, 0) AS z FROM (SELECT trial, k, t FROM trials, (VALUES (0), (1)) w(k), range({TV}) q(t)) LEFT JOIN z USING (trial, k, t)), be AS (SELECT trial, k, t, CAST(sum(z) OVER (PARTITION BY trial, k ORDER BY t ROWS 23 PRECEDING) AS DOUBLE) AS e FROM dz), lr AS (SELECT trial, k, t, log10(greatest(e, 1e-4) / greatest(b, 1e-4)) AS ratio FROM be JOIN (SELECT trial, k, avg(e) AS b FROM be WHERE t < 24 GROUP BY ALL) USING (trial, k))"


def _ratio(s: SparkSession, d: str) -> DataFrame:
    z = V.event_codes(s, d, TV)
    users = V.table(s, d, "events").where("event_type IS NOT NULL").select(F.col("user_id").alias("trial"))
    full = C.grid(users, 2, TV).withColumnRenamed("channel", "k")
    return A.log_ratio(A.box_energy(full.join(z, ["trial", "k", "t"], "left").fillna(0, ["z"]), 24), 24)


@query(_EVENTS + ",\n" + _DENSE, "SELECT trial, k, t, round(ratio, 9) AS ratio FROM lr")
def log_ratio(s, d):
    return _ratio(s, d).withColumn("ratio", F.round("ratio", 9))


@query(_EVENTS + ",\n" + _DENSE, """SELECT k, part, round(quantile_cont(ratio, 0.25), 6) AS q25, round(quantile_cont(ratio, 0.5), 6) AS q50, round(quantile_cont(ratio, 0.75), 6) AS q75
FROM (SELECT *, CASE WHEN t < 24 THEN 'baseline' WHEN t < 48 THEN 'evoked' WHEN t < 72 THEN 'induced' END AS part FROM lr) WHERE part IS NOT NULL GROUP BY k, part""")
def whiskers(s, d):
    return A.whiskers(_ratio(s, d), 24).select("k", "part", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")))


@query(_EVENTS, "SELECT trial, k, t, z / CAST(max(abs(z)) OVER (PARTITION BY k) AS DOUBLE) AS z FROM z")
def normalized_codes(s, d):
    return A.normalized_codes(V.event_codes(s, d, TV))


@query(_EVENTS, """SELECT iter, sum(seconds) OVER (ORDER BY iter) AS seconds, round((objective - min(objective) OVER ()) / min(objective) OVER () + 1e-6, 9) AS gap
FROM (SELECT CAST(t // 24 AS INTEGER) AS iter, CAST(sum(abs(x)) AS DOUBLE) AS objective, CAST(count(*) AS DOUBLE) AS seconds FROM x WHERE t >= 0 GROUP BY t // 24)""")
def convergence_curve(s, d):
    """The days of the events as a trace: amounts as the objective, numbers of events as seconds."""
    day = V.event_signal(s, d).where("t >= 0").groupBy(F.expr("cast(t div 24 AS int)").alias("iter"))
    trace = day.agg(F.sum(F.abs("x")).cast("double").alias("objective"), F.count("*").cast("double").alias("seconds")).withColumn("step", F.lit("z"))
    return A.convergence_curve(trace).withColumn("gap", F.round("gap", 9))


@query(_EVENTS, "SELECT channel, round(exp(avg(ln(CAST(x AS DOUBLE)))), 6) AS gmean FROM x WHERE x > 0 GROUP BY channel")
def geometric_mean(s, d):
    return A.geometric_mean(V.event_signal(s, d).where("x > 0").withColumn("x", F.col("x").cast("double")), ["channel"], "x").withColumn("gmean", F.round("gmean", 6))


_WINDOWS = """, w AS (SELECT trial, t // 16 AS win, t % 16 AS i, CAST(x AS DOUBLE) AS x FROM e),
n AS (SELECT trial, win, i, (x - avg(x) OVER (PARTITION BY trial, win)) / stddev_pop(x) OVER (PARTITION BY trial, win) AS x FROM w),
p AS (SELECT trial, a.win AS v, b.win AS w, sum((a.x - b.x) * (a.x - b.x)) AS s FROM n a JOIN n b USING (trial, i) WHERE a.win < b.win GROUP BY ALL)"""


@query(_EMBEDDINGS + _WINDOWS, "SELECT trial, round(avg(s), 6) AS cost FROM p GROUP BY trial")
def window_distance(s, d):
    """The windows of every vector, four each."""
    at = V.embedding_signal(s, d)
    w = at.select("trial", F.floor(F.col("t") / 16).alias("window"), (F.col("t") % 16).alias("i"), F.col("x").cast("double").alias("x"))
    return A.window_distance(w, ["trial"]).select("trial", F.round("cost", 6).alias("cost"))
