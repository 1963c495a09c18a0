"""Registered queries of the encoders and learners; where SQL cannot express one, tests hold it against properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import dictionary as dic
from ..kernels import motifs as M
from ..kernels import signal as S
from ..kernels import stable as ST
from ..operators import preprocess as P
from ..operators import series as SE
from ..sources import simulate as SIM
from ..sources import views as V
from ..sources.memo import Memo
from . import encode as E
from . import learn as L
from .long import LongSignal
from .model import OnlineCDL, atoms_table
from .queries import SQL as TABLE_SQL
from ..operators.shared import scratch, settled

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = 24


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Vectors as series of 64 samples, in thousandths.
SERIES = f"""e AS (SELECT vec_id AS trial, CAST(i - 1 AS INTEGER) AS t, round(CAST(embedding[i] AS DOUBLE) * 1000) AS x
    FROM embeddings, range(1, {V.EMBEDDING + 1}) r(i))"""
_TURN = f"2 * pi() / {V.EMBEDDING}"


def checked(sql: str):
    """Registers a query of the vectors' series with its SQL."""

    def keep(f):
        SQL[f.__name__] = f"WITH {SERIES}{sql}"
        return query(f)

    return keep


def _events(s: SparkSession, d: str) -> DataFrame:
    """The event signal in units of its own deviation, about."""
    return V.event_signal(s, d).withColumn("x", F.col("x") / 10_000.0)


def _day_atoms() -> np.ndarray:
    """Two atoms of a day: a morning rise in all channels, a contrast of the first and the other channels."""
    t = np.arange(DAY)
    bump = np.exp(-0.5 * ((t - 10) / 3.0) ** 2)
    d = np.stack([np.outer(np.ones(V.EVENT_TYPES), bump), np.outer([1, -1, -1, -1, -1], np.roll(bump, 6))])
    return dic.project_d(d / np.sqrt((d * d).sum(axis=(1, 2), keepdims=True)))


def _encoded(s: SparkSession, d: str, solver: str, **options) -> tuple[E.Encoder, DataFrame]:
    encoder = E.Encoder(_day_atoms(), 0.5, solver, options)
    return encoder, encoder.encode(E.blocks(_events(s, d), V.EVENT_TYPES, V.HOURS))


@query
def encode_events(s, d):
    """Which day-long shapes explain a user's activity: (trial, nnz, loss, explained)."""
    encoder, table = _encoded(s, d, "lgcd")
    return encoder.trial_costs(table)


@query
def lgcd_encode(s, d):
    return E.codes(_encoded(s, d, "lgcd")[1], 2)


@query
def fista_encode(s, d):
    encoder, table = _encoded(s, d, "fista", tol=1e-4, max_iter=300)
    return encoder.trial_costs(table)


@query
def ista_encode(s, d):
    encoder, table = _encoded(s, d, "ista", tol=1e-3, max_iter=200)
    return encoder.trial_costs(table)


@query
def lbfgs_encode(s, d):
    encoder, table = _encoded(s, d, "l-bfgs", tol=1e-3, max_iter=60)
    return encoder.trial_costs(table)


@query
def unbiased_refit(s, d):
    encoder, table = _encoded(s, d, "lgcd")
    return encoder.trial_costs(encoder.encode(table, unbiased=True))


def _shape(got: L.Learned, s: SparkSession) -> DataFrame:
    return atoms_table(s, got.d)


def _fit(s: SparkSession, d: str, **kw) -> L.Learned:
    params = {"n_iter": 3, "reg": 0.1, "lmbd_max": "scaled", "D_init": "chunk", "random_state": 0, "raise_on_increase": False} | kw
    return L.learn(_events(s, d), 2, DAY, V.EVENT_TYPES, V.HOURS, **params)


@query
def batch_fit(s, d):
    return _shape(_fit(s, d), s)


@query
def batch_fit_full_rank(s, d):
    return _shape(_fit(s, d, rank1=False), s)


@query
def greedy_fit(s, d):
    return _shape(_fit(s, d, algorithm="greedy", D_init=None), s)


def _pass(s: SparkSession, d: str) -> dict:
    """Three batches that hold every trial once."""
    trials = V.table(s, d, "events").agg(F.countDistinct("user_id")).first()[0]
    return {"batch_size": -(-trials // 3), "batch_selection": "cyclic"}


@query
def online_fit(s, d):
    return _shape(_fit(s, d, algorithm="online", algorithm_params=_pass(s, d) | {"alpha": 0.8}), s)


@query
def stochastic_fit(s, d):
    return _shape(_fit(s, d, algorithm="stochastic", algorithm_params=_pass(s, d)), s)


@query
def partial_fit(s, d):
    model = OnlineCDL(2, DAY, V.EVENT_TYPES, V.HOURS, reg=0.1, D_init="chunk", random_state=0, alpha=0.8)
    x = _events(s, d)
    for i in range(2):
        model.partial_fit(x.where(F.col("trial") % 2 == i))
    return atoms_table(s, model.D_hat_)


def _unit_embeddings(s: SparkSession, d: str) -> DataFrame:
    return V.embedding_signal(s, d).withColumn("x", F.col("x") / 125.0)


@query
def univariate_fit(s, d):
    got = L.learn_univariate(_unit_embeddings(s, d), 2, 8, V.EMBEDDING, reg=0.5, n_iter=2, solver_z="lgcd", random_state=0)
    return atoms_table(s, got.d)


@query
def robust_fit(s, d):
    """All rounds, steps and chains of the learner, codes to its solver's tolerance."""
    got, _ = L.learn_robust(_unit_embeddings(s, d), 2, 8, V.EMBEDDING, reg=0.5, solver_z="fista", solver_z_kwargs={"restart": True, "step": "bound"})
    return atoms_table(s, got.d)


@query
def long_signal_encode(s, d):
    atoms = np.stack([np.outer(np.ones(3), np.sin(np.pi * np.arange(28) / 28)), np.outer([1, -1, 0], np.sin(2 * np.pi * np.arange(28) / 28))])
    x = V.shipping_signal(s, d)
    mean = x.groupBy("channel").agg(F.avg("x").alias("m"))
    flat = x.join(mean, "channel").select("trial", "channel", "t", ((F.col("x") - F.col("m")) / 20.0).alias("x"))
    return E.encode_long_signal(flat, dic.project_d(atoms), 0.05, 3, V.SHIPDAYS, 500, tol=0.05, rounds=6)


#: Quantities of the days and integer codes on them, for sums over blocks of 100 days.
_CODED = f"""WITH c AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS channel FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
    x AS (SELECT channel, date_diff('day', DATE '{V.FIRST_SHIPDAY}', CAST(l_shipdate AS DATE)) AS t, sum(CAST(l_quantity AS BIGINT)) AS x
        FROM lineitem JOIN c USING (l_returnflag) GROUP BY ALL HAVING t BETWEEN 0 AND {V.SHIPDAYS - 1}),
    z AS (SELECT 0 AS k, t, 1 AS z FROM x WHERE channel = 0 AND t <= {V.SHIPDAYS - V.LENGTH} AND x % 3 = 0
        UNION ALL SELECT 1, t, 2 FROM x WHERE channel = 0 AND t <= {V.SHIPDAYS - V.LENGTH} AND t % 5 = 0)"""


def coded(sql: str):
    def keep(f):
        SQL[f.__name__] = _CODED + sql
        return query(f)

    return keep


def _long_coded(s: SparkSession, d: str) -> LongSignal:
    signal = LongSignal(V.shipping_signal(s, d), 3, V.SHIPDAYS, V.LENGTH, 100)
    signal.put(V.shipping_codes(s, d, V.SHIPDAYS - V.LENGTH + 1), 2)
    return signal


@coded(f"""
SELECT 'ztz' AS what, a.k AS k, b.k AS other, CAST(b.t - a.t AS INTEGER) AS lag, CAST(sum(a.z * b.z) AS BIGINT) AS v FROM z a JOIN z b ON abs(b.t - a.t) < {V.LENGTH} GROUP BY a.k, b.k, b.t - a.t
UNION ALL SELECT 'ztX', k, CAST(channel AS INTEGER), CAST(x.t - z.t AS INTEGER), CAST(sum(z * x) AS BIGINT) FROM z JOIN x ON x.t - z.t BETWEEN 0 AND {V.LENGTH - 1} GROUP BY k, channel, x.t - z.t""")
def long_statistics(s, d):
    """Sufficient statistics of one long signal, block by block with their borders: (what, k, other atom or channel, lag, v)."""
    with _long_coded(s, d) as signal:
        got = signal.statistics(E.Encoder(np.zeros((2, 3, V.LENGTH)), 0.0))
    rows = [("ztz", *map(int, i[:2]), int(i[2]) - V.LENGTH + 1, int(got.ztz[i])) for i in zip(*np.nonzero(got.ztz))]
    rows += [("ztX", *map(int, i), int(got.ztx[i])) for i in zip(*np.nonzero(got.ztx))]
    return s.createDataFrame(rows, "what string, k int, other int, lag int, v long")  # as large as the statistics


@coded(f""", d AS (SELECT * FROM (VALUES {", ".join(f"({k}, {p}, {l}, {(p + 1) * v})" for k, a in enumerate(V.ATOM_TIMES) for p in range(3) for l, v in enumerate(a))}) v(k, channel, l, d)),
    r AS (SELECT channel, t, sum(x) AS r FROM (SELECT channel, t, x FROM x UNION ALL SELECT channel, t + l, -z * d FROM z JOIN d USING (k)) GROUP BY channel, t),
    s AS (SELECT q.t, sum(r * r) AS e FROM range({V.SHIPDAYS - V.LENGTH + 1}) q(t) JOIN r ON r.t - q.t BETWEEN 0 AND {V.LENGTH - 1} GROUP BY q.t),
    b AS (SELECT t FROM s ORDER BY e DESC, t LIMIT 1)
SELECT CAST(c.channel AS INTEGER) AS channel, CAST(l AS INTEGER) AS l, CAST(coalesce(x, 0) AS BIGINT) AS x
FROM b, range({V.LENGTH}) q(l), range(3) c(channel) LEFT JOIN x ON x.channel = c.channel AND x.t = b.t + l""")
def long_worst_patch(s, d):
    """The patch of a long signal that its codes explain worst, across the borders of blocks."""
    atoms = np.array([[[(p + 1) * v for v in a] for p in range(3)] for a in V.ATOM_TIMES], dtype=float)
    with _long_coded(s, d) as signal:
        patch = signal.worst_patch(atoms)
    return s.createDataFrame([(int(p), int(l), int(patch[p, l])) for p, l in np.ndindex(*patch.shape)], "channel int, l int, x long")


def _split_days(s: SparkSession, lineitem: str, parts: int = 10) -> DataFrame:
    return P.split_signal(V.shipping_signal(s, lineitem.rsplit("/", 1)[0]), V.SHIPDAYS, parts)


@query
def memoised_trials(s, d):
    """Trials that are cut once for each state of their input; the second call reads them back."""
    memo = Memo(s, scratch(s, "memo"))
    memo.table(_split_days, [f"{d}/lineitem.parquet"])
    return memo.table(_split_days, [f"{d}/lineitem.parquet"])


SQL["memoised_trials"] = TABLE_SQL["split_signal"]


def _by_series(x: DataFrame, f, schema: str = "trial long, channel int, t int, x double") -> DataFrame:
    """Each (trial, channel) series through a NumPy function of the same length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame({"trial": pdf["trial"], "channel": pdf["channel"], "t": pdf["t"], "x": f(pdf["x"].to_numpy(dtype=float))})

    return x.groupBy("trial", "channel").applyInPandas(run, schema)


def _filtered(s: SparkSession, d: str, f) -> DataFrame:
    return _by_series(P.as_univariate(V.embedding_signal(s, d)), f).withColumn("x", F.round("x", 6))


@checked(f""", h AS (SELECT a.trial, a.t, any_value(a.x) AS x, sum(b.x * s) AS h FROM e a JOIN e b USING (trial)
    JOIN (SELECT u, sum(sin({_TURN} * f * u)) / 32 AS s FROM range(-63, 64) r(u), range(1, 32) q(f) GROUP BY u) w ON w.u = a.t - b.t GROUP BY a.trial, a.t)
SELECT trial, 0 AS channel, t, round(sqrt(x * x + h * h), 6) AS x FROM h""")
def hilbert_envelope(s, d):
    return _filtered(s, d, S.envelope)


_TAPS = S.fir_taps(64.0, 4.0, 16.0, 31)


@checked(f""", h AS (SELECT unnest([{", ".join(repr(float(v)) for v in _TAPS)}]) AS h, unnest(range(31)) AS j),
    i AS (SELECT trial, t, j, h, t + 15 - j AS i FROM (SELECT DISTINCT trial FROM e), range(64) r(t), h)
SELECT trial, 0 AS channel, CAST(i.t AS INTEGER) AS t, round(sum(h * CASE WHEN i < 0 THEN 2 * lo.x - e.x WHEN i > 63 THEN 2 * hi.x - e.x ELSE e.x END), 6) AS x
FROM i JOIN e USING (trial) JOIN e lo USING (trial) JOIN e hi USING (trial)
WHERE lo.t = 0 AND hi.t = 63 AND e.t = CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END GROUP BY trial, i.t""")
def band_pass(s, d):
    """In blocks of 31 samples and more, which is two for each series."""
    x = SE.band(P.as_univariate(V.embedding_signal(s, d)), 64.0, 4.0, 16.0, 31, V.EMBEDDING, block=31)
    return x.withColumn("x", F.round("x", 6))


#: The daily quantities as one series of each flag, on every day.
_DAYS = f"""WITH c AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS channel FROM (SELECT DISTINCT l_returnflag FROM lineitem)),
    q AS (SELECT channel, date_diff('day', DATE '{V.FIRST_SHIPDAY}', CAST(l_shipdate AS DATE)) AS t, sum(CAST(l_quantity AS BIGINT)) AS x FROM lineitem JOIN c USING (l_returnflag) GROUP BY ALL),
    e AS (SELECT c.channel, r.t, coalesce(x, 0) AS x FROM c CROSS JOIN range({V.SHIPDAYS}) r(t) LEFT JOIN q ON q.channel = c.channel AND q.t = r.t)"""


def _long(sql: str):
    def keep(f):
        SQL[f.__name__] = _DAYS + sql
        return query(f)

    return keep


_WEEK = S.fir_taps(1.0, None, 1 / 14, 29)


@_long(f""", h AS (SELECT unnest([{", ".join(repr(float(v)) for v in _WEEK)}]) AS h, unnest(range(29)) AS j),
    i AS (SELECT e.channel, e.t, j, h, e.t + 14 - j AS i FROM e, h)
SELECT CAST(0 AS BIGINT) AS trial, CAST(i.channel AS INTEGER) AS channel, CAST(i.t AS INTEGER) AS t,
    round(sum(h * CASE WHEN i < 0 THEN 2 * lo.x - e.x WHEN i > {V.SHIPDAYS - 1} THEN 2 * hi.x - e.x ELSE e.x END), 3) AS x
FROM i JOIN e ON e.channel = i.channel AND e.t = CASE WHEN i < 0 THEN -i WHEN i > {V.SHIPDAYS - 1} THEN {2 * V.SHIPDAYS - 2} - i ELSE i END
JOIN e lo ON lo.channel = i.channel AND lo.t = 0 JOIN e hi ON hi.channel = i.channel AND hi.t = {V.SHIPDAYS - 1} GROUP BY i.channel, i.t""")
def long_low_pass(s, d):
    """Two weeks and slower, of one long series in blocks of 400 days with halos of 14."""
    return SE.fir(V.shipping_signal(s, d), _WEEK, V.SHIPDAYS, 400).withColumn("x", F.round("x", 3))


@_long(f""", w AS (SELECT CAST(i AS INTEGER) AS i, 0.54 - 0.46 * cos(2 * pi() * i / 63) AS w FROM range(64) r(i)),
    y AS (SELECT channel, b, i, w * x AS y FROM e, w, (SELECT b * 32 AS b FROM range({(V.SHIPDAYS - 64) // 32 + 1}) r(b)) WHERE t = b + i),
    z AS (SELECT channel, b, f, sum(y * cos(2 * pi() * f * i / 64)) AS re, sum(y * sin(2 * pi() * f * i / 64)) AS im FROM y, range(64) q(f) GROUP BY channel, b, f)
SELECT CAST(0 AS BIGINT) AS trial, CAST(channel AS INTEGER) AS channel, CAST(f AS INTEGER) AS f,
    round(sum(re * re + im * im) / {(V.SHIPDAYS - 64) // 32 + 1} / (SELECT sum(w * w) FROM w), 2) AS power FROM z GROUP BY channel, f""")
def long_periodogram(s, d):
    """Averaged spectra of windows of 64 days of one long series."""
    return SE.periodogram(V.shipping_signal(s, d), 64, times=V.SHIPDAYS).withColumn("power", F.round("power", 2))


@checked(f""", w AS (SELECT u, sum(cos({_TURN} * f * u)) / 32 AS c FROM range(-63, 64) r(u), range(9, 12) q(f) GROUP BY u)
SELECT a.trial, 0 AS channel, a.t, round(any_value(a.x) - sum(b.x * c), 6) AS x FROM e a JOIN e b USING (trial) JOIN w ON w.u = a.t - b.t GROUP BY a.trial, a.t""")
def notch_filter(s, d):
    return _filtered(s, d, lambda x: S.notch(x, 64.0, 10.0, 2.0))


@checked(f""", w AS (SELECT m, t, sum(CASE WHEN f = 0 THEN 1 WHEN f = 16 THEN cos({_TURN} * 16 * t) * cos(pi() * m) ELSE 2 * cos({_TURN} * f * (2 * m - t)) END) / 64 AS c
    FROM range(32) a(m), range(64) b(t), range(17) q(f) GROUP BY m, t)
SELECT trial, CAST(m AS INTEGER) AS t, round(sum(x * c), 6) AS x FROM e JOIN w USING (t) GROUP BY trial, m""")
def resample(s, d):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = S.resample(pdf.sort_values("t")["x"].to_numpy(dtype=float), 32)
        return pd.DataFrame({"trial": pdf["trial"].iloc[0], "t": np.arange(32), "x": out})

    return V.embedding_signal(s, d).groupBy("trial").applyInPandas(run, "trial long, t int, x double").withColumn("x", F.round("x", 6))


@checked(""", w AS (SELECT CAST(i AS INTEGER) AS i, 0.54 - 0.46 * cos(2 * pi() * i / 31) AS w FROM range(32) r(i)),
    y AS (SELECT trial, b, i, w * (x - m) AS y FROM e JOIN (SELECT trial, avg(x) AS m FROM e GROUP BY trial) USING (trial), (SELECT b * 16 AS b FROM range(3) r(b)), w WHERE t = b + i),
    r AS (SELECT trial, g, sum(a.y * c.y) / 3 / (SELECT sum(w * w) FROM w) AS r FROM y a JOIN y c USING (trial, b), range(4) q(g) WHERE c.i = (a.i + g) % 32 GROUP BY trial, g),
    p AS (SELECT trial, sum(r) FILTER (g = 0) AS r0, sum(r) FILTER (g = 1) AS r1, sum(r) FILTER (g = 2) AS r2, sum(r) FILTER (g = 3) AS r3 FROM r GROUP BY trial),
    one AS (SELECT *, r1 / r0 AS k1, r0 - r1 * r1 / r0 AS e1 FROM p),
    two AS (SELECT *, (r2 - k1 * r1) / e1 AS k2 FROM one),
    up AS (SELECT *, k1 - k2 * k1 AS a1, e1 * (1 - k2 * k2) AS e2 FROM two),
    three AS (SELECT *, (r3 - a1 * r2 - k2 * r1) / e2 AS k3 FROM up)
SELECT trial, CAST(i AS INTEGER) AS i, round(CASE i WHEN 0 THEN a1 - k3 * k2 WHEN 1 THEN k2 - k3 * a1 ELSE k3 END, 6) AS a, round(e2 * (1 - k3 * k3), 4) AS variance FROM three, range(3) q(i)""")
def ar_model(s, d):
    """Yule-Walker on averaged tapered blocks; the SQL sums circular autocorrelations and runs Levinson's recursion instead."""

    x = P.as_univariate(V.embedding_signal(s, d))
    mean = x.groupBy("trial").agg(F.avg("x").alias("m"))
    flat = x.join(mean, "trial").select("trial", "channel", "t", (F.col("x") - F.col("m")).alias("x"))
    found = SE.ar_models(SE.periodogram(flat, 32, times=V.EMBEDDING), 32, 3)
    return found.select("trial", "i", F.round("a", 6).alias("a"), F.round("variance", 4).alias("variance"))


#: Fixed values of the unrolled steps: step length and regularisation, over the integer atoms and samples in units of 128: all sums are exact.
_ISTA_STEP, _ISTA_REG, _ISTA_STEPS = 2.0**-7, 0.5, 3


def _ista_sql() -> str:
    atoms = ", ".join(f"({k}, {l}, {x}.0)" for k, a in enumerate(V.ATOM_TIMES) for l, x in enumerate(a))
    valid = V.EMBEDDING - V.LENGTH + 1
    out = f", d AS (SELECT * FROM (VALUES {atoms}) v(k, l, d)), x AS (SELECT trial, t, x / 128 AS x FROM e)"
    out += f", z0 AS (SELECT trial, k, CAST(t AS INTEGER) AS t, 0.0::DOUBLE AS z FROM (SELECT DISTINCT trial FROM e), range(2) w(k), range({valid}) r(t))"
    for i in range(_ISTA_STEPS):
        out += f""", r{i} AS (SELECT trial, t, sum(x) AS r FROM (SELECT * FROM x UNION ALL SELECT trial, t + l, -z * d FROM z{i} JOIN d USING (k)) GROUP BY ALL),
    c{i} AS (SELECT trial, k, t - l AS t, sum(r * d) AS c FROM r{i}, d WHERE t - l BETWEEN 0 AND {valid - 1} GROUP BY trial, k, t - l),
    z{i + 1} AS (SELECT trial, k, t, greatest(z + {_ISTA_STEP} * (c - {_ISTA_REG}), 0) AS z FROM z{i} JOIN c{i} USING (trial, k, t))"""
    return out + f" SELECT trial, CAST(k AS INTEGER) AS k, CAST(t AS INTEGER) AS t, z FROM z{_ISTA_STEPS} WHERE z > 0"


@checked(_ista_sql())
def ista_fixed_steps(s, d):
    """Three steps of the proximal encoder from zero, with a given step."""
    atoms = np.array(V.ATOM_TIMES, dtype=float)[:, None, :]
    encoder = E.Encoder(atoms, _ISTA_REG, "ista", {"fixed_steps": _ISTA_STEPS, "step": _ISTA_STEP})
    x = P.as_univariate(V.embedding_signal(s, d).withColumn("x", F.col("x") / 128.0))
    return E.codes(encoder.encode(E.blocks(x, 1, V.EMBEDDING)), 2)


@query
def motif_fit(s, d):
    """Atoms of each label's vectors; tasks send sums of outer products of aligned patches, one for each label and batch."""
    length, n_atoms, n_iter = 8, 2, 5
    rows = settled(V.table(s, d, "embeddings").select("label", "vec_id", "embedding").where("embedding IS NOT NULL AND label IS NOT NULL"))
    seeds = {r.label: np.array(r.first, dtype=float) for r in rows.groupBy("label").agg(F.min_by("embedding", F.xxhash64("vec_id")).alias("first")).collect()}  # one row a label
    found: dict[int, list[np.ndarray]] = {label: [] for label in seeds}
    for k in range(n_atoms):
        now = {}
        for label, x in seeds.items():
            now[label] = x[k * length : (k + 1) * length] / (np.linalg.norm(x[k * length : (k + 1) * length]) or 1.0)
        for _ in range(n_iter):
            for label, total in _outer_sums(rows, now).items():
                now[label] = M.next_atom(total, M.apart(found[label], length), now[label])
        for label, atom in now.items():
            found[label].append(atom)
    out = [(int(label), k, l, float(v)) for label, atoms in sorted(found.items()) for k, a in enumerate(atoms) for l, v in enumerate(a)]
    return s.createDataFrame(out, "label int, k int, l int, d double")


def _outer_sums(rows: DataFrame, atoms: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each label the sum of outer products of its series' patches that align best with the label's atom."""

    def run(batches):
        for pdf in batches:
            for label, mine in pdf.groupby("label"):
                total = M.outer_sum(np.stack([np.asarray(e, dtype=float) for e in mine["embedding"]]), atoms[label])
                yield pd.DataFrame({"label": label, "i": np.arange(total.size), "v": total.ravel()})

    sums = rows.mapInPandas(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas()  # labels x length^2 rows
    return {label: mine.sort_values("i")["v"].to_numpy().reshape(len(atoms[label]), -1) for label, mine in sums.groupby("label")}


@query
def window_matching(s, d):
    """The best of eight chains for each flag's series, cooled to rest: (channel, window, start, cost)."""
    best = SE.matched_windows(V.shipping_signal(s, d), 30, 10, V.SHIPDAYS)
    return best.select("channel", F.posexplode("starts").alias("window", "start"), "cost")


@_long(f""", s AS (SELECT channel, w, w * 50 AS s FROM (SELECT DISTINCT channel FROM e), range({(V.SHIPDAYS - 30) // 50 + 1}) q(w)),
    w AS (SELECT channel, w, t - s AS i, x FROM s JOIN e USING (channel) WHERE t - s BETWEEN 0 AND 29),
    m AS (SELECT channel, w, avg(x) AS m, stddev_pop(x) AS d FROM w GROUP BY channel, w),
    z AS (SELECT channel, i, sum((x - m) / (d + 1e-12)) AS z, sum(((x - m) / (d + 1e-12)) ** 2) AS q, count(*) AS n FROM w JOIN m USING (channel, w) GROUP BY channel, i)
SELECT CAST(channel AS INTEGER) AS channel, round((any_value(n) * sum(q) - sum(z * z)) / (30 * (any_value(n) - 1)), 6) AS cost FROM z GROUP BY channel""")
def window_cost(s, d):
    """The cost of windows of 30 days every 50 days, by the running sums after they were moved there one by one from elsewhere."""

    def run(batches):
        for pdf in batches:
            rows = []
            for channel, at in zip(pdf["channel"], pdf["at"], strict=True):
                x = np.zeros(V.SHIPDAYS)
                x[[p["t"] for p in at]] = [p["x"] for p in at]
                goal = np.arange(0, V.SHIPDAYS - 29, 50)
                windows = M.Windows(x, goal // 2, 30)
                for k, start in enumerate(goal.tolist()):
                    windows.move(k, start, windows.moved(k, start)[1])
                rows.append((channel, round(windows.cost, 6)))
            yield pd.DataFrame(rows, columns=["channel", "cost"])

    packed = V.shipping_signal(s, d).where(f"t BETWEEN 0 AND {V.SHIPDAYS - 1}").groupBy("channel").agg(F.collect_list(F.struct("t", "x")).alias("at"))
    return packed.mapInPandas(run, "channel int, cost double")


def _chain_sql(alpha: float, n_iter: int, n_burnin: int, seed: int) -> str:
    """The chain of each sample, a subquery for each step of the mixer and of the chain."""
    out, mask, names = [f"s0 AS (SELECT trial, t, x / 125 AS r, {seed}::BIGINT AS h0 FROM e)"], 0xFFFFFFFF, "trial, t, r"

    def stage(columns: str) -> None:
        out.append(f"s{len(out)} AS MATERIALIZED (SELECT {names}, {columns} FROM s{len(out) - 1})")

    def mix(of: dict[str, str]) -> None:
        """Columns by name, mixed."""
        stage(", ".join(f"({x}) & {mask} AS {c}" for c, x in of.items()))
        stage(", ".join(f"(xor({c}, {c} >> 16) * {ST.FIRST}) & {mask} AS {c}" for c in of))
        stage(", ".join(f"(xor({c}, {c} >> 15) * {ST.SECOND}) & {mask} AS {c}" for c in of))
        stage(", ".join(f"xor({c}, {c} >> 15) AS {c}" for c in of))

    mix({"h0": "h0"})
    for part in ("trial", "trial >> 32", "t"):
        mix({"h0": f"h0 + (({part}) & {mask})"})
    mix({f"d{i}_{stream}": f"h0 + {3 * i + stream}" for i in range(n_iter) for stream in (ST.ANGLE, ST.HEIGHT, ST.CHOICE)})
    number, half = lambda i, stream: f"((d{i}_{stream} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)", alpha / 2
    turn, up = (lambda i: f"(pi() * {number(i, ST.ANGLE)})"), (lambda i: f"(-ln({number(i, ST.HEIGHT)}))")
    new = [f"2 * sin({half} * {turn(i)}) / pow(sin({turn(i)}), {1 / half!r}) * pow(sin({1 - half!r} * {turn(i)}) / {up(i)}, {(1 - half) / half!r}) AS new{i}" for i in range(n_iter)]
    stage(", ".join([*new, *(f"ln({number(i, ST.CHOICE)}) AS choice{i}" for i in range(n_iter)), "2.0::DOUBLE AS phi", "0.0::DOUBLE AS total"]))
    for i in range(n_iter):
        later = [f"{c}{j}" for j in range(i + 1, n_iter) for c in ("new", "choice")]
        stage(", ".join([*later, "total", f"CASE WHEN choice{i} < 0.5 * ln(phi / new{i}) + 0.5 * r * r * (1 / phi - 1 / new{i}) THEN new{i} ELSE phi END AS phi"]))
        stage(", ".join([*later, "phi", f"total + {'1 / phi' if i >= n_burnin else '0'} AS total"]))
    return f", {', '.join(out)} SELECT trial, t, round(total / {n_iter - n_burnin}, 6) AS tau FROM s{len(out) - 1}"


@checked(_chain_sql(1.5, 4, 1, 7))
def robust_weights(s, d):
    """Expected precisions of the vectors' samples under alpha-stable noise, by short chains."""
    r = _unit_embeddings(s, d).select("trial", "t", F.col("x").alias("r"))
    return L.robust_weights(r, 1.5, 4, 1, 7).withColumn("tau", F.round("tau", 6))


# Simulated signals: the SQL draws the same hashes and sums the same shapes.


def _uniform(salt: str, *of: str) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('/', '{salt}', {', '.join(of)})), 1, 13) AS BIGINT) + 0.5) / {float(1 << 52)})"


def _gaussian(salt: str, *of: str) -> str:
    return f"sqrt(-2 * ln({_uniform(salt + 'a', *of)})) * cos(2 * pi() * {_uniform(salt + 'b', *of)})"


def _values(*columns: str, rows: np.ndarray) -> str:
    """(index..., value) of an array as a table."""
    listed = ", ".join(f"({', '.join(map(str, at))}, {float(v)!r})" for at, v in np.ndenumerate(rows))
    return f"(SELECT * FROM (VALUES {listed}) v({', '.join(columns)}))"


#: As many trials as the events have users.
_USERS = "(SELECT unnest(range((SELECT count(DISTINCT user_id) FROM events))) AS trial)"


def _users(s: SparkSession, d: str) -> int:
    return V.table(s, d, "events").agg(F.countDistinct("user_id")).first()[0]


def simulated(sql: str):
    def keep(f):
        SQL[f.__name__] = sql
        return query(f)

    return keep


def _rounded(x: DataFrame) -> DataFrame:
    return x.select("trial", "channel", "t", F.round("x", 9).alias("x"))


@simulated(f"""WITH d AS {_values("k", "l", "d", rows=SIM.simulated_atoms(2, 16))},
z AS (SELECT trial, k, CAST(floor({_uniform("42t", "trial", "k")} * 113) AS INTEGER) AS t, {_uniform("42z", "trial", "k")} AS z FROM {_USERS}, range(2) q(k))
SELECT trial, 0 AS channel, CAST(t + l AS INTEGER) AS t, round(sum(z * d), 9) AS x FROM z JOIN d USING (k) GROUP BY trial, t + l""")
def simulate_csc(s, d):
    return _rounded(SIM.simulate_data(s, _users(s, d), 128, 16, 2)[0])


@simulated(f"""WITH u AS {_values("channel", "u", rows=SIM.channel_map(3, 0))},
w AS (SELECT trial, CAST(t AS INTEGER) AS t, t / 60.0 AS s, 2 * pi() * 10 * (t / 60.0) + 2 * pi() * {_uniform("0p", "trial")} AS turn, 0.05 * 239 / 2.0 AS edge FROM {_USERS}, range(240) q(t))
SELECT trial, channel, t, round((u * CASE WHEN s >= 2 AND s < 3 THEN sin(turn + 0.8 * cos(turn)) ELSE 0 END + 0.01 * {_gaussian("0", "trial", "channel", "t")})
  * CASE WHEN t < edge THEN 0.5 * (1 + cos(pi() * (t / edge - 1))) WHEN t > 239 - edge THEN 0.5 * (1 + cos(pi() * ((239 - t) / edge - 1))) ELSE 1 END, 9) AS x FROM w, u""")
def simulate_mu_wave(s, d):
    return _rounded(SIM.simulate_mu_wave(s, _users(s, d), 3, 4, sfreq=60.0))


@simulated(f"""WITH u AS {_values("k", "channel", "u", rows=SIM.rank1_maps(3, 16)[0])}, v AS {_values("k", "l", "v", rows=SIM.rank1_maps(3, 16)[1])},
z AS (SELECT trial, k, t, {_uniform("0z", "trial", "k", "t")} AS z FROM {_USERS}, range(2) q(k), range(100) p(t) WHERE {_uniform("0hit", "trial", "k", "t")} < 0.05),
n AS (SELECT trial, channel, t, 0.1 * {_gaussian("0", "trial", "channel", "t")} AS x FROM {_USERS}, range(3) q(channel), range(115) p(t))
SELECT trial, CAST(channel AS INTEGER) AS channel, CAST(t AS INTEGER) AS t, round(sum(x), 9) AS x
FROM (SELECT trial, channel, t + l AS t, z * u * v AS x FROM z JOIN u USING (k) JOIN v USING (k) UNION ALL SELECT trial, channel, t, x FROM n) GROUP BY ALL""")
def simulate_rank1(s, d):
    return _rounded(SIM.rank1_signals(s, _users(s, d), 3, 100, 16)[0])
