"""Toxicity scores from a factorization machine over hashed terms.

Terms are the lower-cased words of a text and the first bytes of longer words, each a 64-bit hash, present or absent. The machine
adds to the linear weights one factor vector for each term, whose inner products are learned pairwise interactions.
It is fitted on the driver from at most ``max_rows`` labelled rows (a documented bound: those with the smallest hashes of their ids, so
every run learns from the same rows); the model that goes to the tasks has a fixed size, at most ``max_terms`` terms of each of two
kinds: terms that tell about the label alone, and terms that are frequent enough for pairs of them to be seen together, which may tell
about it only in pairs and are held by a stronger penalty. Scoring is a narrow step over whole texts.

A null or empty text has the score of no terms at all. Labels other than 0 and 1 and null labels or ids are not learned from; of
repeated labels of one id the largest holds; rows that repeat an id are each scored, and one of them is learned from. When all usable
labels are alike every score is that label, and 0 without any. Terms of equal statistics are taken in the order of their hashes. A very
long text is one slice of a task. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import column, map_batches, slack

MAX_ROWS = 30_000
MAX_TERMS = 1 << 13
#: A term must occur in so many of the rows that are learned from.
LEAST_ROWS = 4
#: A term tells about the label alone if its likelihood ratio statistic against it reaches this.
LEAST_RATIO = 15.0
#: Of others, those stay of which two that do not depend on each other would be expected together in so many of the rows.
LEAST_PAIRS = 20
PREFIX_BYTES = (4, 5, 6)
FACTORS = 4
#: Penalties of terms that tell alone, and of those that do not.
TELLING_L2, FLAT_L2 = 5e-4, 2e-3
#: Rows of a step, and the fewest steps of a fit.
BATCH, LEAST_STEPS = 512, 600
THRESHOLD = 0.3


def terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term hash) for slices of a text column; terms repeat."""
    hasher = W.Hasher(17)
    for i, n_rows, part, cuts in W.parts(texts, lower=True):
        s, e, bounds = W.words(part, cuts, W.ALNUM[part])
        rows = np.repeat(np.arange(n_rows), np.diff(bounds))
        found, where = [hasher.spans(part, s, e)], [rows]
        for n in PREFIX_BYTES:
            long = np.flatnonzero(e - s > n)
            found.append(W.mix(hasher.spans(part, s[long], s[long] + n) + W.U64(n)))
            where.append(rows[long])
        yield i, n_rows, np.concatenate(where), np.concatenate(found)


@dataclass
class Model:
    """Sorted term hashes with their weights (terms,) and factors (terms, FACTORS)."""

    keys: np.ndarray
    w: np.ndarray
    v: np.ndarray
    w0: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        seen = np.zeros(1 << 20, dtype=bool)
        seen[(self.keys & W.U64((1 << 20) - 1)).astype(np.int64)] = True
        for first, n, rows, found in terms(texts):
            if not len(self.keys):
                out[first : first + n] = _squash(np.full(n, self.w0))
                continue
            near = seen[(found & W.U64((1 << 20) - 1)).astype(np.int64)]
            rows, found = rows[near], found[near]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            pair = np.unique(rows[hit] * len(self.keys) + at[hit])
            rows, at = np.divmod(pair, len(self.keys))
            out[first : first + n] = _squash(_raw(self, np.searchsorted(rows, np.arange(n + 1)), at))
        return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i] : ptr[i + 1]]."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return total[ptr[1:]] - total[ptr[:-1]]


def _raw(m: Model, ptr: np.ndarray, at: np.ndarray) -> np.ndarray:
    v = m.v[at]
    s = _sums(v, ptr)
    return m.w0 + _sums(m.w[at], ptr) + 0.5 * (s * s - _sums(v * v, ptr)).sum(axis=1)


def fit(keys: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 20, rate: float = 0.02, l2: float | np.ndarray = 5e-4, seed: int = 7) -> Model:
    """Adam on the log loss; keys are the model's term hashes in ascending order, docs hold the places among them of each row's terms.

    l2 is the penalty of all terms or of each.
    """
    l2 = np.broadcast_to(np.asarray(l2, dtype=float), (len(keys),))
    rng = np.random.default_rng(seed)
    k, rows = len(keys), docs
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    m = Model(keys, np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)), float(np.log(share / (1 - share))))
    if not k:
        return m
    first, second = [np.zeros(k), np.zeros((k, FACTORS))], [np.zeros(k), np.zeros((k, FACTORS))]
    step = 0
    for _ in range(max(epochs, LEAST_STEPS // -(-len(rows) // BATCH))):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), BATCH):
            some = order[b : b + BATCH]
            at = np.concatenate([rows[i] for i in some])
            ptr = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
            s = _sums(m.v[at], ptr)
            raw = m.w0 + _sums(m.w[at], ptr) + 0.5 * (s * s - _sums(m.v[at] ** 2, ptr)).sum(axis=1)
            err = (_squash(raw) - labels[some]) / len(some)
            step += 1
            m.w0 -= rate * float(err.sum())
            by = np.repeat(np.arange(len(some)), np.diff(ptr))
            e = err[by]
            own = np.bincount(at, weights=e, minlength=k)
            gw = own + l2 * m.w
            gv = np.stack([np.bincount(at, weights=e * s[by, f], minlength=k) for f in range(FACTORS)], axis=1) - own[:, None] * m.v + 4 * l2[:, None] * m.v
            for x, g, a, q in ((m.w, gw, first[0], second[0]), (m.v, gv, first[1], second[1])):
                a += 0.1 * (g - a)
                q += 0.001 * (g * g - q)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return m


def _distinct(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs in order, once each."""
    order = np.lexsort((found, rows))
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def chosen_terms(rows: DataFrame, n: int, toxic: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, whether each tells about the label alone) of the model's terms for rows (_text, _y).

    A slice of texts sends a row for each of its terms; the sums, the statistic and the choice are made on the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for first, _, at, found in terms(batch.column(0)):
                at, found = _distinct(at, found)
                keys, back, seen = np.unique(found, return_inverse=True, return_counts=True)
                toxic_rows = np.bincount(back, weights=y[first + at], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"term": keys.view(np.int64), "n": seen, "t": toxic_rows})

    def part(seen: str, row: str, column: str) -> str:
        return f"coalesce(CASE WHEN ({seen}) > 0 THEN ({seen}) * ln(({seen}) * {float(n)} / (({row}) * {column})) END, 0)"

    a, b = float(toxic), float(n - toxic)
    cells = [("t", "n", a), ("n - t", "n", b), (f"{a} - t", f"{n} - n", a), (f"{b} - (n - t)", f"{n} - n", b)]
    ratio = "2 * (" + " + ".join(part(seen, row, str(column)) for seen, row, column in cells) + ")"
    sums = rows.mapInArrow(count, "term long, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    known = sums.where(f"n >= {LEAST_ROWS} AND n < {n}").withColumn("ratio", F.expr(ratio))
    telling = known.where(f"ratio >= {LEAST_RATIO}").orderBy(F.desc("ratio"), "term").limit(most).select("term", F.lit(True).alias("telling"))
    pairs = known.where(f"ratio < {LEAST_RATIO} AND n * n >= {LEAST_PAIRS} * {n}")
    flat = pairs.orderBy(F.desc("n"), "term").limit(most).select("term", F.lit(False).alias("telling"))
    found = telling.union(flat).collect()  # 2 * most rows
    keys = np.array([r.term for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r.telling for r in found], dtype=bool)[order]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Fits on at most max_rows labelled rows of docs; those whose crc32(id) mod 4 is 2 are never learned from."""
    slack(docs, [id_col, text_col], "toxicity")
    slack(labels, [id_col, label_col], "toxicity labels")
    known = labels.select(column(id_col).alias("_id"), column(label_col).cast("int").alias("_y"))
    known = known.where(f"_id IS NOT NULL AND _y IN (0, 1) AND {learned_from('_id')}").groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    if n > max_rows:
        place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
        # Somewhat more than are wanted, so that few rows are sorted; of those the first.
        known = known.where(place < int((1 << 30) * min(1.0, 1.1 * max_rows / n))).orderBy(place, "_id").limit(max_rows)
    text = F.coalesce(column(text_col), F.lit("")).alias("_text")
    rows = docs.select(column(id_col).alias("_id"), text).join(F.broadcast(known), "_id")  # max_rows rows of 12 bytes
    counted = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("_y"), F.lit(0)).alias("t")).first()
    if not 0 < counted.t < counted.n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), 30.0 if counted.t else -30.0)
    keys, telling = chosen_terms(rows.select("_text", "_y"), counted.n, counted.t, max_terms)

    place = "<u2" if len(keys) <= 1 << 16 else "<u4"

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size, at, found in terms(batch.column(0)):
                near = np.minimum(np.searchsorted(keys, found), max(len(keys) - 1, 0))
                hit = keys[near] == found if len(keys) else np.zeros(len(found), dtype=bool)
                at, mine = _distinct(at[hit], near[hit])
                ptr = np.searchsorted(at, np.arange(size + 1))
                mine = mine.astype(place)
                packed = pa.array([mine[ptr[i] : ptr[i + 1]].tobytes() for i in range(size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, size) for c in (1, 2)), packed], names=["_id", "_y", "terms"])

    source = rows.select("_text", "_id", "_y")
    held = source.mapInArrow(hold, source.select("_id", "_y").withColumn("terms", F.lit(b"")).schema)
    got = held.groupBy("_id").agg(F.max("_y").alias("y"), F.max("terms").alias("terms")).toPandas().sort_values("_id")  # max_rows rows, model terms only
    learned = [np.frombuffer(t, dtype=place) for t in got["terms"]]
    return fit(keys, learned, got["y"].to_numpy(dtype=float), l2=np.where(telling, TELLING_L2, FLAT_L2))


def learned_from(id_col: str) -> str:
    """SQL: rows that models may learn from."""
    return f"crc32(cast(cast({id_col} AS string) AS binary)) % 4 <> 2"


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of each row, in place of a column of that name; a narrow step."""
    slack(docs, [text_col], "score_documents")
    docs = docs.drop(name) if name != text_col else docs
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(at)))], names=[*batch.schema.names, "score"])

    return map_batches(docs, run, docs.withColumn(name, F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score, predicted of every row."""
    model = train(docs, labels, id_col, text_col)
    scored = score_documents(docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")), model, "_text")
    held_out = F.coalesce(F.expr(f"NOT ({learned_from('_id')})"), F.lit(False))
    return scored.select(column("_id").alias(id_col), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
