"""Language identification: script ranges narrow the candidates of each word, Viterbi labels spans of mixed text.

A word's score in a language is the sum of smoothed log probabilities of the byte trigrams of its lower-cased text with the spaces
around it. A language is a candidate for a word only if it uses the script of the word's first letter in training. Viterbi over
the words of a text, with a fixed penalty for each switch, gives spans; a text's language is that of most letter bytes in them
and its score is the share of those bytes. The recursion runs over many texts at once, a word of each in every step.

Learned from about ``max_rows`` rows a language at most (a documented bound, taken by a hash of the id, so every run learns from the
same rows). A null text or one without a letter is ``und`` with score 0, and so is every text when nothing was learned; null ids are
labelled but not learned from. Of languages that tie the first by name is taken; repeated rows get the same label each. A very long text is
one slice of a task, with a score for each of its words and languages, and its words are labelled by segments, with the same result. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._shared import column as named
from ._shared import slack
from .toxicity import learned_from

MAX_ROWS = 4_000
BUCKETS = 1 << 16
PENALTY = 10.0
#: A language uses a script if so large a share of its words in training begin in it.
LEAST_SHARE = 0.002
#: A training text tells no more than so many bytes of its language would at most: it is read whole, its counts are scaled.
TEXT_WEIGHT = 4_000
SLICE_BYTES = 1 << 22
#: Words of a segment of a very long text.
SEGMENT = 1024

#: Fixed values: (first code point, script) of ranges in ascending order; a script reaches to the next entry.
SCRIPTS = [(0x0, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "Other"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other")]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([c for c, _ in SCRIPTS])
_NAME = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def first_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of the character at each start."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    b = [padded[starts + i].astype(np.int64) for i in range(4)]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | b[1] & 0x3F, (b[0] & 0xF) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F],
        (b[0] & 7) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F,
    )
    return _NAME[np.searchsorted(_FROM, point, side="right") - 1]


#: Letters and the bytes of longer sequences; digits end words here.
LETTERS = W.ALNUM.copy()
LETTERS[0x30:0x3A] = False


def trigrams(data: np.ndarray, inside: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes around each byte; outside words, and at the ends of rows, a space stands instead."""
    x = np.where(inside, data, 0x20).astype(np.uint32)
    before, after = np.empty_like(x), np.empty_like(x)
    before[1:], before[:1] = x[:-1], 0x20
    after[:-1], after[-1:] = x[1:], 0x20
    starts = first[:-1]
    before[starts[starts < len(x)]] = 0x20
    ends = first[1:] - 1
    after[ends[ends >= 0]] = 0x20
    h = (before << 16 | x << 8 | after) * np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - 16)


def sliced(column: pa.Array) -> Iterator[tuple]:
    """(first row, rows, bytes, row offsets, inside, word starts, word ends, word bounds) of slices."""
    for i, n, part, cuts in W.parts(column, lower=True, most=SLICE_BYTES):
        inside = LETTERS[part]
        yield i, n, part, cuts, inside, *W.words(part, cuts, inside)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BUCKETS, langs), float32
    scripts: np.ndarray  # (scripts, langs), bool

    def word_scores(self, part: np.ndarray, cuts: np.ndarray, inside: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """(words, langs); what is no candidate scores far below."""
        if not len(s):
            return np.zeros((0, len(self.langs)), np.float32)
        at = np.flatnonzero(inside)
        by_byte = self.logp[trigrams(part, inside, cuts)[at]]
        out = np.add.reduceat(by_byte, np.searchsorted(at, s), axis=0)
        allowed = self.scripts[first_scripts(part, s)]
        return np.where(allowed | ~allowed.any(axis=1)[:, None], out, np.float32(-1e6))

    def spans(self, column: pa.Array) -> Iterator[tuple]:
        """(first row, rows, word starts, word ends, word bounds, language number of each word) of slices."""
        for i, n, part, cuts, inside, s, e, bounds in sliced(column):
            yield i, n, s, e, bounds, viterbi(self.word_scores(part, cuts, inside, s, e), bounds, PENALTY)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: no word) and score of each row."""
        lang, score = np.full(len(column), -1), np.zeros(len(column))
        for i, n, s, e, bounds, label in self.spans(column):
            rows = np.repeat(np.arange(n), np.diff(bounds))
            size = np.bincount(rows * len(self.langs) + label, weights=e - s, minlength=n * len(self.langs)).reshape(n, -1)
            total = size.sum(axis=1)
            some = total > 0
            lang[i : i + n][some] = size.argmax(axis=1)[some]
            score[i : i + n][some] = (size.max(axis=1) / np.maximum(total, 1))[some]
        return lang, score


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float, segment: int = SEGMENT) -> np.ndarray:
    """The best state of each item; rows are bounds[i] : bounds[i + 1], a switch costs ``penalty``.

    The rows advance together, an item of each in every step; a row of more than 32 segments, which would advance
    alone for long, is cut into segments that do so.
    """
    n, states = scores.shape
    label = np.zeros(n, dtype=np.int64)
    lengths = np.diff(bounds)
    for r in np.flatnonzero(lengths > 32 * segment).tolist():
        label[bounds[r] : bounds[r + 1]] = _segmented(scores[bounds[r] : bounds[r + 1]], penalty, segment)
    lengths = np.where(lengths > 32 * segment, 0, lengths)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = bounds[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # rows with more than t items
    switched = np.zeros((n, states), dtype=bool)
    source = np.zeros(n, dtype=np.min_scalar_type(states))
    best = np.zeros((len(order), states), dtype=np.float64)
    for t in range(longest):
        a = active[t]
        at = begin[:a] + t
        v = best[:a]
        if t:
            top = v.argmax(axis=1)
            other = v[np.arange(a), top][:, None] - penalty
            switched[at] = v < other
            source[at] = top
            v = np.maximum(v, other)
        best[:a] = v + scores[at]
    state = best.argmax(axis=1) if len(order) else np.zeros(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        now = state[:a]
        label[at] = now
        if t:
            state[:a] = np.where(switched[at, now], source[at], now)
    return label


def _segmented(scores: np.ndarray, penalty: float, segment: int) -> np.ndarray:
    """viterbi of one row: segments advance together from every state, are linked one after the other, and traced back from every state."""
    n, states = scores.shape
    k = -(-n // segment)
    padded = np.zeros((k * segment, states))  # what is behind the end prefers no state
    padded[:n] = scores
    items = padded.reshape(k, segment, states)
    reach = np.full((k, states, states), -np.inf)  # best score of a segment by the state before it and its last
    reach[:, np.arange(states), np.arange(states)] = 0
    for t in range(segment):
        reach = np.maximum(reach, reach.max(axis=2, keepdims=True) - penalty) + items[:, t, None, :]
    best = np.zeros((k, states))
    for j in range(1, k):
        best[j] = (best[j - 1][:, None] + reach[j - 1]).max(axis=0)
    switched = np.zeros((segment, k, states), dtype=bool)
    source = np.zeros((segment, k), dtype=np.min_scalar_type(states))
    for t in range(segment):
        top = best.argmax(axis=1)
        other = best[np.arange(k), top][:, None] - penalty
        switched[t], source[t] = best < other, top
        best = np.maximum(best, other) + items[:, t]
    label = np.zeros((segment, k, states), dtype=np.min_scalar_type(states))
    state = np.tile(np.arange(states), (k, 1))
    for t in range(segment - 1, -1, -1):
        label[t] = state
        state = np.where(np.take_along_axis(switched[t], state, axis=1), source[t][:, None], state)
    last = np.zeros(k, dtype=np.int64)
    last[-1] = best[-1].argmax()
    for j in range(k - 1, 0, -1):
        last[j - 1] = state[j, last[j]]
    return label[:, np.arange(k), last].T.reshape(-1)[:n].astype(np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Counts trigrams and scripts on the executors, in at most about max_rows rows of each language."""
    slack(docs, [id_col, text_col, lang_col], "language_id")
    known = docs.select(named(id_col).alias("_id"), named(text_col).alias("_text"), named(lang_col).alias("_lang"))
    known = known.where(f"_lang IS NOT NULL AND _text IS NOT NULL AND _id IS NOT NULL AND {learned_from('_id')}")
    share = known.groupBy("_lang").agg(F.count("*").alias("_n"))  # one row for each language
    share = share.select("_lang", F.least(F.lit(1 << 30), F.lit((1 << 30) * max_rows) / F.col("_n")).cast("long").alias("_most"))
    rows = known.join(F.broadcast(share), "_lang").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.col("_most")).select("_lang", "_text")
    scripts = len(SCRIPT_NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, n, part, cuts, inside, s, _, bounds in sliced(batch.column(1)):
                weight = np.minimum(1.0, TEXT_WEIGHT / np.maximum(np.diff(cuts), 1))
                gram = trigrams(part, inside, cuts)
                script = first_scripts(part, s)
                for r in range(n):
                    one = seen.setdefault(names[i + r], np.zeros(BUCKETS + scripts))
                    b = slice(cuts[r], cuts[r + 1])
                    np.add.at(one, gram[b][inside[b]], weight[r])
                    np.add.at(one, BUCKETS + script[bounds[r] : bounds[r + 1]], weight[r])
        for name, one in seen.items():
            at = np.flatnonzero(one)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "at": pa.array(at, pa.int32()), "n": one[at]})

    # BUCKETS + scripts rows for each language at most
    counts = rows.mapInArrow(count, "lang string, at int, n double").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + scripts, len(langs)))
    table[counts["at"], [langs.index(x) for x in counts["lang"]]] = counts["n"]
    grams, used = table[:BUCKETS], table[BUCKETS:]
    logp = np.log((grams + 0.05) / (grams.sum(axis=0) + 0.05 * BUCKETS)).astype(np.float32)
    return Model(langs, logp, used >= LEAST_SHARE * np.maximum(used.sum(axis=0), 1e-9))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row; a narrow step."""
    slack(docs, [id_col, text_col], "identify")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, "und"], dtype=object)
        for batch in batches:
            lang, score = m.predict(batch.column(2)) if m.langs else (np.full(batch.num_rows, -1), np.zeros(batch.num_rows))
            lang = np.where(np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool), lang, -1)
            score = np.where(lang < 0, 0.0, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[lang], pa.string()), pa.array(score)], names=[id_col, "held_out", "lang_pred", "score"])

    letter = F.coalesce(named(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(named(id_col).alias("_id"), F.coalesce(named(text_col), F.lit("")).alias("_text"), letter.alias("_letter"))
    held = F.coalesce(F.expr(f"NOT ({learned_from('_id')})"), F.lit(False))
    rows = rows.select(named("_id").alias(id_col), held.alias("held_out"), "_text", "_letter")
    schema = rows.select(named(id_col), "held_out").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of each text: id, first word, number of words, lang."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for i, n, s, _, bounds, label in m.spans(batch.column(1)) if m.langs else ():
                if not len(s):
                    continue
                rows = np.repeat(np.arange(n), np.diff(bounds))
                new = np.ones(len(s), dtype=bool)
                new[1:] = (label[1:] != label[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at] + i)), pa.array(at - bounds[rows[at]]), pa.array(np.diff(np.append(at, len(s)))), pa.array(np.array(m.langs, dtype=object)[label[at]], pa.string())], names=[id_col, "first_word", "n_words", "lang"])

    rows = docs.select(named(id_col).alias(id_col), F.coalesce(named(text_col), F.lit("")).alias("_text"))
    schema = rows.select(named(id_col)).withColumns({"first_word": F.lit(0).cast("long"), "n_words": F.lit(0).cast("long"), "lang": F.lit("")}).schema
    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from docs and labels all of them."""
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
