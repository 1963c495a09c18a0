"""Scores of whole texts by a log-bilinear neural language model, and by smoothed counts of words.

Tokens are the words of a text (runs without ASCII white space, A-Z lower-cased) and one end. Counts cover every token of all rows that are
learned from, those with crc32(id) mod 10 not 0; words are 64-bit hashes. ``base_score`` adds up log10((c + 0.1) / (N + 0.1 (V + 1))).
``score`` is the log10 probability of the text under the model: the network (``_bilinear``) gives normalised probabilities of the
``vocabulary`` most frequent tokens and of all others together, and the others share theirs by (c + 0.1) / (N' + 0.1 (V' + 1)), where N' and V'
count them alone and all words that were never learned are one. So the probabilities of all tokens add up to one after any context.

1. One pass counts words; sums by word are a table that grows with the corpus.
2. The ``frequent`` most frequent words at most, a fixed bound, go to the tasks with their counts; those of whole ranges of counts are
   taken, so none is chosen before an equal one by chance. The first ``vocabulary`` of them are the network's.
3. One pass turns texts into token numbers, a table without texts; hashes of rarer words are kept as they are.
4. Every task trains the network on all its own rows that are learned from, from common first parameters; the tasks' parameters are averaged
   in a tree of groups of FAN, each row of them weighted by how often it was learned from.
5. One narrow pass scores; rarer words meet the table of counts in a join, where no word is hot, because hot words are in the tasks.

A null text is empty: one end. A null id is neither learned from nor held out; repeated rows are learned from as often as they occur and
get one result each. A very long text is cut as one slice and scored in batches of tokens. Extra columns are ignored; an empty table gives an empty
result; where nothing is learned from N is 0 and every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bilinear as B
from . import _words as W
from ._shared import column, discard, slack, written

VOCABULARY, FREQUENT = 1 << 13, 1 << 18
#: The hash that stands for the end of a text.
END = np.uint64(0x9E3779B97F4A7C15)
SMOOTHING = 0.1
#: Ranges of counts of which those above one are frequent: so many for each doubling.
RANGES = 16
#: Parameter tables averaged in one group, and rows of the parameters in a block.
FAN, BLOCK = 8, 512
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, token hashes, first token of each row) for slices of a text column."""
    hasher = W.Hasher(61)
    for _, n, data, cuts in W.parts(texts, most=SLICE_BYTES):
        data = _LOWER[data]
        s, e, bounds = W.words(data, cuts, ~W.SPACE[data])
        out = np.full(len(s) + n, END, dtype=W.U64)
        word = np.ones(len(out), dtype=bool)
        word[bounds[1:] + np.arange(n)] = False
        out[word] = hasher.spans(data, s, e)
        yield n, out, bounds[:-1] + np.arange(n)


def held_out(id_col: str) -> str:
    """SQL: rows that models must not learn from; null for a null id."""
    return f"crc32(cast(cast({id_col} AS string) AS binary)) % 10 = 0"


def counted(rows: DataFrame) -> DataFrame:
    """(key, n) of all tokens of (held_out, text) that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, found, _ in tokens(batch.column(0)):
                keys, n = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return rows.where("NOT held_out").select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The frequent words: hashes in the order of their numbers, counts, and sums over all words and over those outside the vocabulary."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    vocabulary: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]
        inside = self.counts[: self.vocabulary]
        self.other_tokens, self.other_types = self.tokens - int(inside.sum()), self.types - int((inside > 0).sum())

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """Number of each hash; that of all words here for one that is not among them."""
        distinct, back = np.unique(found, return_inverse=True)
        at = np.minimum(np.searchsorted(self.sorted, distinct), len(self.sorted) - 1)
        return np.where(self.sorted[at] == distinct, self.order[at], len(self.keys)).astype(np.uint32)[back]

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + SMOOTHING) / (self.tokens + SMOOTHING * (self.types + 1)))

    def share(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the share of a word outside the vocabulary in the probability of all of them."""
        return np.log10((counts + SMOOTHING) / (self.other_tokens + SMOOTHING * (self.other_types + 1)))

    def shape(self) -> B.Shape:
        return B.Shape(self.counts[: self.vocabulary], float(self.other_tokens))


def frequent_words(counts: DataFrame, vocabulary: int, frequent: int) -> tuple[Words, int]:
    """The words of the highest ranges of counts, and the lowest of these ranges; the end is always among them, as the first."""
    ranged = counts.withColumn("range", F.floor(F.log2("n") * RANGES).cast("int"))
    sums = ranged.groupBy("range").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # RANGES rows a doubling of counts
    sums.sort(key=lambda r: -r.range)
    room, least = frequent, sums[0].range + 1 if sums else 0
    for r in sums:
        if r.words > room:
            break
        room, least = room - r.words, r.range
    end = int(np.array(END).view(np.int64))
    known = ranged.where((F.col("range") >= least) | (F.col("key") == end)).select("key", "n").toPandas()  # frequent words at most
    rest = known[known["key"] != end].sort_values(["n", "key"], ascending=[False, True])
    keys = np.concatenate([[END], rest["key"].to_numpy(dtype=np.int64).view(np.uint64)])
    n = np.concatenate([[int(known["n"][known["key"] == end].sum())], rest["n"].to_numpy(dtype=np.int64)])
    words = Words(keys, n, sum(r.n for r in sums), sum(r.words for r in sums), min(vocabulary, len(keys)))
    return words, least


def numbered(rows: DataFrame, words: Words) -> DataFrame:
    """(row, held_out, numbers, rare) of (row, held_out, text): token numbers as bytes, and the hashes of words that have none."""
    sent = rows.sparkSession.sparkContext.broadcast(words)  # FREQUENT words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for n, found, starts in tokens(batch.column(2)):
                numbers = sent.value.numbers(found)
                bounds = np.append(starts, len(found))
                rare = numbers == len(sent.value.keys)
                upto = np.concatenate([[0], np.cumsum(rare)])[bounds].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(found[rare].view(np.int64)))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * bounds).astype(np.int32).tobytes()), pa.py_buffer(numbers.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), packed, lists], names=["row", "held_out", "numbers", "rare"])
                first += n

    return rows.mapInArrow(run, rows.select("row", "held_out").withColumns({"numbers": F.lit(b""), "rare": F.array().cast("array<long>")}).schema)


def _numbers(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers, first token of each row)."""
    bounds = np.frombuffer(packed.buffers()[1], "<i4")[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
    return np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view("<u4"), (bounds[:-1] - bounds[0]) // 4


def trained(table: DataFrame, words: Words) -> np.ndarray:
    """The network's parameters after every task has learned from its rows of the numbered table."""
    shape = words.shape()
    begin = shape.start()
    sent = table.sparkSession.sparkContext.broadcast((shape, begin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, begin = sent.value
        task = TaskContext.get().partitionId()
        trainer = B.Trainer(begin, shape, task)
        for batch in batches:
            numbers, starts = _numbers(batch.column(0))
            trainer.learn(np.minimum(numbers, shape.words).astype(np.int64), starts)
        for i in range(0, shape.rows, BLOCK):
            t, seen = trainer.t[i : i + BLOCK], trainer.seen[i : i + BLOCK]
            yield pa.RecordBatch.from_pydict({"task": [task], "block": [i // BLOCK], "seen": [seen.tobytes()], "t": [t.tobytes()]})

    def average(group: pa.Table) -> pa.Table:
        seen = np.stack([np.frombuffer(x.as_py(), np.float32) for x in group["seen"]])
        t = np.stack([np.frombuffer(x.as_py(), np.float32).reshape(seen.shape[1], -1) for x in group["t"]])
        weight = np.where(seen.sum(axis=0) > 0, seen, 1).astype(np.float64)
        mean = (weight[:, :, None] * t).sum(axis=0) / weight.sum(axis=0)[:, None]
        return pa.table({"task": group["task"][:1], "block": group["block"][:1], "seen": [seen.sum(axis=0).tobytes()], "t": [mean.astype(np.float32).tobytes()]})

    kind = "task long, block long, seen binary, t binary"
    parts = written(table.where("NOT held_out").select("numbers").mapInArrow(run, kind), "parameters")
    tasks = (parts.agg(F.max("task")).first()[0] or 0) + 1
    merged = parts
    while tasks > 1:
        merged = merged.withColumn("task", F.expr(f"task div {FAN}")).groupBy("task", "block").applyInArrow(average, kind)
        tasks = -(-tasks // FAN)
    blocks = {r.block: np.frombuffer(r.t, np.float32).reshape(-1, B.DIM + 1) for r in merged.collect()}  # the parameters once
    discard(parts)
    return np.concatenate([blocks[i] for i in range(len(blocks))]) if blocks else begin


def _scored(table: DataFrame, words: Words, t: np.ndarray) -> DataFrame:
    """The numbered rows with n_tokens, known, base and score, without their rare words' own shares."""
    sent = table.sparkSession.sparkContext.broadcast((words, words.shape(), t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shape, t = sent.value
        base, share = np.append(words.base(words.counts), 0.0), np.append(words.share(words.counts), 0.0)
        share[: shape.words] = 0
        counted = np.append(words.counts > 0, False)
        for batch in batches:
            numbers, starts = _numbers(batch.column(3))
            got = B.log_probabilities(t, shape, np.minimum(numbers, shape.words).astype(np.int64), starts) / np.log(10) + share[numbers]
            sums = [np.add.reduceat(x, starts) for x in (counted[numbers].astype(np.int64), base[numbers], got)]
            n = np.diff(np.append(starts, len(numbers)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n), *map(pa.array, sums)], names=schema.names)

    rows = table.select("row", "id", "out", "numbers")
    schema = rows.drop("numbers").withColumns({"n_tokens": F.lit(0).cast("long"), "known": F.lit(0).cast("long"), "base": F.lit(0.0), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    slack(docs, [id_col, text_col], "language_model")
    text = F.coalesce(column(text_col), F.lit("")).alias("text")
    out = F.expr(held_out(f"`{id_col.replace('`', '``')}`"))
    counts = written(counted(docs.select(F.coalesce(out, F.lit(True)).alias("held_out"), text)), "counts")
    words, least = frequent_words(counts, vocabulary, frequent)

    # The row's number is written, so it holds whatever is computed anew; a null id takes no part in learning.
    rows = docs.select(column(id_col).alias("id"), F.coalesce(out, F.lit(False)).alias("out"), F.coalesce(out, F.lit(True)).alias("held_out"), text)
    whole = rows.withColumn("row", F.struct(F.monotonically_increasing_id().alias("n"), "id", "out")).select("row", "held_out", "text")
    table = written(numbered(whole, words), "tokens").select("row.*", "held_out", "numbers", "rare").withColumnRenamed("n", "row")
    t = trained(table, words)
    scored = _scored(table, words, t)

    rarer = counts.where(F.floor(F.log2("n") * RANGES).cast("int") < least)
    each = table.select("row", F.explode("rare").alias("key")).join(rarer, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    logs = {name: F.log10((F.col("n") + F.lit(SMOOTHING)) / F.lit(tokens + SMOOTHING * (types + 1))) for name, tokens, types in
            (("own_base", words.tokens, words.types), ("own_share", words.other_tokens, words.other_types))}
    own = each.groupBy("row").agg(F.sum((F.col("n") > 0).cast("long")).alias("own_known"), *(F.sum(x).alias(name) for name, x in logs.items()))
    return scored.join(own, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("out").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("own_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("own_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("own_share", F.lit(0.0))).alias("score"),
    )
