"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Two texts are linked when the weighted Jaccard similarity of their five-word shingles is 0.8 or more, a shingle's weight being the number
of times it occurs; classes are the connected components of the links. Words are runs of letters and digits, lower-cased; a text of
fewer words is one shingle. Shingles are 64-bit hashes in signatures and 32 bits of them in comparisons.

1. Texts of the same word sequence are one text from here on, whatever their number; each keeps one representative.
2. Weighted signatures of BANDS x WIDTH coordinates are cut into bands; at similarity 0.8 two texts share no band with probability
   (1 - 0.8**4)**24 = 3e-6.
3. In each band a bucket's texts are compared with two of its members, the smallest id and the smallest hash for that band: as many
   pairs as members.
4. Where a bucket's members still fall into several classes, every two of them that are of different classes are compared, whatever
   the bucket's size: as rows in buckets of at most SMALL texts, by matrix products of blocks of BLOCK texts in larger ones, where each
   pair is taken in the first band it shares and the members of the largest class are not held against each other. No pair of
   texts that shares a band and could join two classes is left out.

What is returned are classes and links that connect them, not all pairs of a class: those grow with its square.

Null ids are classes of their own (class_id null). Null and empty texts and texts without a word are linked to nothing. A repeated row
is in the class of its text. A very long text is one slice of a task and one list of shingles. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _darts as D
from . import _words as W
from ._shared import column, dealt_join, discard, slack, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
WIDTH, BANDS = 4, 24
SMALL = 16
#: Texts of a block; a task holds two blocks with their shingles at a time.
BLOCK = 512
#: Shingles of a slice of the incidence matrices whose product counts what two blocks have in common.
COLUMNS = 4096
#: Bits of the table that tells which ids to read again, about eight for each id; ids that share a bit are read too and fall out in the join.
LEAST_BITS, MOST_BITS = 16, 26


def shingles(column: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, shingle hashes, bounds, hash of the whole word sequence, number of words) of slices; shingles repeat."""
    hasher, whole = W.Hasher(41), W.Hasher(43)
    for i, rows_here, part, cuts in W.parts(column, lower=True):
        s, e, bounds = W.words(part, cuts, W.ALNUM[part])
        values = hasher.spans(part, s, e)
        n = np.diff(bounds)
        at, rows = W.window_starts(bounds, width)
        found = hasher.windows(values, at, width)
        short = np.flatnonzero((n > 0) & (n < width))
        prefix = whole._prefix(values)
        sequence = W.mix((prefix[bounds[1:]] - prefix[bounds[:-1]]) * whole.down[bounds[:-1]] + n.astype(W.U64))
        if len(short):
            order = np.argsort(np.concatenate([rows, short]), kind="stable")
            found, rows = np.concatenate([found, sequence[short]])[order], np.concatenate([rows, short])[order]
        yield i, rows_here, found, np.searchsorted(rows, np.arange(rows_here + 1)), sequence, n


def counted(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles of each text, how often each occurs, bounds)."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])])[: len(found)])
    return found[first], np.diff(np.append(first, len(found))), np.searchsorted(owner[first], np.arange(len(bounds)))


def bands(elements: np.ndarray, counts: np.ndarray, bounds: np.ndarray, width: int, count: int) -> np.ndarray:
    """(texts, count) band values of DartMinHash signatures of shingles weighted by their counts."""
    sig = D.signatures(elements, bounds, width * count, counts.astype(np.float64)).reshape(-1, count, width)
    out = np.zeros(sig.shape[:2], dtype=W.U64)
    for x in range(width):
        out = W.mix(out ^ sig[:, :, x])
    return out


def _lists(values: np.ndarray, ptr: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values).cast(kind))


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key1, key2, bands) of each row with an id and a word; equal keys mean equal word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, found, bounds, sequence, words in shingles(batch.column(1)):
                some = np.flatnonzero(words > 0)
                values = bands(*counted(found, bounds), WIDTH, BANDS)[some]
                total = np.concatenate([np.zeros(1, W.U64), np.cumsum(W.mix(found), dtype=W.U64)])
                second = (total[bounds[1:]] - total[bounds[:-1]])[some]
                lists = _lists(values.ravel().view(np.int64), np.arange(len(some) + 1) * BANDS, pa.int64())
                keys = [pa.array(sequence[some].view(np.int64)), pa.array(second.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n).take(pa.array(some)), *keys, lists], names=["id", "key1", "key2", "bands"])

    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, key1 long, key2 long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the rows whose id is in ids, one row for each id; shingles are 32 bits of the hashes, in order.

    The second occurrence of a shingle in a text has a hash of its own, and so on: what two such sets share and hold are the sums of
    smaller and of larger weights. A bitmap of at most 2**MOST_BITS bits keeps most other texts from being cut at all; the join decides.
    """
    bits = 1 << min(max((8 * ids.count()).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    word, bit = F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {bits}) & 63 AS int))")
    bitmap = ids.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    rows = docs.select(column(id_col).cast("long").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text")).withColumn("word", word)
    near = rows.join(F.broadcast(bitmap), "word").where(F.col("bits").bitwiseAND(bit) != 0).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, found, bounds, _, _ in shingles(batch.column(1)):
                elements, counts, upto = counted(found, bounds)
                owner = np.repeat(np.repeat(np.arange(n), np.diff(upto)), counts)
                layer = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                each = W.mix(np.repeat(elements, counts) + layer.astype(W.U64) * W.U64(0x9E3779B97F4A7C15))
                pair = np.unique(owner.astype(W.U64) << W.U64(32) | each >> W.U64(32))
                ptr = np.searchsorted(pair >> W.U64(32), np.arange(n + 1))
                lists = _lists((pair & W.U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ptr, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), lists], names=["id", "shingles"])

    # An id that repeats with different texts would bring several sets; one is kept, the same in every run.
    sets = near.mapInArrow(run, "id long, shingles array<int>").join(ids, "id", "left_semi")
    return sets.groupBy("id").agg(F.max_by("shingles", F.xxhash64("shingles")).alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach it."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    both = both.where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
    both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
    ratio = F.col("common") / (F.size("x") + F.size("y") - F.col("common"))
    return both.withColumn("similarity", ratio).where(F.col("similarity") >= similarity).select("a", "b", "similarity")


def _stars(rows: DataFrame, key: list[str]) -> DataFrame:
    """(a, b) with a < b: every row's id with two members of its bucket, where they are of other classes than the row."""
    member = F.struct("id", "class_id")
    centres = rows.groupBy(*key).agg(F.min_by(member, F.struct("class_id", "id")).alias("c1"), F.min_by(member, F.xxhash64("id", *key)).alias("c2"))
    near = dealt_join(rows, centres, key)
    pair = lambda c: near.where(f"{c}.class_id <> class_id").select(F.least(f"{c}.id", "id").alias("a"), F.greatest(f"{c}.id", "id").alias("b"))
    return pair("c1").union(pair("c2")).distinct()


def _across(rows: DataFrame, key: list[str]) -> DataFrame:
    """(a, b) with a < b of different classes in the same bucket; the buckets hold at most SMALL ids."""
    left = rows.select(*key, F.col("id").alias("a"), F.col("class_id").alias("class_a"))
    right = rows.select(*key, F.col("id").alias("b"), F.col("class_id").alias("class_b"))
    return left.join(right, key).where("a < b AND class_a <> class_b").select("a", "b").distinct()


def _open(rows: DataFrame, classes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the buckets whose members are of several classes, with class_id and the bucket's size n."""
    known = rows.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    sums = known.groupBy(*key).agg(F.count("*").alias("n"), F.min("class_id").alias("lo"), F.max("class_id").alias("hi"))
    mixed = sums.where("lo <> hi").drop("lo", "hi")
    return dealt_join(known, mixed, key)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(left, right) numbers of shingles that two texts share."""
    values, at = np.unique(np.concatenate(left + right), return_inverse=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    mine = owner < len(left)
    both = (np.bincount(at[mine], minlength=len(values)) > 0) & (np.bincount(at[~mine], minlength=len(values)) > 0)
    column = np.cumsum(both) - 1
    used = both[at]
    owner, at = owner[used], column[at[used]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(both.sum()), COLUMNS):
        part = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[owner[part], at[part] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of the first pairs of classes (a, b) that are enough to connect what all of them connect."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (p := top(x)) != (q := top(y)):
            root[p] = q
            out.append(i)
    return out


def block_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links (a, b, similarity) between the two blocks of a bucket, as many as connect the classes that links connect.

    Rows with of_left are the left block, all outside the bucket's largest class; minor tells the same of the right block's.
    """
    table = table.combine_chunks()
    left = table["of_left"].to_numpy()
    column = lambda name: table[name].to_numpy()
    lists = table["shingles"].chunk(0) if table["shingles"].num_chunks else pa.array([], pa.list_(pa.int32()))
    ptr, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    keys = table["bands"].chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    ids, classes, size, band = column("id"), column("class_id"), np.diff(ptr), column("band")[0]
    x, y = np.flatnonzero(left), np.flatnonzero(~left)
    pair = classes[x][:, None] != classes[y][None, :]
    # Of two texts outside the largest class one meeting is enough, and of the bands that two texts share the first.
    pair &= (ids[x][:, None] < ids[y][None, :]) | ~column("minor")[y][None, :]
    pair &= np.minimum(size[x][:, None], size[y][None, :]) >= similarity * np.maximum(size[x][:, None], size[y][None, :])
    for earlier in range(band):
        pair &= keys[x, earlier][:, None] != keys[y, earlier][None, :]
    x, y, pair = x[pair.any(1)], y[pair.any(0)], pair[pair.any(1)][:, pair.any(0)]
    p = q = np.zeros(0, np.int64)
    ratio = np.zeros(0)
    if pair.any():
        common = _common([values[ptr[i] : ptr[i + 1]] for i in x], [values[ptr[i] : ptr[i + 1]] for i in y])
        found = common / (size[x][:, None] + size[y][None, :] - common)
        i, j = np.nonzero(pair & (found >= similarity))
        some = _joining(classes[x[i]], classes[y[j]])
        i, j = i[some], j[some]
        p, q, ratio = ids[x[i]], ids[y[j]], found[i, j]
    return pa.table({"a": np.minimum(p, q), "b": np.maximum(p, q), "similarity": ratio})


def _rest(rows: DataFrame, reps: DataFrame, sets: DataFrame, key: list[str], similarity: float) -> DataFrame:
    """(a, b, similarity): links that connect classes in buckets of any size; each pair of a bucket's classes is compared whole.

    A bucket is cut into blocks, those of its largest class only meet the others. Each block travels once for each block it meets.
    """
    counts = rows.groupBy(*key, "class_id").agg(F.count("*").alias("c"))
    tops = counts.groupBy(*key).agg(F.max_by("class_id", F.struct("c", "class_id")).alias("top"), F.sum("c").alias("all"), (F.sum("c") - F.max("c")).alias("others"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    placed = dealt_join(rows.drop("n"), tops, key).select(*key, "id", "class_id", (F.col("class_id") != F.col("top")).alias("minor"), F.xxhash64("id", F.lit(BLOCK)).alias("h"), blocks("others").alias("ni"), blocks("all").alias("nj"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.col("h"), F.col(n)).cast("int")
    first = placed.where("minor").select(*key, "id", "class_id", "minor", F.lit(True).alias("of_left"), mine("ni").alias("i"), each("nj").alias("j"))
    second = placed.select(*key, "id", "class_id", "minor", F.lit(False).alias("of_left"), each("ni").alias("i"), mine("nj").alias("j"))
    whole = sets.join(rows.select("id").distinct(), "id", "left_semi").join(reps, "id").select("id", "shingles", "bands")
    met = first.union(second).join(whole, "id")
    return met.groupBy(*key, "i", "j").applyInArrow(lambda t: block_links(t, similarity), "a long, b long, similarity double")


def classes_of(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((id, class_id) of the texts (id, bands) that are linked to another, verified links (a, b, similarity) that connect the classes)."""
    each = reps.select("id", F.posexplode("bands").alias("band", "value"))
    key = ["band", "value"]
    shared = each.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = written(dealt_join(each, shared, key), "buckets")
    tested = written(_stars(rows.withColumn("class_id", F.col("id")), key), "pairs")
    sets = written(shingle_sets(docs, rows.select("id").distinct(), id_col, text_col), "shingles")
    found = written(verified(tested, sets, similarity), "links")
    classes = components(found)

    left = written(_open(rows, classes, key), "open")
    small = written(_across(left.where(f"n <= {SMALL}"), key).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = verified(small, sets, similarity).union(_rest(left.where(f"n > {SMALL}"), reps, sets, key, similarity))
    more = written(more, "links")
    links = written(found.union(more).distinct(), "links")
    if not more.isEmpty():
        discard(classes)
        classes = components(links)
    discard(rows, tested, sets, found, left, small, more)
    return classes, links


def best_links(links: DataFrame) -> DataFrame:
    """(id, link_id, link_similarity): the most similar text that each text is known to be linked to, the smallest id of equals."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "similarity")
    best = ends.groupBy("e.id").agg(F.max(F.struct("similarity", (-F.col("e.other")).alias("other"))).alias("best"))
    return best.select("id", (-F.col("best.other")).alias("link_id"), F.col("best.similarity").alias("link_similarity"))


@dataclass
class NearDuplicates:
    """Rows of ``near_dedup``, and verified links (a, b, similarity) between representatives, whose components are the classes."""

    rows: DataFrame
    links: DataFrame


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: id, class_id (smallest id of the class), class_size, kept (whether the row's id is the class id), link_id, link_similarity.

    The link is a verified one of the row's text: to its representative, the smallest id of the same word sequence, where that is another row's, else
    to the most similar text that it was found to be linked to; null for a row that is alone or the representative of nothing but copies.
    """
    return near_duplicates(docs, id_col, text_col, similarity).rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> NearDuplicates:
    """Membership and representative pairs; no pair of texts that could join two classes is left out of what was verified."""
    slack(docs, [id_col, text_col], "near_dedup")
    table = written(signed(docs, id_col, text_col), "signed")
    key = ["key1", "key2"]
    texts = written(table.groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "texts")
    classes, links = classes_of(texts.select("id", "bands"), docs, id_col, text_col, similarity)
    known = texts.select(*key, "id", "copies").join(classes.join(best_links(links), "id"), "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    size = known.groupBy("class_id").agg(F.sum("copies").alias("class_size")).where("class_size > 1")
    # Only texts that are not alone are joined back, all others are their own class.
    alike = known.join(size, "class_id").select(*key, "class_id", "class_size", F.col("id").alias("of"), "link_id", "link_similarity")
    rows = dealt_join(table.select("id", *key).distinct(), alike, key)
    same = F.col("id") == F.col("of")
    linked = [F.when(same, F.col("link_id")).otherwise(F.col("of")).alias("link_id"), F.when(same, F.col("link_similarity")).otherwise(F.lit(1.0)).alias("link_similarity")]
    # An id that repeats with texts of several classes is in the smallest of them.
    rows = rows.select("id", "class_id", "class_size", *linked).groupBy("id").agg(F.min(F.struct("class_id", "class_size", "link_id", "link_similarity")).alias("class"))
    rows = written(rows.select(F.col("id").alias("_id"), "class.*"), "members")
    discard(table, texts, classes)
    every = docs.select(column(id_col).alias("_own"), column(id_col).cast("long").alias("_id"))
    out = every.join(rows, "_id", "left").select(
        F.col("_own").alias(id_col),
        F.coalesce("class_id", "_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("class_id").isNull() | (F.col("class_id") == F.col("_id"))).alias("kept"),
        "link_id",
        "link_similarity",
    )
    return NearDuplicates(out, links)
