"""The pipeline's stages against brute force, on a corpus with planted cases."""

import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm import nasty
from tests.llm.test_operators import covered, jaccard_classes, template_family, toxic_tables
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    toxic, labels = toxic_tables(spark, 400)
    rng = np.random.RandomState(3)
    item = [f"q{i}" for i in range(30)]
    rows = [(10_000 + (d or 0), t, g, s, n) if d is not None else (d, t, g, s, n) for d, t, g, s, n in nasty.rows()]
    rows += [(r.doc_id, r.text, None, None, None) for r in toxic.collect()]
    rows += [(20_000 + i, " ".join([f"u{i}_{k}" for k in range(20)] + item + [f"v{i}"]), None, None, None) for i in range(5)]
    order = rng.permutation(len(rows))
    docs = spark.createDataFrame([rows[i] for i in order], nasty.SCHEMA).repartition(4)
    docs = docs.withColumns({c: F.lit(v) for c, v in (nasty.EXTRA | {"meta.lang": "xx", "keep_id": 3, "word": 1}).items()})
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    stage = dict(P.STAGES)
    key = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    kept = stage[names[0]](spark, docs, corpus).cache()
    assert kept.columns == docs.columns
    gone = key(docs) - key(kept)
    bad = {i for i in range(0, 400, 5)}
    assert len(bad & {d for d, _ in gone}) > 0.9 * len(bad) and len({d for d, _ in gone} - bad) < 5

    before, kept = key(kept), stage[names[1]](spark, kept, corpus).cache()
    after = key(kept)
    assert kept.columns == docs.columns and not after - before and max(after.values()) == 1
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    best = {}
    for d, t in before:
        best[lower(t)] = max(best.get(lower(t), -(1 << 64)), -(1 << 64) if d is None else d)
    assert Counter((d, lower(t)) for d, t in after) == Counter((None if d == -(1 << 64) else d, t) for t, d in best.items())

    kept2 = stage[names[2]](spark, kept, corpus).cache()
    classes = jaccard_classes([(d, t) for d, t in after])
    assert key(kept2) == Counter({(d, t): n for (d, t), n in after.items() if classes.get(d, d) == d})

    kept3 = stage[names[3]](spark, kept2, corpus).cache()
    lost = {d for d, _ in key(kept2) - key(kept3)}
    assert lost and lost <= set(range(20_000, 20_005)) and kept3.columns == docs.columns

    item = {tuple(f"q{i}" for i in range(30))}
    words = lambda t: (t or "").lower().split()
    for d, t in key(kept2):  # against a plain tiling of every text that has any of the item
        w = words(t)
        hit = any(covered(list(x), w) >= 15 for x in item) if set(w) & set(next(iter(item))) else False
        assert (d in lost) == hit or (d is None and not hit)

    pieces = stage[names[4]](spark, kept3, corpus).toPandas()
    assert pieces.groupby("sequence_id")["length"].sum().max() <= 4096
    assert set(pieces["doc_id"].dropna()) == {d for d, _ in key(kept3) if d is not None}
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in key(kept3).elements())
    sizes = pieces.drop_duplicates(["doc_id", "doc_tokens"])
    assert {(r.doc_id, r.doc_tokens) for r in sizes.dropna().itertuples()} == {k for k in want if k[0] is not None}
    assert pieces["length"].sum() == sum(n * c for (_, n), c in want.items())


def test_near_stage_keeps_one_of_a_template_family(spark, sf):
    """Of a large family with similarities around 0.8, and of a second one beside it, one document of each true class stays."""
    rows = template_family() + template_family(300, seed=1, first=5_000)
    kept = dict(P.STAGES)["near dedup"](spark, spark.createDataFrame(rows, nasty.SCHEMA), sf)
    classes = jaccard_classes(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_run_and_empty(spark, corpus, tmp_path):
    assert P.run(spark, corpus).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_held_out_rule():
    assert [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 == 2]
