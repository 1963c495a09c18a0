"""Language-model scores: counts against brute force, the network against plain loops, its sums and what it learns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm import nasty

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def cut(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def by_counts(rows):
    """{row: number of such rows} without the model's score."""
    c = Counter(w for d, t in rows if d is not None and not held(d) for w in cut(t))
    n, v = sum(c.values()), len(c)
    out = Counter()
    for d, t in rows:
        w = cut(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out[(d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(base, 6))] += 1
    return out


def markov(n=400, seed=0, size=40):
    """Texts in which a word is followed by one of two."""
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(size)]
    rows = []
    for d in range(n):
        w = [rng.randrange(size)]
        while len(w) < 120:
            w.append((2 * w[-1] + rng.randrange(2)) % size)
        rows.append((d, " ".join(names[i] for i in w)))
    return rows


@pytest.mark.parametrize("frequent", [1 << 18, 30, 3])
def test_counts(spark, frequent):
    """All counts, whichever words the tasks know; nulls, repeated rows, empty and long texts, clashing columns."""
    from wavemill.llm.language_model import language_model

    rows = [(d, t) for d, t, *_ in nasty.rows()]
    df = spark.createDataFrame([(t, d, 1, "x", 2) for d, t in rows], "text string, doc_id long, row int, key string, `held.out` int").repartition(3)
    got = language_model(df, vocabulary=16, frequent=frequent).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_counts(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {}
    for r in got:  # equal rows have equal scores
        same.setdefault((r.doc_id, r.n_tokens, round(r.base_score, 6)), set()).add(round(r.score, 9))
    assert all(len(x) == 1 for x in same.values())


def test_nothing_to_learn(spark):
    from wavemill.llm.language_model import language_model

    assert language_model(nasty.empty(spark)).count() == 0
    only = [i for i in range(100) if held(i)][:3]
    rows = [(i, "a b a") for i in only] + [(None, "c")]
    got = language_model(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == by_counts(rows)


def test_learns_what_counts_cannot(spark):
    """Held-out texts of a Markov chain: much likelier than by counts, in several tasks as in one."""
    from wavemill.llm.language_model import language_model

    df = spark.createDataFrame(markov(1500), "`a.id` long, `b.text` string")
    for parts in (1, 40):  # 40 tasks: two levels of averages
        got = language_model(df.repartition(parts, "`a.id`"), "a.id", "b.text").where("held_out").collect()
        base, score, n = (sum(r[c] for r in got) for c in ("base_score", "score", "n_tokens"))
        assert len(got) > 50 and score / n > base / n + (0.5 if parts == 1 else 0.1)


def model(words=50, seed=0):
    from wavemill.llm import _bilinear as B

    rng = np.random.default_rng(seed)
    shape = B.Shape(np.sort(rng.integers(1, 1000, words))[::-1], 700.0)
    return B, shape, (rng.normal(0, 0.5, (shape.rows, B.DIM + 1))).astype(np.float32)


def test_probabilities_add_up():
    """Over the vocabulary and all other words, and over those others by their shares."""
    from wavemill.llm.language_model import Words

    B, shape, t = model()
    context = np.random.default_rng(1).integers(0, shape.words + 2, (20, B.CONTEXT))
    for row in B.distribution(t, shape, context):
        assert abs(row.sum() - 1) < 1e-5 and (row > 0).all()
    counts = np.array([5, 100, 40, 9, 8, 3, 1])
    words = Words(np.arange(7, dtype=np.uint64), counts, int(counts.sum()) + 6, 7 + 4, 3)
    rarer = np.array([*counts[3:], 3, 1, 1, 1, 0])  # four words that tasks do not know, and one for all unknown
    assert abs((10 ** words.share(rarer)).sum() - 1) < 1e-9


def test_network_against_plain_loops():
    """Probabilities by loops over tokens, places and words; contexts stop at the beginning of a text."""
    B, shape, t = model()
    rng = np.random.default_rng(2)
    starts, tokens = np.array([0, 1, 8]), rng.integers(0, shape.words + 1, 30)
    got = B.log_probabilities(t, shape, tokens, starts)
    for i, y in enumerate(tokens):
        first = starts[starts <= i].max()
        q = np.zeros(B.DIM)
        for k in range(B.CONTEXT):
            before = tokens[i - k - 1] if i - k - 1 >= first else shape.words + 1
            q += t[before, : B.DIM].astype(float) * t[shape.place][k, : B.DIM]
        score = lambda row: math.exp(float(q @ row[: B.DIM]) + float(row[B.DIM]))
        groups = [score(r) for r in t[shape.group]]
        c = int(shape.class_of[y])
        p = groups[c] / sum(groups)
        if y < shape.words:
            inside = [score(r) for r in t[shape.word][shape.first[c] : shape.first[c + 1]]]
            p *= inside[y - shape.first[c]] / sum(inside)
        assert abs(got[i] - math.log(p)) < 1e-4


def test_first_parameters_are_the_counts():
    B, shape, _ = model()
    t = shape.start()
    t[shape.context] = 0
    row = next(B.distribution(t, shape, np.zeros((1, B.CONTEXT), int)))
    want = np.append(shape.counts, shape.others) / (shape.counts.sum() + shape.others)
    assert np.allclose(row, want, rtol=1e-4)


def test_step_lowers_the_loss():
    """Many steps on one stretch raise the probability of its tokens, for every batch of a text cut anywhere."""
    B, shape, _ = model(200)
    rng = np.random.default_rng(4)
    tokens = np.cumsum(rng.integers(1, 3, 20_000)) % 201
    starts = np.arange(0, 20_000, 500)
    t = shape.start()
    before = B.log_probabilities(t, shape, tokens, starts).mean()
    trainer = B.Trainer(t, shape, 0)
    for _ in range(15):
        trainer.learn(tokens, starts)
    after = B.log_probabilities(trainer.t, shape, tokens, starts).mean()
    assert after > before + 1.5 and after < 0
