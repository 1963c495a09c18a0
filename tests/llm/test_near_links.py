"""Near-duplicate links and recall against a weighted brute force."""

from collections import Counter

import numpy as np
import pytest
from tests.llm import nasty
from tests.llm.test_operators import W, template_family


def weights(text):
    w = W.findall((text or "").lower().encode())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def weighted_pairs(rows, threshold=0.8):
    """{(a, b): similarity} of all different texts, by sums of smaller and of larger counts."""
    bags = {d: weights(t) for d, t, *_ in rows if d is not None and weights(t)}
    ids, out = sorted(bags), {}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = bags[a], bags[b]
            n, m = x.total(), y.total()
            if min(n, m) >= threshold * max(n, m):
                common = (x & y).total()
                if common >= threshold * (n + m - common):
                    out[a, b] = common / (n + m - common)
    return out


def classes(ids, pairs):
    root = {d: d for d in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return {d: top(d) for d in ids}


def repeated(rng, i):
    """A text in which shingles repeat, so that weighted and plain similarity differ."""
    part = [f"r{i}x{k}" for k in range(20)]
    w = part * 4 + [f"s{i}x{k}" for k in range(10)]
    w += part * int(rng.randint(0, 3))
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.RandomState(4)
    rows = template_family(120, seed=3, own=(20, 60))
    for i in range(25):
        rows += [(1000 + 3 * i + k, repeated(rng, i), None, None, None) for k in range(3)]
    rows += [(5000 + d, t, *rest) for d, t, *rest in nasty.rows() if d is not None and len(t or "") < 5000]
    return rows


def test_links_and_classes_by_weights(spark, corpus):
    """Every link is a pair of the brute force with its similarity, and their components are its classes; recall of pairs is whole."""
    from wavemill.llm.near_dedup import near_duplicates

    want = weighted_pairs(corpus)
    found = near_duplicates(spark.createDataFrame(corpus, nasty.SCHEMA))
    rows = found.rows.collect()
    links = {(r.a, r.b): r.similarity for r in found.links.collect()}
    assert links and all(k in want and v == pytest.approx(want[k]) for k, v in links.items())
    ids = {d for d, *_ in corpus}
    expected = classes(ids, want)
    got = {r.doc_id: r.class_id for r in rows}
    assert got == expected and classes(ids, [*links, *((r.doc_id, r.link_id) for r in rows if r.link_id is not None)]) == expected
    texts = {}
    for d, t, *_ in corpus:
        texts.setdefault(expected[d], set()).add(tuple(W.findall((t or "").lower().encode())))
    for r in rows:
        assert (r.link_id is None) == (r.doc_id == r.class_id and (len(texts[r.class_id]) == 1))
        if r.link_id is not None:
            assert r.link_id != r.doc_id and want[min(r.doc_id, r.link_id), max(r.doc_id, r.link_id)] == pytest.approx(r.link_similarity)
    recall = np.mean([got[a] == got[b] for a, b in want])
    assert recall >= 0.9 and len(want) > 1000


def test_recall_over_a_table(spark, sf):
    """Ids divisible by 50 against all rows of the smallest table: at least 0.9 of the pairs are in one class."""
    from wavemill.llm.near_dedup import near_dedup

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = [p for p in weighted_pairs(rows) if p[0] % 50 == 0 or p[1] % 50 == 0]
    got = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    assert not pairs or np.mean([got[a] == got[b] for a, b in pairs]) >= 0.9
