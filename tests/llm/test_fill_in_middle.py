"""Fill-in-the-middle rows against a plain, text by text version."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from tests.llm import nasty

TEXTS = ["", "a", "ab cd", "é", "日本", "<P>", "a<S>b", "<M", "<", "<P", ">", "<Q>", "a" * 50, "1 2 3", "x<P y>", "a\x00b", "über-maß 😀 tail", "<<P>>", "S>P><M", "<" * 9 + ">" * 9]


def by_hand(doc_id, text, seed=1, rate=90, spm_rate=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    assert "".join(units) == text
    g = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(pre), len(mid), "<S>" + suf + "<P>" + pre + "<M>" + mid
    return doc_id, n, "psm", len(pre), len(mid), "<P>" + pre + "<S>" + suf + "<M>" + mid


def table(spark):
    rng = random.Random(5)
    rows = [(d, t) for d, t, *_ in nasty.rows()] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(2000 + i, "".join(rng.choice("ab <>PSM.é日") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    return rows, spark.createDataFrame([(t, d, 1, "x", 2) for d, t in rows], "text string, doc_id long, n int, form string, `out.put` int").repartition(3)


def test_fill_in_middle(spark):
    from wavemill.llm.fill_in_middle import fill_in_middle, restored

    rows, df = table(spark)
    got = restored(fill_in_middle(df)).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(by_hand(d, t) for d, t in rows)
    assert Counter((r.doc_id, r.restored) for r in got) == Counter((d, t or "") for d, t in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fill_in_middle_options(spark):
    """Other seeds and rates, text ids, columns with dots, and an empty table."""
    from wavemill.llm.fill_in_middle import fill_in_middle, restored

    rows = [(f"d{i}", t) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "`a.id` string, `a.text` string")
    got = fill_in_middle(df, "a.id", "a.text", seed=9, rate=50, spm_rate=70).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(d, t, 9, 50, 70) for d, t in rows)
    back = restored(fill_in_middle(df, "a.id", "a.text"), name="a.id")
    assert Counter(r["a.id"] for r in back.collect()) == Counter(t for _, t in rows)
    assert restored(fill_in_middle(nasty.empty(spark))).count() == 0


def test_slices_of_any_size(monkeypatch):
    """Rows that end slices, slices of one row, and slices of sliced columns give what one slice gives."""
    from wavemill.llm import fill_in_middle as M

    rng = np.random.RandomState(0)
    texts = pa.array(["".join(rng.choice(list("ab <>PSMé日")) for _ in range(rng.randint(0, 40))) for _ in range(300)])
    h = rng.randint(0, 1 << 32, (300, 4), dtype=np.int64)
    whole = pa.Table.from_batches(M.transformed(texts, h))
    for most in (1, 7, 100):
        monkeypatch.setattr(M, "SLICE_BYTES", most)
        assert pa.Table.from_batches(M.transformed(texts, h)).combine_chunks() == whole.combine_chunks()
    part = pa.Table.from_batches(M.transformed(texts.slice(50, 90), h[50:140]))
    assert part.combine_chunks() == whole.slice(50, 90).combine_chunks()


def test_query_against_sql(spark, sf):
    import __spark_entry__ as registry

    name = "op11_buffer_fim"
    got = registry.queries()[name](spark, sf)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.execute(registry.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
