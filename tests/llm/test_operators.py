"""Each operator against brute force on a table of awkward rows, and on an empty one."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tests.llm import nasty

W = re.compile(rb"[0-9a-z\x80-\xff]+")


@pytest.fixture(scope="module")
def docs(spark):
    return nasty.documents(spark).cache()


@pytest.fixture(scope="module")
def plain():
    return nasty.rows()


def byte_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


#: The strings of special tokens in texts, and ids at the ends of their range.
SPECIAL = [(-(1 << 63), "x <|endoftext|> y", None, None, None), (1 << 53, "<|startoftext|>a <|endoftext|>", None, None, None)]


def test_substring_dedup(spark, docs, plain):
    from wavemill.llm.substring_dedup import substring_dedup

    first = {}
    for d, t, *_ in plain:
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            if d is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, t, *_ in plain:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if d is not None and first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = True
        want[(d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())] += 1
    got = substring_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert all(sum(s.length for s in r.removed) == r.n_removed for r in got)
    assert sum(r.n_removed for r in got) > 0
    assert substring_dedup(nasty.empty(spark)).count() == 0


def test_substring_dedup_repeated_ids(spark):
    """Of two texts under one id each loses only what it has in common with a smaller id; extra columns clash and hold dots."""
    from wavemill.llm.substring_dedup import substring_dedup

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b + " tail"), (4, "  " + a.replace(" ", "\n\t ") + " ")]
    df = spark.createDataFrame([(d, t, 1, 2, "z") for d, t in rows], "doc_id long, text string, row int, `copy.of` int, id string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring_dedup(df).collect())
    assert got == Counter([(1, 60, 0, a), (2, 60, 60, ""), (2, 60, 0, b), (3, 60, 60, ""), (3, 61, 60, "tail"), (4, 60, 60, "")])


def test_substring_dedup_small_windows(spark):
    """Many short repeats at every offset: the cover misses none."""
    from wavemill.llm.substring_dedup import substring_dedup

    rng = np.random.RandomState(0)
    part = [f"p{i}" for i in range(9)]
    rows = [(d, " ".join([f"w{d}_{i}" for i in range(rng.randint(0, 12))] + part[rng.randint(0, 2) : rng.randint(7, 10)] + [f"v{d}_{i}" for i in range(5)])) for d in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for d, t in rows:
        w = t.split()
        here = [tuple(w[i : i + 6]) for i in range(len(w) - 5)]
        gone = np.zeros(len(w), bool)
        for i, x in enumerate(here):
            if x in seen:
                gone[i : i + 6] = True
        seen.update(here)
        want[d] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in substring_dedup(df, window=6, period=3, cover=(0, 1)).collect()}
    assert got == want and sum(want.values()) > 100


def test_exact_dedup(spark, docs, plain):
    from wavemill.llm.exact_dedup import exact_dedup

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for d, t, *_ in plain:
        groups[lower(t)].append(d)
    got = exact_dedup(docs).collect()
    assert len(got) == len(plain)
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    for r in got:
        ids = by[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert exact_dedup(nasty.empty(spark)).count() == 0


def jaccard_classes(plain, threshold=0.8):
    sets = {}
    for d, t, *_ in plain:
        w = W.findall((t or "").lower().encode())
        if d is not None and w:
            sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_near_dedup(spark, docs, plain):
    from wavemill.llm.near_dedup import near_dedup

    want = jaccard_classes(plain)
    got = near_dedup(docs).collect()
    assert len(got) == len(plain)
    size = Counter(want[d] for d, *_ in plain if d in want)
    for r in got:
        assert r.class_id == want.get(r.doc_id, r.doc_id)
        assert r.kept == (r.doc_id is None or r.class_id == r.doc_id)
        if r.doc_id in want:
            assert (r.class_size > 1) == (size[r.class_id] > 1)
    assert len(set(want.values())) < len(want)
    assert near_dedup(nasty.empty(spark)).count() == 0


def test_near_dedup_large_bucket(spark):
    """More near copies than a small bucket holds, in two groups that share half their words."""
    from wavemill.llm.near_dedup import near_dedup

    rng = np.random.RandomState(0)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(2):
        own = [f"g{g}_{i}" for i in range(50)]
        for i in range(40):
            w = common + own
            w[rng.randint(len(w))] = f"x{g}_{i}"
            rows.append((len(rows), " ".join(w), None, None, None))
    got = {r.doc_id: r.class_id for r in near_dedup(spark.createDataFrame(rows, nasty.SCHEMA)).collect()}
    assert got == jaccard_classes(rows) and len(set(got.values())) == 2


def template_family(n=1000, seed=0, first=0, own=(0, 76)):
    """Rows of n different texts: 300 shingles of a template and some of their own; two of at most 75 together are linked."""
    rng = np.random.RandomState(seed)
    common = [f"t{seed}x{i}" for i in range(304)]
    return [(first + i, " ".join(common + [f"o{seed}x{i}x{k}" for k in range(rng.randint(*own))]), None, None, None) for i in range(n)]


def test_near_dedup_template_family(spark):
    """Links that are between members of a large bucket, none of them a centre, are found too."""
    from wavemill.llm.near_dedup import near_dedup

    rows = template_family()
    got = {r.doc_id: r.class_id for r in near_dedup(spark.createDataFrame(rows, nasty.SCHEMA)).collect()}
    want = jaccard_classes(rows)
    assert len(set(want.values())) < len(want)
    assert sum(got[d] != want[d] for d in want) == 0


def test_near_dedup_blocks():
    """Two blocks against brute force: earlier shared bands, the order of ids, size bounds and what connects classes."""
    from wavemill.llm import near_dedup as N

    rng = np.random.RandomState(1)
    n = 60
    sets = [np.unique(np.concatenate([np.arange(rng.randint(60, 90)), rng.randint(1000, 1020, rng.randint(20))])).astype(np.int32) for _ in range(n)]
    keys = rng.randint(0, 3, (n, N.BANDS)).astype(np.int64)
    keys[:, 2] = 7
    classes, minor = rng.randint(0, 9, n), rng.uniform(size=n) < 0.5
    minor[:20] = True
    classes[minor] += 1
    classes[~minor] = 0
    side = np.arange(n) < 20
    table = pa.table({"band": np.full(n, 2, np.int32), "id": np.arange(n) * 3 % n + np.arange(n) * n, "class_id": classes, "minor": minor, "of_left": side, "shingles": [s.tolist() for s in sets], "bands": [k.tolist() for k in keys]}).cast(
        pa.schema({"band": pa.int32(), "id": pa.int64(), "class_id": pa.int64(), "minor": pa.bool_(), "of_left": pa.bool_(), "shingles": pa.list_(pa.int32()), "bands": pa.list_(pa.int64())})
    )
    ids = table["id"].to_numpy()
    want = {}
    for i in range(20):
        for j in range(20, n):
            c = len(np.intersect1d(sets[i], sets[j]))
            sim = c / (len(sets[i]) + len(sets[j]) - c)
            if classes[i] != classes[j] and sim >= 0.8 and (keys[i, :2] != keys[j, :2]).all() and (not minor[j] or ids[i] < ids[j]):
                want[min(ids[i], ids[j]), max(ids[i], ids[j])] = sim
    got = {(r["a"], r["b"]): r["similarity"] for r in N.block_links(table, 0.8).to_pylist()}
    assert got and got.items() <= want.items()
    of = dict(zip(ids.tolist(), classes.tolist(), strict=True))

    def joined(pairs):
        group = {c: {c} for c in of.values()}
        for a, b in pairs:
            both = group[of[a]] | group[of[b]]
            for c in both:
                group[c] = both
        return {frozenset(g) for g in group.values()}

    assert joined(got) == joined(want)
    assert N.block_links(table, 1.01).num_rows == 0


def test_dart_signatures_estimate_weighted_jaccard():
    from wavemill.llm import _darts as D
    from wavemill.llm import _words as U

    rng = np.random.RandomState(0)
    a, b = np.array([1.0, 2.5, 0.3, 4, 0]), np.array([1.5, 2, 0.3, 1, 2])
    hits = []
    for i in range(200):
        e = U.mix(np.arange(5, dtype=np.uint64) + np.uint64(97 * i))
        s = D.signatures(np.concatenate([e[:4], e]), np.array([0, 4, 9]), 64, np.concatenate([a[:4], b]))
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02
    assert (D.signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8) == D.EMPTY).all()
    del rng


def test_components(spark):
    from wavemill.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 1)]
    got = {r.id: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, docs, plain):
    from wavemill.llm.sharding import jump, shard_documents

    got = shard_documents(docs, 8).collect()
    assert len(got) == len(plain)
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in plain)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want

    def naive(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    for r in got:
        key = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.law, r.shard, r.grown_shard) == ("key", naive(key, 8), naive(key, 9))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert np.bincount(jump(np.random.RandomState(0).randint(0, 2**63, 80_000).astype(np.uint64), 8)).min() > 9_500
    assert shard_documents(nasty.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        shard_documents(docs, 0)


def test_simple8b_blocks():
    from wavemill.llm import token_output as S

    rng = np.random.default_rng(1)
    for trial in range(60):
        n, bits = int(rng.integers(1, 5000)), int(rng.integers(1, 33))
        v = rng.integers(0, 2**bits, n, dtype=np.uint64) >> rng.integers(0, bits, n).astype(np.uint64)
        if trial % 3 == 0:
            v[rng.random(n) < 0.95] = 0
        if trial % 7 == 0:
            v[int(rng.integers(n))] = 2**60 - 1  # the escape
        blocks = S.encode_blocks(v)
        assert (np.concatenate([S.decode(b) for b in blocks]) == v).all()
        assert [len(S.decode(b)) for b in blocks] == [min(S.BLOCK_IDS, n - i) for i in range(0, n, S.BLOCK_IDS)]
    with pytest.raises(ValueError):
        S.encode_blocks(np.array([2**60], dtype=np.uint64))


def test_token_output(spark, docs, plain):
    from wavemill.llm.token_output import encode_documents

    path, t = byte_bpe()
    plain = [*plain, *SPECIAL]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in SPECIAL], "doc_id long, text string"))
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for d, x, *_ in plain if d is not None}
    got = encode_documents(docs, path, 0).orderBy("start").collect()
    assert len(got) == len(plain)
    at = 0
    order = [r.doc_id if r.doc_id is not None else -(1 << 64) for r in got]
    assert order == sorted(order) and -(1 << 63) in order
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
    assert encode_documents(nasty.empty(spark), path, 0).count() == 0


def test_token_files_roll(spark, plain):
    """Small files: the order over files and the whole of the ids stay."""
    from wavemill.llm import token_output as S

    path, t = byte_bpe()
    one = spark.createDataFrame([r[:2] for r in plain] * 3, "doc_id long, text string").coalesce(1)
    files = S.write_tokens(one, path, 0, file_docs=5, file_ids=100_000)
    got = S.read_tokens(files, with_ids=True).orderBy("start").collect()
    assert files.count() >= 3 and len(got) == 3 * len(plain)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = Counter((d, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for d, x, *_ in plain)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == {k: 3 * n for k, n in want.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_whole_encodings(name, monkeypatch):
    """Against the library as it comes, special tokens in texts included."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer
    from wavemill.llm import _tokenize as T
    from wavemill.llm._tokenize import Encoder

    e, rng = Encoder(public_tokenizers.path(name)), random.Random(1)
    parts = ["a", "b", "S", "'s", "'t", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", " ", "　", "é", "é", "Σ", "ς", "1", "²", "!", "?", "<|endoftext|>", "‍", "😀", "ß", "İ", "\r", " ̈", "中", "\x00"]
    parts += ["\xa0", "×", "÷", "привет", "ſ", "\x0b", "don't", "'ll", "12", "\u0345", "\u0482", "<|", "|>", "<|EndOfText|>", "a" * 70]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for full in (1 << 20, 300):  # a table that is emptied again and again
        monkeypatch.setattr(T, "CACHE", full)
        got = [ids[a:b].tolist() for _, _, ids, bounds in e.encode(pa.array(texts)) for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == want



def test_new_pieces_take_few_bytes():
    """A worker meets ever new words and holds up to CACHE of them; a dictionary of them takes about 200 bytes each."""
    import tracemalloc

    import public_tokenizers
    from wavemill.llm._tokenize import Encoder

    e, rng = Encoder(public_tokenizers.path("word_bpe_49k.json")), np.random.RandomState(3)
    words = ["".join(w) for w in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (60_000, 9))]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for i in range(0, len(words), 5000):
        for _ in e.encode(pa.array([" ".join(words[i : i + 5000])])):
            pass
    assert tracemalloc.get_traced_memory()[0] - before < 120 * len(words)
    tracemalloc.stop()


def test_packing(spark, docs, plain):
    import public_tokenizers
    from tokenizers import Tokenizer
    from wavemill.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    plain = [*plain, *SPECIAL]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([r[:2] for r in SPECIAL], "doc_id long, text string"))
    ids = {d: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for d, x, *_ in plain if d is not None}
    got = pack_documents(docs, path, 2, 512).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= 512
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all()
    repeats = Counter(d for d, *_ in plain)
    for d, g in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        assert g["length"].sum() == repeats[d] * len(ids[d]) and set(g["doc_tokens"]) == {len(ids[d])}
        for s, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True):
            assert c == zlib.crc32(ids[d][s : s + n].tobytes())
    sizes = got.groupby("sequence_id")["length"].sum()
    padding = sum(512 - n for n in sizes if n & (n - 1))  # lengths that are powers of two need none
    assert padding < 0.03 * sizes.sum()
    assert pack_documents(nasty.empty(spark), path, 2).count() == 0


def test_a_partition_is_packed_without_loss():
    """Every id of every document in one piece, few and many documents, and hardly any padding."""
    from wavemill.llm.packing import pack_partition

    rng = np.random.RandomState(0)
    for n, most in ((0, 1), (1, 1), (1, 9000), (3, 700), (200, 5000), (5000, 900)):
        docs = [(i, rng.randint(0, 1 << 31, rng.randint(1, most + 1)).astype("<u4").tobytes()) for i in range(n)]
        got = pd.DataFrame([r for part in pack_partition(iter(docs), 5, 4096, True) for r in part], columns=["doc", "start", "length", "crc", "tokens", "seq", "offset", "ids"])
        assert [b"".join(g.sort_values("start")["ids"]) for _, g in got.groupby("doc")] == [raw for _, raw in docs]
        assert (got["length"] == got["ids"].map(len) // 4).all() and (got["length"] > 0).all()
        sizes = got.groupby("seq")["length"].sum()
        assert sizes.index.tolist() == list(range(5, 5 + len(sizes))) and sizes.max() <= 4096 if n else got.empty
        assert sum(4096 - x for x in sizes if x & (x - 1)) <= 0.02 * sizes.sum()


def test_differencing_is_near_equal():
    from wavemill.llm.packing import deal, differencing

    rng = np.random.RandomState(0)
    sizes = rng.randint(1, 1025, 500).tolist()
    parts = differencing(sizes, 60)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(500)) and max(sums) - min(sums) < 60
    windows = deal(sizes, 4096)
    assert max(sum(sizes[i] for i in p) for p in windows) <= 4096 and len(windows) <= sum(sizes) / 4096 * 1.03 + 1
    assert deal([], 10) == [] and len(deal([10, 10, 10], 10)) == 3
    with pytest.raises(ValueError):
        deal([11], 10)


def test_warc(spark):
    import gzip

    from wavemill.llm.warc import parse_record, ranges, read_warc, write_warc

    big = "<p>" + "long é payload " * 20
    rows = [(i, f"http://a/{i}", big if i % 3 == 0 else f"<p>{i}</p>" + "y" * i * 40) for i in range(1, 40)]
    rows += [(50, None, None), (51, "http://b\r\nX: y", ""), (52, "http://c", "short"), (53, "http://d", "short"), (3, "http://a/3", big), (None, "http://n", big), (60, "u", "\x00\r\n\r\n" * 60_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, digest int, payload string").repartition(3)
    index = write_warc(pages)
    got = read_warc(index, with_payload=True).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    for r in got:
        h = next(x or "" for i, _, x in rows if i == r.page_id)
        first = min(i for i in groups[h] if i is not None)
        again = len(h.encode()) >= 100 and r.page_id != first
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", first) if again else ("response", None))
        assert r.payload == (None if again else h.encode())
    some = read_warc(index.where("page_id = 7"), with_payload=True).collect()
    assert len(some) == 1 and some[0].payload == rows[6][2].encode()
    one = index.orderBy("path", "offset").first()
    raw = open(one.path.removeprefix("file://"), "rb").read()
    assert raw[one.offset : one.offset + 2] == b"\x1f\x8b" and parse_record(gzip.decompress(raw[one.offset : one.offset + one.length]))[0]["WARC-Payload-Digest"] == f"sha256:{one.payload_digest}"
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == index.where(f"path = '{one.path}'").count()
    assert [(o, n, len(x)) for o, n, x in ranges([(0, 10), (10, 5), (10**6, 5)])] == [(0, 15, 2), (10**6, 5, 1)]
    assert read_warc(write_warc(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_tiling_is_greedy():
    from wavemill.llm import _words as U
    from wavemill.llm.decontamination import tiles

    h = U.Hasher(29)
    num = lambda s: U.mix(np.array([ord(c) for c in s], dtype=np.uint64))
    assert tiles(num("abcdefgh"), num("xxefghyyabcdzz"), 3, h) in ([(0, 8, 4), (4, 2, 4)], [(4, 2, 4), (0, 8, 4)])
    assert tiles(num("abcabc"), num("abc"), 3, h) == [(0, 0, 3)]
    assert tiles(num("ab"), num("ab"), 3, h) == []

    def naive(p, t, least):
        mp, mt, out = [0] * len(p), [0] * len(t), []
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and not mp[i + k] and not mt[j + k]:
                        k += 1
                    if k > best[0]:
                        best = (k, i, j)
            if best[0] < least:
                return sum(x[2] for x in out)
            out.append((best[1], best[2], best[0]))
            mp[best[1] : best[1] + best[0]] = [1] * best[0]
            mt[best[2] : best[2] + best[0]] = [1] * best[0]

    rng = np.random.RandomState(0)
    for _ in range(60):
        p, t = ("".join(rng.choice(list("abc"), rng.randint(1, n))) for n in (25, 40))
        got = tiles(num(p), num(t), 3, h)
        for a, b, n in got:
            assert p[a : a + n] == t[b : b + n]
        assert abs(sum(x[2] for x in got) - naive(p, t, 3)) <= 3


def test_decontamination(spark, docs):
    from wavemill.llm.decontamination import clean, contaminated

    rng = np.random.RandomState(0)
    item = [f"q{i}" for i in range(40)]
    turned = item[20:] + ["filler"] * 3 + item[:20]  # reordered
    half = item[:10] + [f"z{i}" for i in range(40)]
    extra = [(1000, "Begin " + " ".join(item).upper() + "! End"), (1001, " ".join(turned)), (1002, " ".join(half)), (1003, " ".join(rng.permutation(item)))]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (4, ""), (5, " ".join(item))], "item_id long, text string")
    for block in (1 << 20, 64):
        got = contaminated(rows, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1000, 1001) for i in (1, 5)}
        assert all(r.coverage == pytest.approx(1) for r in got)
        left = clean(rows, bench, block_bytes=block)
        assert left.count() == rows.count() - 2 and left.where("doc_id IN (1000, 1001)").count() == 0
    assert contaminated(nasty.empty(spark), bench).count() == 0
    assert contaminated(docs, bench.where("1 = 0")).count() == 0


def test_decontamination_short_items(spark):
    from wavemill.llm.decontamination import contaminated

    rows = spark.createDataFrame([(1, "Say too short, friend"), (2, "short too"), (3, "too, SHORT!"), (3, "too short too short"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "too short"), (7, "too short"), (8, "friend"), (9, "?!"), (10, "")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.coverage) for r in contaminated(rows, bench).collect())
    assert got == Counter({(1, 7, 1.0): 2, (3, 7, 1.0): 4, (1, 8, 1.0): 1})


def covered(item, text, least=5):
    """Tokens of the item under a tiling that marks the longest common run again and again."""
    free_p, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best, run = (0, 0, 0), [0] * (len(text) + 1)
        for i in range(len(item) - 1, -1, -1):
            new = [0] * (len(text) + 1)
            for j in range(len(text) - 1, -1, -1):
                if free_p[i] and free_t[j] and item[i] == text[j]:
                    new[j] = run[j + 1] + 1
                    best = max(best, (new[j], -i, -j))
            run = new
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return total
        total += n
        free_p[i : i + n], free_t[j : j + n] = [False] * n, [False] * n


def test_decontamination_against_brute_force(spark):
    """A whole table of documents with whole, cut, reordered and thinned items against a plain tiling of every pair."""
    from wavemill.llm.decontamination import contaminated

    rng = np.random.RandomState(5)
    words = [f"w{i}" for i in range(25)]
    items = [rng.choice(words, rng.randint(3, 26)).tolist() for _ in range(12)]
    rows = []
    for d in range(90):
        text = rng.choice(words, rng.randint(0, 30)).tolist()
        for _ in range(rng.randint(0, 3)):
            item = items[rng.randint(len(items))]
            cut = rng.randint(0, len(item))
            part = item[cut:] + ["sep"] * rng.randint(0, 2) + item[: rng.randint(0, cut + 1)]
            at = rng.randint(len(text) + 1)
            text[at:at] = part
        rows.append((d, text))
    want = {}
    for d, text in rows:
        for k, item in enumerate(items):
            share = covered(item, text, min(5, len(item))) / len(item)
            if share >= 0.5:
                want[d, k] = share
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in contaminated(docs, bench).collect()}
    assert len(want) > 40 and set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def toxic_tables(spark, n=600):
    rng = np.random.RandomState(0)
    docs, labels = [], []
    for i in range(n):
        w = rng.choice(nasty.WORDS, rng.randint(5, 60)).tolist()
        bad = i % 5 == 0
        if bad:
            w.insert(rng.randint(len(w)), rng.choice(["wretch", "GRUB!", "grubling", "grubster"]))
        docs.append((i, " ".join(w)))
        if i % 4 != 3:
            labels.append((i, int(bad)))
    labels += [(None, 1), (5, None), (99_999, 1), (0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs):
    from wavemill.llm.toxicity import toxicity

    d, labels = toxic_tables(spark)
    got = toxicity(d, labels).toPandas()
    bad = got["doc_id"] % 5 == 0
    held = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (held == got["held_out"]).all() and got["score"].between(0, 1).all()
    assert got["predicted"][bad].mean() > 0.9 and got["predicted"][~bad].mean() < 0.02
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    mixed = toxicity(docs, spark.createDataFrame([(1, 0), (2, 1), (3, 0), (20, 1), (21, 0), (22, 1)], "doc_id long, toxic int"))
    assert mixed.count() == docs.count() and mixed.where("score IS NULL").count() == 0
    assert toxicity(docs, labels.where("1 = 0")).agg({"score": "max"}).first()[0] < 1e-9
    assert toxicity(nasty.empty(spark), labels).count() == 0


def test_factors_learn_an_interaction():
    """Two terms that are toxic only together."""
    from wavemill.llm.toxicity import _raw, _squash, fit

    rng = np.random.RandomState(0)
    x = rng.uniform(size=(3000, 2)) < 0.5
    y = (x.all(axis=1)).astype(float)
    rows = [np.flatnonzero(r) for r in x]
    m = fit(np.arange(2, dtype=np.uint64), rows, y, epochs=60, l2=1e-5)
    s = [_squash(_raw(m, np.array([0, len(r)]), np.array(r, dtype=int)))[0] for r in ([], [0], [1], [0, 1])]
    assert s[3] > 0.7 and max(s[:3]) < 0.3


def test_toxicity_of_a_pair(spark):
    """Two frequent words of which each alone tells nothing, as a text is toxic when it has both or neither."""
    from wavemill.llm.toxicity import THRESHOLD, chosen_terms, score_documents, terms, train

    rng = np.random.RandomState(3)
    rows = []
    for i in range(4000):
        x, y = rng.uniform(size=2) < 0.5
        w = rng.choice(nasty.WORDS, rng.randint(5, 20)).tolist() + ["grub"] * int(x) + ["folk"] * int(y)
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(x == y)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    pair = {int(k) for _, _, _, h in terms(pa.array(["grub", "folk"])) for k in h.view(np.int64)}
    model = train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert pair <= set(model.keys.view(np.int64).tolist())
    got = score_documents(d, model).toPandas()
    held = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (((got["score"] >= 0.5) == (got["toxic"] == 1))[held]).mean() > 0.95
    keys, telling = chosen_terms(d.select(d.text.alias("_text"), d.toxic.alias("_y")), 4000, int(got["toxic"].sum()), 100)
    assert len(keys) == len(telling) and not telling[np.isin(keys.view(np.int64), list(pair))].any() and 0 < THRESHOLD < 1


def test_toxicity_sample_is_repeatable(spark):
    from wavemill.llm.toxicity import train

    d, labels = toxic_tables(spark, 400)
    a, b = train(d, labels, max_rows=60), train(d.repartition(7), labels.repartition(5), max_rows=60)
    assert len(a.keys) and (a.keys == b.keys).all() and a.w == pytest.approx(b.w) and a.v == pytest.approx(b.v)


def test_language_id(spark, docs):
    from wavemill.llm.language_id import identify, language_spans, train, viterbi

    rng = np.random.RandomState(0)
    vocabulary = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["zwölf", "größe", "straße", "wäre"], "cc": ["привет", "мир", "слово"]}
    rows = [(i, " ".join(rng.choice(vocabulary[k], 30)), k) for i in range(300) for k in [list(vocabulary)[i % 3]]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(d)
    got = identify(d, model).join(d, "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).all() and got["held_out"].any()
    known = docs.where("doc_id IS NOT NULL").distinct()
    odd = identify(known, model).toPandas().merge(known.select("doc_id", "text").toPandas(), on="doc_id")
    assert identify(docs, model).count() == docs.count()
    none = ~odd["text"].map(lambda t: bool(t) and any(c.isalpha() for c in t))
    assert (odd["lang_pred"][none] == "und").all() and (odd["lang_pred"][~none] != "und").all()
    assert odd["score"].between(0, 1).all()
    both = spark.createDataFrame([(1, "lorem ipsum dolor amet lorem zwölf größe straße wäre zwölf")], "doc_id long, text string")
    assert [(r.first_word, r.n_words, r.lang) for r in language_spans(both, model).orderBy("first_word").collect()] == [(0, 5, "aa"), (5, 5, "bb")]
    assert model.scripts.sum() == 3
    s = np.random.RandomState(1).randn(40, 3) * 2
    from itertools import product

    short = s[:6]
    best = max(product(range(3), repeat=6), key=lambda p: sum(short[i, c] for i, c in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])))
    assert viterbi(np.concatenate([short, s]), np.array([0, 6, 6, 46]), 1.5)[:6].tolist() == list(best)
    rng = np.random.RandomState(2)
    for n, states in ((37, 3), (200, 2), (401, 5)):  # a row in segments against the row as it is
        long = np.round(rng.randn(n, states) * 2, 3)
        worth = lambda p: long[np.arange(n), p].sum() - 1.5 * (np.diff(p) != 0).sum()  # noqa: B023, E731
        assert worth(viterbi(long, np.array([0, n]), 1.5, segment=8)) == pytest.approx(worth(viterbi(long, np.array([0, n]), 1.5)))
    many = np.zeros((3, 300))
    many[:, 200] = 1.0
    assert viterbi(many, np.array([0, 3]), 1.0).tolist() == [200] * 3  # more languages than a small number can count
    assert (identify(d, train(d.where("1 = 0"))).toPandas()["lang_pred"] == "und").all()
    assert identify(nasty.empty(spark), model).count() == 0


def test_missing_columns_are_named(spark):
    from wavemill.llm.exact_dedup import exact_dedup

    with pytest.raises(ValueError, match="text"):
        exact_dedup(spark.range(3).withColumnRenamed("id", "doc_id"))


def test_word_buffers():
    from wavemill.llm import _words as U

    column = pa.array(["a b", None, "", "  é\tx\n", "q" * 50])
    got = []
    for i, n, data, cuts in U.parts(column, most=8):
        s, e, b = U.words(data, cuts, ~U.SPACE[data])
        got += [[bytes(data[s[k] : e[k]]) for k in range(b[r], b[r + 1])] for r in range(n)]
        assert i == len(got) - n
    assert got == [(x or "").encode().split() for x in column.to_pylist()]
    h = U.Hasher(3)
    data = np.frombuffer(b"abcXXabc", np.uint8)
    one = h.spans(data, np.array([0, 5, 3]), np.array([3, 8, 5]))
    assert one[0] == one[1] != one[2]
    assert pd.Series(h.spans(np.frombuffer(np.random.RandomState(0).bytes(60_000), np.uint8), np.arange(0, 60_000, 6), np.arange(6, 60_001, 6))).is_unique


def test_id_and_text_columns_with_dots(spark):
    """Names that hold dots, for the operators that write files or pack."""
    import public_tokenizers
    from wavemill.llm.packing import pack_documents
    from wavemill.llm.token_output import encode_documents
    from wavemill.llm.warc import read_warc, write_warc

    df = spark.createDataFrame([(i, f"http://{i}", "text " * i, 1) for i in range(1, 5)], "`a.id` long, `b.url` string, `c.text` string, id int")
    tokens = encode_documents(df, public_tokenizers.path("byte_bpe_50k.json"), 0, "a.id", "c.text")
    assert tokens.columns == ["a.id", "start", "n_tokens", "ids_crc32"] and sorted(r["a.id"] for r in tokens.collect()) == [1, 2, 3, 4]
    packed = pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2, 64, "a.id", "c.text")
    assert packed.columns[0] == "a.id" and {r["a.id"] for r in packed.collect()} == {1, 2, 3, 4}
    assert sorted(r.page_id for r in read_warc(write_warc(df, "a.id", "b.url", "c.text")).collect()) == [1, 2, 3, 4]


def test_warc_hot_digest(spark):
    """A third of all pages is one error page: each refers to the first, and rows of one digest may be dealt over tasks."""
    from wavemill.llm.warc import _decided, read_warc, write_warc

    error = "<html>" + "not found " * 20 + "</html>"
    rows = [(i, f"http://x/{i}", error if i % 3 == 0 else f"<p>{i}</p>" * 30) for i in range(1, 301)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.refers_to for r in read_warc(write_warc(pages)).collect()}
    assert got == {i: 3 if i % 3 == 0 and i != 3 else None for i in range(1, 301)}
    plan = _decided(pages, "page_id", "url", "html")._jdf.queryExecution().optimizedPlan().toString()
    assert "_second" in plan


def test_differencing_against_plain_karmarkar_karp():
    """The same sums as the textbook's method with dense partitions, and the same parts of all items."""
    from wavemill.llm.packing import differencing

    def plain(sizes, k):
        parts = [([s, *[0] * (k - 1)], i) for i, s in enumerate(sizes)]
        count = len(parts)
        while len(parts) > 1:
            parts.sort(key=lambda p: (-(p[0][0] - p[0][-1]), p[1]))
            (a, _), (b, _) = parts[:2]
            parts = [*parts[2:], (sorted((x + y for x, y in zip(a, b[::-1])), reverse=True), count)]
            count += 1
        return parts[0][0]

    rng = np.random.RandomState(0)
    for n, k, most in ((8, 3, 20), (30, 4, 50), (40, 7, 9), (5, 5, 9), (60, 6, 1000)):
        sizes = rng.randint(1, most, n).tolist()
        parts = differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(n))
        sums = sorted((sum(sizes[i] for i in p) for p in parts), reverse=True)
        assert sums + [0] * (k - len(sums)) == plain(sizes, k)


def test_many_tiny_tasks_pack_without_padding(spark):
    """Tasks of less than a window have sequences of powers of two alone, and nothing is lost."""
    import public_tokenizers
    from wavemill.llm.packing import pack_documents

    df = spark.createDataFrame([(i, "some words here " * (i % 5 + 1)) for i in range(120)], "doc_id long, text string").repartition(40)
    got = pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), 2).toPandas()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert all(n & (n - 1) == 0 for n in sizes) and set(got["doc_id"]) == set(range(120))
    assert (got.groupby("doc_id")["length"].sum() == got.groupby("doc_id")["doc_tokens"].first()).all()


@pytest.mark.parametrize("bucket_rows,chunk", [(20_000, 10_000), (3, 2)])
def test_slots_of_the_sql(spark, docs, plain, monkeypatch, bucket_rows, chunk):
    """Many buckets and chunks give the slots of one; a row that is repeated often fills a row of slots."""
    import duckdb
    from wavemill.llm import oracles, sharding

    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(sharding, "CHUNK", chunk)
    hot = spark.createDataFrame([(5, "again", None, None, None)] * 45, nasty.SCHEMA)
    rows = docs.select("doc_id", "text").unionByName(hot.select("doc_id", "text"))
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in plain] + [5] * 45, dtype="Int64"), "text": [r[1] for r in plain] + ["again"] * 45})
    c = duckdb.connect()
    c.register("documents", documents)
    want = c.execute(oracles.SQL["op3_jump_sharding"]).fetchall()
    names = [x[0] for x in c.description]
    got = [tuple(r) for r in sharding.shard_documents(rows, 8).select(*names).collect()]
    assert Counter(got) == Counter(want)


def test_blocks_of_the_benchmark_are_one_scan(spark, docs, monkeypatch):
    """Many blocks, held against a few texts at a time, give the hits of one block, and documents are read once."""
    from wavemill.llm import decontamination as D

    rows = docs.select("doc_id", "text")
    bench = rows.where("length(text) BETWEEN 30 AND 2000").selectExpr("coalesce(doc_id, -1) AS item_id", "text")
    want = Counter((r.doc_id, r.item_id, round(r.coverage, 9)) for r in D.contaminated(rows, bench).collect())
    assert len(D.blocks(bench, "item_id", "text", 5, 0.5, 2000)) > 5
    monkeypatch.setattr(D, "HELD_BYTES", 1000)
    got = D.contaminated(rows, bench, block_bytes=2000)
    assert want and Counter((r.doc_id, r.item_id, round(r.coverage, 9)) for r in got.collect()) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    hit = {d for d, _, _ in want}
    named = rows.where("doc_id IS NOT NULL")
    left = D.clean(named, bench, block_bytes=2000).collect()
    assert Counter(tuple(r) for r in left) == Counter(tuple(r) for r in named.collect() if r.doc_id not in hit)
