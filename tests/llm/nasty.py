"""Small tables that hold every awkward case."""

import random

WORDS = ["the", "of", "and", "stone", "river", "Größe", "été", "niño", "word", "cloud", "seven", "lamp", "to", "a", "light", "door", "paper", "green"]
EXTRA = {"id": "x", "key": 7, "h": 1, "text_": None, "score": 0.5, "class_id": 3, "kept": False, "digest": b"d", "k": 2, "word": 9, "bits": 1, "n": 4, "held_out": True}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows(seed=0):
    """(doc_id, text, lang, source, n_chars)."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    long = prose(rng, 60_000)
    texts = [None, "", " ", "\n\t", "one", "!!! ???", "12 34", "A a A", "a A a", "Ａ", "日本語のテキスト です", "привет мир", "x" * 20_000, long, long, *base, *base[:6], base[0].upper(), base[1] + " tail", "lead " + base[2]]
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + "\n" + shared + "\n" + prose(rng, 20) for _ in range(4)] + [shared, "  " + shared.replace(" ", "  ") + " "]
    big = prose(rng, 200).split()
    for i in range(6):
        copy = list(big)
        copy[10 * i + 3] = "changed"
        texts.append(" ".join(copy))
    out = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[20], out[20], out[0]]  # repeated rows
    out += [(None, base[3], None, None, None), (None, None, None, None, None)]
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, seed=0, extra=True):
    df = spark.createDataFrame(rows(seed), SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(v) for c, v in EXTRA.items()})
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
