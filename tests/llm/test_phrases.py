import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, at_least=10, top=2000, longest=3):
    """Rows ``(text, lang)`` counted phrase by phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    candidates = {p: a for p, a in f.items() if a >= at_least and len(p[1]) > 1}
    out = []
    for (lang, p), a in candidates.items():
        held = any(
            la == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (la, q), b in candidates.items()
        )
        if not held:
            score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


VOCABULARY = ["Alpha", "beta", "ÉTÉ", "été", "x", "y-z", "gamma", "\x01", "delta"]


def corpus(seed, texts=60):
    rng = random.Random(seed)
    joints = [" ", "  ", "\t", ". ", ",", " \n", "!\r\n", " ? "]
    weights = [30, 3, 3, 2, 2, 1, 1, 1]
    return [
        ("".join(rng.choice(VOCABULARY) + rng.choices(joints, weights)[0] for _ in range(rng.randrange(0, 80))), rng.choice(["en", "de", None]))
        for _ in range(texts)
    ]


@pytest.mark.parametrize("row_bytes", [phrases.ROW_BYTES, 40])
def test_matches_brute_force(spark, row_bytes):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert result(phrases.collocations(docs, row_bytes=row_bytes)) == brute(rows)
    assert result(phrases.collocations(docs, row_bytes=row_bytes, top=5, at_least=3)) == brute(rows, 3, 5)


def test_parts_of_a_language_rank_as_one(spark):
    """Few ranks out of many candidates, most of one language: the same as one ranking of all."""
    rows = [(t, "xx") for t, _ in corpus(9, 300)] + corpus(3, 20)
    docs = spark.createDataFrame(rows, "text string, lang string")
    for top in (1, 7):
        assert result(phrases.collocations(docs, at_least=2, top=top)) == brute(rows, 2, top)


def test_four_words(spark):
    rows = corpus(5, 80)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert result(phrases.collocations(docs, longest=4, at_least=4)) == brute(rows, 4, longest=4)


@pytest.mark.parametrize("bits", [4, 7])
def test_collisions_are_told_apart(spark, bits):
    """With fingerprints of a few bits nearly every phrase collides; the counts stay exact."""
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    assert result(phrases.collocations(docs, bits=bits, slot_bits=15)) == brute(rows)


def test_fingerprints_are_those_of_the_bytes():
    data = np.frombuffer(b"abc def abc def abcdef", np.uint8)
    start, end = np.array([0, 8, 4, 12, 16]), np.array([3, 11, 7, 15, 22])
    a, b, c, d, e = phrases.fingerprints(data, start, end, 1).tolist()
    assert a == b and c == d and len({a, c, e}) == 3
    one, two = (phrases.fingerprints(data, np.array([s]), np.array([s + 7]), 1, lang)[0] for s, lang in ((0, "en"), (8, "de")))
    assert one != two == phrases.fingerprints(data, np.array([0]), np.array([7]), 1, "de")[0]


def test_rows_keep_every_ngram():
    words = " ".join(f"w{i}" for i in range(400)).encode()
    for context in (1, 2):
        grams = []
        for data, tail in phrases.rows_of(b"a b\n" + words + b"\nz", 64, context):
            start, end, first, _ = phrases.grams(np.frombuffer(data, np.uint8), tail, context + 1)
            grams += [data[start[i] : end[i + context]] for i in first.tolist()]
        w = words.split()
        want = [b" ".join(w[i : i + context + 1]) for i in range(400 - context)] + [b"a b"] * (context == 1)
        assert sorted(grams) == sorted(want)


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("phrase")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert result(phrases.collocations(docs)) == brute(rows)
    assert phrases.collocations(docs.filter(F.lit(False))).count() == 0


def test_query(spark):
    from tidewater.llm.queries import op11_phrases

    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(op11_phrases(spark, SF_SMALL)) == brute(rows)


def test_products_beyond_64_bits(spark):
    from pyspark.sql.types import LongType

    wide = spark.sql("""select (cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0)))
        div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0)) s
        from values (3000000000000L, 7000000000001L, 9000000000007L) t(a, l, r)""")
    assert wide.schema["s"].dataType == LongType()
    assert wide.first().s == 10**6 * 3000000000000**2 // (7000000000001 * 9000000000007)
