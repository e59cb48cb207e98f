import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewater.llm import bitslices

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return Counter(PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")))


def brute(docs, items, k=10):
    counts = [(d, found(t)) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    total, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in counts:
            m = 100 - 90 + (90 * n * total) // length
            s = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in found(text) if t in c
            )
            scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def texts(rng, count, longest):
    words = [f"{c}{i}" for i in range(25) for c in "aBé"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return ["; ".join(rng.choices(words, weights, k=rng.randrange(longest))) for _ in range(count)]


def test_matches_brute_force(spark):
    rng = random.Random(3)
    docs = list(enumerate(texts(rng, 150, 200) + texts(rng, 150, 12) + ["a0 b0 a1"] * 60 + [None, "", "_-"]))
    rng.shuffle(docs)
    items = list(enumerate(texts(rng, 20, 12) + [None, "", "unknown words", "a0 b0", "é0"]))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert result(bitslices.top_k(d, i)) == brute(docs, items)
    assert result(bitslices.top_k(d, i, k=3, group_items=4)) == brute(docs, items, 3)
    assert result(bitslices.top_k(d, i, k=1000, group_bytes=30)) == brute(docs, items, 1000)


def test_bounds_are_never_below_the_scores():
    rng = random.Random(5)
    counts = [c for c in map(bitslices.term_counts, texts(rng, 60, 90)) if c]
    entries = [bitslices.signature(c) for c in counts]
    places = sorted({t for c in counts for t in c})
    lengths = np.array([sum(c.values()) for c in counts])
    items = bitslices.Items([rng.sample(range(len(places)), 6) for _ in range(15)], places, [rng.randrange(5000) for _ in places], len(counts), int(lengths.sum()))
    tight = 0
    for width in (64, 4096):  # a signature far too narrow, and one that fits
        bounds = items.bounds(width, len(counts), lengths, bitslices.sliced(entries, width))
        scores = np.array([[items.score(i, c, int(n)) for c, n in zip(counts, lengths)] for i in range(15)])
        assert (bounds >= scores).all()
        tight = (bounds <= scores * 1.3).mean()
    assert tight > 0.8


def test_equal_texts_hand_on_the_smallest_keys():
    import pyarrow as pa

    keys, same = pa.array([9, None, 4, 7, 1, 5]), pa.array(list("aaaaab"))
    got = bitslices.smallest_of_equals(np.array([0] * 6 + [1]), np.array([0, 1, 2, 3, 4, 5, 1]), keys, same, 2)
    assert sorted(got) == [(0, 2), (0, 4), (0, 5), (1, 1)]


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("keys")
    items = [(1, "the CAT and a dog"), (1, "lorem"), (None, "ünïcode naïve 12345"), (2, None), (3, "a row")]
    i = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(bitslices.top_k(docs, i)) == brute(rows, items)
    none = docs.filter(F.lit(False))
    assert bitslices.top_k(none, i).count() == 0 and bitslices.top_k(docs, i.filter(F.lit(False))).count() == 0
    assert bitslices.top_k(none, i).columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark):
    from tidewater.llm.queries import op13_lexical

    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    got = result(op13_lexical(spark, SF_SMALL))
    assert got == brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
