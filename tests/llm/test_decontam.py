import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontam
from tests.conftest import SF_SMALL


def index_of(items):
    segments = [(i, w) for i, (_, t) in enumerate(items) for w in decontam.segments_of(decontam.words(t))]
    n = Counter(t for _, w in segments for t in set(w))
    return decontam.Index(items, segments, n, len(segments), np.mean([len(w) for _, w in segments]))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(2)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, ". ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) for _ in range(3)) + ".") for i in range(150)]


def test_block_max_wand_finds_all_above_threshold(items):
    index, rng = index_of(items), random.Random(3)
    for _ in range(300):
        text = " ".join(t for _, t in rng.sample(items, 2)).split()
        at = rng.randrange(len(text))
        terms = sorted({index.number[w] for w in decontam.words(" ".join(text[at : at + 40])) if w in index.number})
        scores = Counter()
        for t in terms:
            for s, x in zip(index.segments[t], index.impacts[t]):
                scores[s] += x
        for threshold in (0.05, 0.3, 0.7, 0.95):
            want = {s: x for s, x in scores.items() if x >= threshold}
            got = index.search(terms, threshold)
            assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def brute(items, texts):
    out = []
    for key, text in texts:
        w = decontam.words(text)
        for item, t in items:
            if t is None or not decontam.words(t):
                continue
            shares = []
            for part in decontam.question_answer(t):
                n = min(5, len(part))
                have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
                wanted = decontam.shingles(part)
                shares.append(sum(s in have for s in wanted) / len(wanted) if wanted else 1.0)
            if min(shares) >= 0.8:
                out.append((key, item))
    return sorted(out, key=str)


def test_matches_equal_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    leaked = items.limit(5).select((F.col("item_id") + 10**6).alias("doc_id"), F.concat(F.lit("Before. "), F.upper("text"), F.lit(" after")).alias("text"))
    docs = docs.select("doc_id", "text").union(leaked)
    want = brute([tuple(r) for r in items.select("item_id", "text").collect()], [tuple(r) for r in docs.collect()])
    assert len(want) >= 5
    for block in (decontam.BLOCK_BYTES, 1500):  # one block and several
        got = [(r.doc_id, r.item_id) for r in decontam.matched(docs, items, F.col("doc_id"), block_bytes=block).collect()]
        assert sorted(got, key=str) == want
        left = {r.doc_id for r in decontam.drop_contaminated(docs, items, block_bytes=block).collect()}
        assert left == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edge_rows(spark, edge_docs):
    docs = edge_docs("item_id")
    items = spark.createDataFrame(
        [(1, "The cat sat on the mat. And looked at the dog."), (2, None), (3, ""), (4, " . "), (5, "nothing like any of these words here"),
         (5, "The cat sat on the mat. And looked at the dog.")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.matched(docs, items, F.col("doc_id")).collect())
    assert got == [(1, 1), (1, 5), (2, 1), (2, 1), (2, 5), (2, 5)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 8
    none = items.filter(F.lit(False))
    assert decontam.matched(docs, none, F.col("doc_id")).count() == 0 and decontam.drop_contaminated(docs, none).count() == 11
    assert decontam.matched(docs.filter(F.lit(False)), items, F.col("doc_id")).count() == 0


def test_leak_at_the_end_of_a_long_text(items):
    index = index_of(items)
    text = "filler words without meaning " * 20_000 + items[7][1]
    assert [m[0] for m in index.matches(text)] == [items[7][0]]


def test_question_and_answer_far_apart(spark):
    """In either order, in pieces, and with a missing part, as brute force has it."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    texts, far = [], "filler words of no item whatever " * 60
    for key, text in items:
        q, a = (" ".join(p) for p in decontam.question_answer(text))
        w = q.split()
        pieces = far.join(" ".join(w[i : i + 9]) for i in range(0, max(1, len(w) - 4), 5))
        texts += [((key, "apart"), f"{q} {far} {a}"), ((key, "turned"), f"{far} {a} {far} {q}"), ((key, "pieces"), f"{a} {far} {pieces}"), ((key, "half"), f"{far} {q}")]
    index = index_of(items)
    got = sorted(((k, m[0]) for (k, _), found in zip(texts, index.all_matches([t for _, t in texts])) for m in found), key=str)
    assert got == brute(items, texts) and len(got) >= 3 * len(items)
    assert all(0 <= m[1] <= 1 + 1e-9 for found in index.all_matches([t for _, t in texts]) for m in found)
