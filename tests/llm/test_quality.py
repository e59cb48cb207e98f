import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import quality
from tests.conftest import SF_CHECK


def test_features_match_brute_force():
    texts = [b"the cat cat", b"", b"\n x", "naïve  text".encode()]
    for owners, parts in quality.byte_runs(texts, quality.LEAD):
        got = [[] for _ in parts]
        for at, part in quality.features(parts):
            for a, p in zip(at.tolist(), part.tolist()):
                got[p].append(a)
    one = (1 << 64) - 1
    base = int(quality.BASE)

    def bucket(h, kind):
        return ((h + kind) * int(quality.SPREAD) & one) >> (64 - quality.BITS)

    for t, found in zip(texts, got):
        led = b" " * quality.LEAD + t
        want = []
        for n in quality.GRAMS:
            for i in range(quality.LEAD, len(led)):
                gram = led[i - n + 1 : i + 1]
                want.append(bucket(sum((gram[-1 - k] + 1) * pow(base, k, 1 << 64) for k in range(n)) & one, n))
        words = [sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(w)) & one for w in t.split()]
        want += [bucket(w, 0) for w in words] + [bucket((b - a) & one, 1) for a, b in zip(words, words[1:])]
        assert sorted(found) == sorted(want)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.filter("doc_id % 3 <> 1"))
    got = quality.score(docs, model, F.col("doc_id")).join(labels, "doc_id").filter("doc_id % 3 = 1").collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.9


def test_edge_rows(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 1), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    docs = edge_docs("score")
    model = quality.train(docs, labels)
    got = quality.score(docs, model, F.col("doc_id"), F.col("score").alias("theirs")).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1 and len({r.score for r in got if r.doc_id == 2}) == 1
    assert quality.score(docs.filter(F.lit(False)), model).count() == 0
    untrained = quality.train(docs, labels.filter(F.lit(False)))
    assert {r.score for r in quality.score(docs, untrained).collect()} == {0.5}


def test_whole_texts_are_scored():
    table = np.zeros(1 << quality.BITS, np.float32)
    text = b"abcd " * 300_000  # above one run
    (at, share), n = quality.counted(text), 0
    for _, parts in quality.byte_runs([text], quality.LEAD):
        n += sum(len(b) for b, _ in quality.features(parts))
    assert abs(share.sum() - 1) < 1e-9 and n >= len(text) * 3 + 300_000
    table[at] = 1
    assert np.isclose(quality.logits([text], table, 0.0)[0], 1.0)
