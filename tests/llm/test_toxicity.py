import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    syllables = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti"]
    bad = ["zorgblat", "vexmuk", "quizhump", "drombow"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    docs, labels = corpus
    return toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))


def test_held_out_accuracy(corpus, model):
    docs, labels = corpus
    got = toxicity.score(docs, model, F.col("doc_id")).join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.3) == r.toxic for r in got]) > 0.97


def test_drop_toxic_keeps_columns_and_clean_rows(corpus, model):
    docs, labels = corpus
    wide = docs.withColumn("score", F.lit("theirs")).withColumn("row", F.lit(1))
    kept = toxicity.drop_toxic(wide, model)
    assert kept.columns == wide.columns
    left = kept.join(labels, "doc_id").groupBy("toxic").count().collect()
    counts = {r.toxic: r["count"] for r in left}
    assert counts[0] > 0.98 * 771 and counts.get(1, 0) < 0.1 * 129


def test_edge_rows(spark, edge_docs, model):
    got = toxicity.score(edge_docs("score"), model, F.col("doc_id"), F.col("score").alias("theirs")).collect()
    assert len(got) == 11
    empty = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert empty == {model.lowest}
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert toxicity.score(edge_docs().filter(F.lit(False)), model).count() == 0


def test_long_text_is_read_to_its_end(model):
    clean = "the eder " * 40_000
    assert model.score(clean + "zorgblat vexmuk") > model.score(clean)


def test_without_both_labels(spark, corpus):
    docs, labels = corpus
    none = toxicity.train(docs, labels.filter(F.lit(False)))
    only = toxicity.train(docs, labels.filter("toxic = 1"))
    assert none.score("the eder") == 0.0 and only.score("the eder") == 1.0
