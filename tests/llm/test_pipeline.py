import inspect

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidewater.llm import decontam, mixing, toxicity
from tidewater.llm.common import fold, written
from tests.conftest import SF_SMALL
from tests.llm import helpers
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_mixing import draw
from tests.llm.test_tokenbin import expected as encoded


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output on a small table."""
    docs, found = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = written(stage(spark, docs, SF_SMALL), name)
        found[name] = (docs, out)
        docs = out
    return found


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_shape(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in cp.STAGES)
    for name, (docs, out) in stages.items():
        assert out.columns == (docs.columns if name != "token_ids" else ["doc_id", "start", "n_tokens", "ids_crc32"])


def test_toxicity_stage(spark, stages):
    docs, out = stages["toxicity"]
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").filter(fold(F.col("doc_id"), 4) != 2)
    scores = toxicity.score(docs, toxicity.train(docs, labels), F.col("doc_id")).collect()
    assert {d for d, _ in rows(out)} == {r.doc_id for r in scores if r.score < 0.3}


def test_near_duplicate_stage(stages):
    docs, out = map(rows, stages["near_duplicates"])
    fp = [helpers.simhash(t) for _, t in docs]
    root = helpers.groups(len(docs), lambda i, j: bin(fp[i] ^ fp[j]).count("1") <= 3)
    want = {r: min(docs[i][0] for i in range(len(docs)) if root[i] == r) for r in set(root)}
    assert sorted(d for d, _ in out) == sorted(want.values())


def test_decontamination_stage(spark, stages):
    docs, out = map(rows, stages["decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert {d for d, _ in out} == {d for d, _ in docs} - {d for d, _ in contaminated(items, docs)}


def test_mixing_stage(stages):
    docs, out = stages["mixing"]
    named, rest = mixing.rates(docs, cp.MIX_WEIGHTS)
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(got.get(r.doc_id, 0) == draw(cp.MIX_SEED, r.doc_id, named.get(r.source, rest)) for r in docs.collect())


def test_token_stage(stages):
    docs, out = stages["token_ids"]
    assert sorted(tuple(r) for r in out.collect()) == encoded(rows(docs))


def test_run_and_edge_rows(spark, edge_docs, tmp_path):
    names = cp.DOCUMENT_COLUMNS
    folder = str(tmp_path / "tables")
    edge_docs().select(*names).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "some item that is in no text at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False))
    for _, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0
