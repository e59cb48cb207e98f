"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidewater.llm import (
    bitslices, decontam, hpy, langid, mixing, oddsketch, phrases, quality, quotes, simhash, tokenbin, topk, toxicity,
)
from tidewater.llm.common import fold, shared_folder, table

TOKENIZER = "byte_bpe_50k.json"
#: Target weights of the mix; sources without one share the rest in proportion to their sizes.
MIX_WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.05}
MIX_SEED = 7


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.train(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, samples, F.col("doc_id"))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    scored = quality.score(docs, model, F.col("doc_id"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) == 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(fold(F.col("doc_id"), 4) != 2))
    scored = toxicity.score(docs, model, F.col("doc_id"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), F.col("doc_id"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED, copy="copy")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "tokens")
    tokenbin.write_token_files(table(spark, sf_dir, "documents"), out, TOKENIZER, end_id=0)
    return tokenbin.read_token_files(spark, out)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=3, at_least=10, top=2000)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslices.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_lm_score": op3_lm_score,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_mix": op6_mix,
    "op7_token_files": op7_token_files,
    "op8_simhash": op8_simhash,
    "op9_topk": op9_topk,
    "op10_chat": op10_chat,
    "op11_phrases": op11_phrases,
    "op12_minhash": op12_minhash,
    "op13_lexical": op13_lexical,
}

ORACLES: dict[str, str] = {
    "op6_mix": mixing.oracle(MIX_WEIGHTS, MIX_SEED),
    "op9_topk": topk.oracle(),
    "op11_phrases": phrases.oracle(),
    "op13_lexical": bitslices.oracle(),
}
