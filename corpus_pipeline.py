"""The corpus pipeline: five stages from ``documents`` to token-ID files.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``; the last returns one row per
document of the written files (``doc_id, start, n_tokens, ids_crc32``).

Rows with nulls, empty and very long texts, repeated rows and empty tables
take the result that each operator's docstring defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontam, mixing, simhash, tokenbin, toxicity
from tidewater.llm.common import DOCUMENT_COLUMNS, fold, shared_folder, table, written
from tidewater.llm.queries import MIX_SEED, MIX_WEIGHTS, TOKENIZER

TOXIC_FROM = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go."""
    labels = table(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2)
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels), TOXIC_FROM).select(*DOCUMENT_COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=3).select(*DOCUMENT_COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold question and answer of a test item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights and shuffled globally."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*DOCUMENT_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in flat files, read back from them."""
    out = shared_folder(spark, "tokens")
    tokenbin.write_token_files(docs, out, TOKENIZER, end_id=0)
    return tokenbin.read_token_files(spark, out)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: The first stage's model cannot be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
