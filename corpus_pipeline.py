"""From documents to token ids: quality, near duplicates, benchmark passages, personal data, encoding.

Every stage takes ``(spark, docs, sf_dir)`` and gives the rows that stay, with the columns of
``documents``; the last one gives token ids. Between stages the rows are written as Parquet and read
again, so a stage never runs twice and a lost executor costs the tasks it had.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.lineage import step_path
from kinweave.llm import bpe, decontaminate, near_dup, pii, quality
from kinweave.llm.common import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learned from the labelled ones among them, does not reject."""
    held_out = quality.fold(F.col("doc_id"), 4) == 2
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.keep_good(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, similarity 0.8."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of ten words of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and the length brought up to date."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them again."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("encoding", encoded),
]
#: A learned model and a tokenizer are among the stages: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents at ``sf_dir``: the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = step_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
