"""A corpus pipeline of five stages: quality, repeated lines, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and
returns a DataFrame; between stages the documents are written as Parquet and read
again. All but the last return the columns of documents; n_chars follows the text.

Cases: null, empty and blank texts are judged by the classifier like any other and, if
kept, go on as empty ones; very long texts go through whole; rows that repeat a doc_id are
judged alike and stay together; ties go to the smallest doc_id; an empty table gives no
pieces; extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import line_dedup, near_dedup, packing, quality_classifier, secret_scan
from siltstone.llm.shared import scratch

#: A file of the installed package of public tokenizers.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    rules = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, rules)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds."""
    return line_dedup.drop_repeated(docs, counts=False)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    return secret_scan.redact(docs, secret_scan.train(words=secret_scan.corpus_words(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences, with their ids."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", drop_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]
#: Rules fitted to labels, exact similarity components and BPE are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
