"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before kept and returns documents again;
the last returns token ids. Null texts and empty tables pass through as the operators say.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, line_templates, ngram_join, quality, sentencepiece_codec
from sparkloom.llm.common import table
from sparkloom.llm.queries import PIECES
from sparkloom.operators.graph import drop, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.apply_rules(docs).where("failed_rule is null").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across documents; n_chars follows the text."""
    out = line_templates.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the round trip and the comparison of both libraries."""
    return sentencepiece_codec.encode_texts(docs, PIECES)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)  # its only reader has been written
        before = path
    atexit.register(drop, spark, folder)
    return docs


#: Bands, walks and tokens are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None
