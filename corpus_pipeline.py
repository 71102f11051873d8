"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage keeps the columns of documents but the last, which adds what the mix takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockhist.llm import decontaminate, language, minhash, mixing, pii
from blockhist.llm.names import table
from blockhist.session import scratch_path

#: A document is rejected if no language reaches this score.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; texts that are null or hold no letters go."""
    judged = language.identify(docs, language.train(docs))
    verdict = F.col(judged.columns[-1])
    return judged.where((verdict["lang"] != "und") & (verdict["score"] >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their texts."""
    return pii.redact_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes words of, with size, source_size, target and taken."""
    mixed = mixing.mix_sources(docs)
    mix = F.col(mixed.columns[-1])
    return mixed.where(mix["taken"] > 0).select(*docs.columns, *[mix[c].alias(c) for c in ("size", "source_size", "target", "taken")])


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("source_mix", source_mix)]

#: SQL cannot state the stages (a trained model, minima of hashes, a seeded order).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex[:8]}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
