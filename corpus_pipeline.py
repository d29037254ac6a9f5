"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.

Defined results for odd input: a null or empty text fails the quality rules; a document
without an id is kept or dropped by its text alone and is near no other; rows alike in id
and text are one document after the second stage; unlike texts under one id stay apart,
but go together where their id is not the least of its group; an empty table gives an
empty table; further columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from formloom.llm.bpe import round_trip_digests
from formloom.llm.decontaminate import drop_contaminated
from formloom.llm.neardup import drop_near_duplicates
from formloom.llm.quality import clean_documents
from formloom.llm.secrets import redact_secrets
from formloom.llm.shared import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail are taken out of the texts, documents that the quality rules reject go."""
    return clean_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return redact_secrets(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids: counts and digests per document."""
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secret_stage),
    ("byte_bpe", encoding_stage),
]

#: The line rules, the network's findings and BPE are not expressible in SQL; tests/llm/test_pipeline.py holds each stage to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
