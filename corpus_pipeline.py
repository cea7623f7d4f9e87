"""A corpus pipeline: each stage calls one operator, is written as Parquet and read again as the next one's input.

language: documents in no known language (without any letter) go. near_duplicates: one document of each group stays,
that with the smallest doc_id. decontamination: documents that hold too much of a benchmark go. personal_data: personal
data is masked. packing: what is left becomes sequences of token ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from airledger.llm import decontaminate, language, packing, pii, simhash
from airledger.llm.common import remainder, shared_dir, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Likeness of SpotSigs signature sets from which documents are near copies. In these corpora nearly all pairs whose sets
#: of five-word shingles have a likeness of 0.8 reach it.
LIKENESS = 0.75


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return language.keep_identified(docs, language.learn(docs, remainder("doc_id", 4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by SimHash and, for those that differ in more bits, SpotSigs."""
    return simhash.keep_one(docs, simhash.near_copies(docs, LIKENESS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them masked."""
    return pii.redact(docs, pii.learn(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 token ids, with the ids and their CRC-32."""
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learned stages nor the tokenizer; tests/llm compares each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; the result is the last stage's."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/airledger-llm/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
