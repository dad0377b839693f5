"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Rows with null or empty text fail the quality rules and go.  Rows without doc_id cannot be named: they stay through the near
duplicates and are judged by their texts elsewhere.  Rows that repeat a doc_id are one document: they stay or go together, and
of a group of near copies the smallest doc_id stays.  Columns besides doc_id and text are carried to the last stage, whatever
their names; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe_codec, common, decontaminate, jaccard_join, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands; the others go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard_join.keep_one(docs, k=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; the others go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and disclosing terms generalised in their texts."""
    return pii.sanitise(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with digests of both directions: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return bpe_codec.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("BPE encoding and decoding", encoded),
]

#: None of the verdicts (compression ratios, edit distances, token ids) is within SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            common.discard(done)
    return docs
