"""Corpus pipeline: from raw documents to packed token sequences.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet
and read again as the next one's docs. All but the last keep the columns of
``documents``:

1. quality_rules: documents that a rule or their host's shrunk failure rate rejects go;
2. near_duplicates: of each component of five-word-shingle sets with Jaccard 0.8 or
   more, the document with the smallest id stays;
3. secrets: secrets become ``[SECRET]`` in the text, n_chars follows;
4. source_mix: documents repeat or go as the mix to source targets says;
5. packing: pieces of at most 2048 tokens with their place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvidex.llm import mixing, ngram_join, packing, quality_rules, secrets
from corvidex.plans.shared import written


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, join=ngram_join.Join(words=5, percent=80))


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("secrets", stage_secrets),
    ("source_mix", stage_mix),
    ("packing", stage_pack),
]

#: Tokenising and component search are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
