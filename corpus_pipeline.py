"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

1 quality      documents that the rules reject go; lines above the line limits are cut from the rest
2 near_dedup   of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays
3 substring    every byte covered by a 200-byte string that occurs elsewhere too is cut
4 decontam     words inside benchmark windows are cut; a document of nothing but such words goes
5 tokens       BPE encoding and decoding; returns doc_id, n_tokens, ids_sha256, decoded_sha256
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, decontam, minhash, quality, suffix
from lodestone.llm.common import work_dir
from lodestone.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs, by_rest=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one_row(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.clean(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs.select("doc_id", "text"), vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring", substring_stage),
    ("decontam", decontam_stage),
    ("tokens", tokens_stage),
]

#: Stages 2, 3 and 5 have no counterpart in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{work_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
