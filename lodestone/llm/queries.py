"""The registered queries of the training-data operators: op<N>_<name>(spark, sf_dir).

Each applies its operator to the whole table and derives the columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, html_text, langid, minhash, oracles, quality, resample, sharding, substring, suffix, tokens, warc
from .common import work_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """Path of the byte-level BPE vocabulary used by the queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(langid.training_rows(docs, ~held_out))
    return langid.identify(docs.select("doc_id", "text"), model).withColumn("held_out", held_out)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("found", ","), 256).alias("items_sha256")
    return d.select("doc_id", "n_words", "n_hit", F.size("found").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark)
    pages = _table(spark, sf_dir, "pages")
    # Ranges smaller than the archives, so that records are found from the middle of a file at every size.
    d = warc.read_warc(warc.write_warc(pages, path), path, split_bytes=1 << 20, payload=False)
    page_id = lambda c, null: F.when(~F.col(null), F.col(c)).cast(pages.schema["page_id"].dataType).alias(c)
    return d.select(page_id("record_id", "null_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to", "null_refers"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = lambda d: d.select("h1", "h2", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return substring.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"), per_text=digests)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = lambda d: d.select("h1", "h2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return suffix.dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"), per_text=digests)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_language_id, op2_quality_rules, op3_decontamination, op4_near_dedup, op5_sharding, op6_warc, op7_html_text, op8_bpe, op9_substring_dedup, op10_suffix_array_dedup,
    op11_token_counts, op12_source_divergence, op13_importance_resampling,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}

ORACLE: dict[str, str] = dict(oracles.ORACLE)
