"""Retrieval and extraction metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_metrics(found: Column, wanted: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two sets; two empty sets agree, one empty set scores 0."""
    hit, n, m = F.size(F.array_intersect(found, wanted)), F.size(found), F.size(wanted)
    both = (n == 0) & (m == 0)
    p = F.when(both, 1.0).when(n == 0, 0.0).otherwise(hit / n)
    r = F.when(both, 1.0).when(m == 0, 0.0).otherwise(hit / m)
    return {"precision": p, "recall": r, "f1": F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))}


def relevance(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Share of queries with a result among the first ``k`` of an expected type whose title contains the expected text.

    results: (query_id, rank, object_type, title); expected: (query_id, object_type, title_contains).
    """
    e = expected.select("query_id", F.col("object_type").alias("want"), "title_contains")
    met = e.join(results.where(F.col("rank") <= k), "query_id", "left")
    ok = (F.col("object_type") == F.col("want")) & F.contains(F.lower("title"), F.lower("title_contains"))
    per_query = met.groupBy("query_id").agg(F.max(F.coalesce(ok, F.lit(False)).cast("int")).alias("hit"))
    return per_query.agg(F.count("*").alias("queries"), F.sum("hit").alias("hits"), F.avg("hit").alias("relevance"))


def scope_leaks(results: DataFrame, forbidden_prefix: str, forbidden_ids: list[str]) -> Column:
    bad = F.coalesce(F.col("scope_path").startswith(forbidden_prefix), F.lit(False))
    return F.count_if(bad | F.col("object_id").isin(*forbidden_ids)) if forbidden_ids else F.count_if(bad)


def shadow_verdict(runs: DataFrame) -> DataFrame:
    """Rates of useful, bad and truncated recalls, and whether they pass (at least 0.7, below 0.1, below 0.25)."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    d = runs.agg(F.count("*").alias("n"), rate("useful").alias("useful"), rate("bad").alias("bad"), rate("truncated").alias("truncated"))
    return d.withColumn("passed", (F.col("useful") >= 0.7) & (F.col("bad") < 0.1) & (F.col("truncated") < 0.25))
