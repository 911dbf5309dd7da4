"""First-per-key, top-k, rank streams and their fusion."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import RRF_K, priority_boost


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key by a total order (DISTINCT ON, LATERAL ... LIMIT n)."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stream(df: DataFrame, name: str, order: Sequence[Column], limit: int, key: str = "object_id") -> DataFrame:
    """(key, stream, rank, ...): the first ``limit`` candidates of a stream with their ranks from 1.

    The limit comes first, so only ``limit`` rows meet in the window that numbers them.
    """
    rows = df.orderBy(*order).limit(limit)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("stream", F.lit(name))


def fuse(streams: Sequence[DataFrame], weights: dict[str, float], key: str = "object_id", k: int = RRF_K, query: Sequence[str] = ()) -> DataFrame:
    """Weighted reciprocal rank fusion: the sum of weight / (k + rank) over the streams that hold an object.

    Attributes come from the object's first appearance, streams in the order of ``weights``. ``query`` names
    columns that identify the query in batched retrieval.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    order = {s: i for i, s in enumerate(weights)}
    weight = F.create_map(*[x for s, w in weights.items() for x in (F.lit(s), F.lit(w))])
    number = F.create_map(*[x for s, i in order.items() for x in (F.lit(s), F.lit(i))])
    others = [c for c in rows.columns if c not in (key, "stream", "rank", *query)]
    place = F.struct(number[F.col("stream")], F.col("rank"))
    scored = rows.withColumn("_s", weight[F.col("stream")] / (k + F.col("rank")))
    out = scored.groupBy(*query, key).agg(
        F.sum("_s").alias("raw_score"),
        F.min(place).alias("_place"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", "_s")))).alias("scores"),
        F.min_by(F.struct(*others), place).alias("_first") if others else F.lit(None).alias("_first"),
    )
    out = out.select(*query, key, "raw_score", "scores", "_place", *([f"_first.{c}" for c in others] if others else []))
    boost = priority_boost("priority") if "priority" in others else F.lit(1.0)
    return out.withColumn("total_score", F.col("raw_score") * boost)


def ranked(fused: DataFrame, limit: int, score: str = "total_score") -> DataFrame:
    """Best first; equal scores keep the order of first appearance."""
    return fused.orderBy(F.desc(score), "_place").limit(limit).drop("_place")


def rerank_score(total: Column, f: dict[str, Column]) -> Column:
    """The fused score plus small amounts for each retrieval feature (0 to 1 each)."""
    weights = {"entity": 0.050, "scope": 0.040, "predicate": 0.035, "answer": 0.030, "evidence": 0.025, "graph": 0.020, "time": 0.015, "confidence": 0.010, "priority": 0.005}
    return reduce(lambda a, n: a + weights[n] * f[n], f, total)


def nearest_rank(df: DataFrame, value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(share * n). Nulls do not count.

    Equal values are counted first; a running sum over a key's distinct values then passes each rank, so no key is an array.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    by = Window.partitionBy(*(keys or [F.lit(0)]))
    d = counted.withColumns({"_to": F.sum("_c").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(by)})
    at = lambda p: F.min(F.when(F.col("_to") >= F.greatest(F.lit(1), F.ceil(F.col("_n") * p)), F.col("_v")))
    return d.groupBy(*keys).agg(F.max("_n").alias("n"), *[at(p).alias(f"p{int(p * 100)}") for p in shares])
