"""The evidence graph: typed edges between nodes of several kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import TRUSTED_CLASSES


def touching(edges: DataFrame, seeds: DataFrame, trusted: bool = True) -> DataFrame:
    """Edges with a seed at either end and the far end as (far_type, far_id).

    An OR of two equalities would need a nested loop; it is the union of two equi joins, edges at two seeds once.
    seeds: (node_type, node_id). edges: source_type, source_id, target_type, target_id, edge_id, ...
    """
    e = edges.where(F.col("assertion_class").isin(*TRUSTED_CLASSES)) if trusted else edges
    s = seeds.select("node_type", "node_id").distinct()
    out = e.join(s.toDF("source_type", "source_id"), ["source_type", "source_id"]).withColumns({"far_type": F.col("target_type"), "far_id": F.col("target_id")})
    into = e.join(s.toDF("target_type", "target_id"), ["target_type", "target_id"]).withColumns({"far_type": F.col("source_type"), "far_id": F.col("source_id")})
    return out.unionByName(into.select(*out.columns)).dropDuplicates(["edge_id", "far_type", "far_id"])


def far_ends(edges: DataFrame, seeds: DataFrame, limit: int, trusted: bool = True) -> DataFrame:
    """The best ``limit`` touching edges, then without far ends that are seeds themselves."""
    met = touching(edges, seeds, trusted).orderBy(F.desc_nulls_last("confidence"), "edge_id", "far_type", "far_id").limit(limit)
    s = seeds.select(F.col("node_type").alias("far_type"), F.col("node_id").alias("far_id")).distinct()
    return met.join(s, ["far_type", "far_id"], "left_anti")


def path_text() -> F.Column:  # type: ignore[name-defined]
    return F.format_string("edge %s (%.2f) %s -> %s", "edge_type", F.col("confidence").cast("double"), "source_id", "target_id")


def walk(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node_type, node_id, hops): nodes reached from the seeds in at most ``hops`` steps, either direction.

    Both directions of an edge come from one pass over the edges, one pass for each hop.
    """
    end = lambda side: F.struct(F.col(f"{side}_type").alias("t"), F.col(f"{side}_id").alias("i"))
    ways = edges.select(F.explode(F.array(F.struct(end("source").alias("near"), end("target").alias("far")), F.struct(end("target").alias("near"), end("source").alias("far")))).alias("w"))
    ways = ways.select(F.col("w.near.t").alias("node_type"), F.col("w.near.i").alias("node_id"), F.col("w.far.t").alias("far_type"), F.col("w.far.i").alias("far_id"))
    reached = seeds.select("node_type", "node_id").distinct().withColumn("hops", F.lit(0))
    front = reached
    for h in range(1, hops + 1):
        far = ways.join(front.select("node_type", "node_id"), ["node_type", "node_id"], "left_semi").select(F.col("far_type").alias("node_type"), F.col("far_id").alias("node_id")).distinct()
        front = far.join(reached.select("node_type", "node_id"), ["node_type", "node_id"], "left_anti").withColumn("hops", F.lit(h))
        reached = reached.unionByName(front)
    return reached


def edge_fingerprint(tenant: str = "tenant", version: str = "v1") -> F.Column:  # type: ignore[name-defined]
    return F.sha2(F.concat_ws("|", F.lit(version), tenant, "source_type", "source_id", "edge_type", "target_type", "target_id"), 256)
