"""Revisions that memories call for, found in one scan, and merges that unite their support.

Five kinds are proposed: created, enriched, merged, demoted, retired; a memory may call for several, in that order of
precedence. Merges name the memory that stays; chains of merges end at one memory, found by jumping along them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge, ranking
from .written import written

#: Kinds with their precedence, limits of the rules, and who proposes. Fixed values.
ORDER = {"created": 10, "enriched": 20, "merged": 30, "demoted": 40, "retired": 50}
SUPPORTED, SHORT, STALE_MONTHS, SETTLED_DAYS = 2, 220, 6, 7
MODEL, PROMPT = "deterministic-revision-planner", "revise-memories-v1"
REASONS = {
    "created": "Promote high-support draft memory through review before durable publication.",
    "enriched": "Refresh narrative with current support and contradiction counts.",
    "demoted": "Published memory has stale or missing support; demote to draft for review.",
    "retired": "Contradictions exceed support; retire after review.",
}


def proposals(memories: DataFrame, support: DataFrame, facts: DataFrame, now: Column, scope: str | None = None, limit: int | None = None) -> DataFrame:
    """(memory_id, revision_type, derived_class, title, old_narrative, new_narrative, change_reason, fact_id, episode_id, keeper, precedence).

    ``support`` has (memory_id, fact_id, episode_id, created_at); its earliest row goes with the proposal. A memory that a
    fact of priority 1 supports is not demoted. ``limit`` takes the first by precedence, title and id, as a report.
    """
    m = memories if scope is None else memories.where(F.coalesce("scope_path", F.lit("")).startswith(scope))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    titled = F.col("title").isNotNull()
    spread = F.when(~titled, F.xxhash64("memory_id"))  # rows without title are nobody's copies
    same = Window.partitionBy(F.lower("title"), F.coalesce("scope_path", F.lit("")), spread)
    best = same.orderBy(F.desc_nulls_last("support_count"), F.desc_nulls_last("confidence"), F.desc_nulls_first("updated_at"), F.asc("memory_id"))
    m = m.withColumns({"keeper": F.first("memory_id").over(best), "_place": F.row_number().over(best)})
    first = ranking.first_per_key(support, ["memory_id"], [F.asc_nulls_last("created_at"), F.asc_nulls_last("fact_id"), F.asc_nulls_last("episode_id")]).select("memory_id", "fact_id", "episode_id")
    guarded = support.where("fact_id is not null").join(facts.where("priority = 1").select("fact_id"), "fact_id", "left_semi").select("memory_id").distinct().withColumn("_guarded", F.lit(True))
    m = m.join(first, "memory_id", "left").join(guarded, "memory_id", "left")
    alive = F.coalesce(F.col("lifecycle_state") != "retired", F.lit(False))
    stale = F.col("last_supported_at").isNull() | (F.col("last_supported_at") < now - F.make_interval(months=F.lit(STALE_MONTHS)))
    calls = {
        "created": (F.col("lifecycle_state") == "draft") & (n("support_count") >= SUPPORTED),
        "enriched": alive & (n("support_count") >= SUPPORTED) & (F.length(F.coalesce("narrative", F.lit(""))) < SHORT),
        "merged": titled & alive & (F.col("_place") > 1),
        "demoted": (F.col("lifecycle_state") == "published") & stale & F.col("_guarded").isNull(),
        "retired": alive & (n("contradiction_count") > n("support_count")) & (F.col("created_at") < now - F.expr(f"interval {SETTLED_DAYS} days")),
    }
    fresh = F.concat(F.coalesce("narrative", F.lit("")), F.lit("\n\nEvidence refresh: support="), n("support_count").cast("string"), F.lit(", contradictions="), n("contradiction_count").cast("string"), F.lit("."))
    one = lambda kind: F.when(calls[kind], F.struct(
        F.lit(kind).alias("revision_type"), F.lit(ORDER[kind]).alias("precedence"), (fresh if kind == "enriched" else F.col("narrative")).alias("new_narrative"),
        F.concat(F.lit("Duplicate title/scope candidate; review merge into memory "), "keeper", F.lit(".")).alias("change_reason") if kind == "merged" else F.lit(REASONS.get(kind)).alias("change_reason"),
    ))
    klass = F.when(F.col("memory_type") == "entity_summary", "entity_summary").when(F.col("valid_from").isNotNull() | F.col("episode_id").isNotNull(), "experience").when(F.col("memory_type") == "playbook", "rule").otherwise("belief")
    d = m.withColumn("r", F.explode(F.array_compact(F.array(*map(one, ORDER)))))
    d = d.select("memory_id", "r.revision_type", klass.alias("derived_class"), F.coalesce("title", F.lit("(untitled memory)")).alias("title"), F.col("narrative").alias("old_narrative"), "r.new_narrative", "r.change_reason", "fact_id", "episode_id", F.when(F.col("r.revision_type") == "merged", F.col("keeper")).alias("keeper"), "r.precedence")
    return d if limit is None else d.orderBy("precedence", "title", "memory_id", "change_reason").limit(min(max(limit, 1), 1000))


def insert(table: DataFrame, found: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """(new revisions, their support): proposals that are not known by memory, kind, reason and prompt version."""
    rows = found.withColumns({"tenant": F.lit(tenant), "model_name": F.lit(MODEL), "prompt_version": F.lit(PROMPT)})
    keys = ["memory_id", "tenant", "revision_type", "change_reason", "prompt_version"]
    new = merge.insert_if_absent(table, rows, keys).withColumn("revision_id", F.sha2(F.concat_ws("|", *keys), 256))
    support = new.where("fact_id is not null or episode_id is not null").select("revision_id", "fact_id", "episode_id", F.col("revision_type").alias("notes"))
    return new.select("revision_id", *keys, "old_narrative", "new_narrative", "model_name"), support


def final_keepers(merges: DataFrame) -> DataFrame:
    """(memory_id, keeper): where each merged memory ends, as merges may lead to memories that are merged themselves.

    Each round doubles how far a memory has jumped; rounds end when all have arrived, or after enough of them to go once round
    any circle. Of several keepers of one memory the smallest counts; on a circle all end at its smallest id.
    """
    at = written(merges.where("memory_id <> keeper").groupBy("memory_id").agg(F.min("keeper").alias("keeper")).withColumn("least", F.col("memory_id")))
    for _ in range(at.count().bit_length()):
        far = at.select(F.col("memory_id").alias("keeper"), F.col("keeper").alias("_to"), F.col("least").alias("_least"))
        at = written(at.join(far, "keeper", "left").select("memory_id", F.coalesce("_to", "keeper").alias("keeper"), F.least("least", F.coalesce("_least", "least")).alias("least")))
        if at.join(at.select(F.col("memory_id").alias("keeper")), "keeper", "left_semi").isEmpty():
            break
    # Whoever still stands on a memory that is merged stands on a circle, all of which that memory has seen.
    circle = at.select(F.col("memory_id").alias("keeper"), F.col("least").alias("_least"))
    out = at.join(circle, "keeper", "left").select("memory_id", F.coalesce("_least", "keeper").alias("keeper"))
    return out.where("memory_id <> keeper")


def unite(memories: DataFrame, support: DataFrame, merges: DataFrame, keys: Sequence[str] = ("memory_id", "fact_id", "episode_id", "support_type")) -> tuple[DataFrame, DataFrame]:
    """(memories, support) after approved merges (memory_id, keeper): support moves to the memory that stays, once for each
    fact and episode; its count follows, contradictions add up, and merged memories are retired."""
    to = final_keepers(merges)
    moved = support.join(to, "memory_id", "left").withColumn("memory_id", F.coalesce("keeper", "memory_id")).drop("keeper").dropDuplicates(list(keys))
    counts = moved.where("support_type = 'supporting'").groupBy("memory_id").agg(F.count("*").cast("int").alias("_support"))
    against = memories.join(to, "memory_id").groupBy(F.col("keeper").alias("memory_id")).agg(F.sum(F.coalesce("contradiction_count", F.lit(0))).cast("int").alias("_against"))
    gone = to.select("memory_id", F.lit(True).alias("_gone"))
    d = memories.join(counts, "memory_id", "left").join(against, "memory_id", "left").join(gone, "memory_id", "left")
    stays = F.col("_against").isNotNull()
    values = {
        "support_count": F.when(F.col("_gone"), F.lit(0)).when(stays, F.coalesce("_support", F.lit(0))).otherwise(F.col("support_count")),
        "contradiction_count": F.when(stays, F.coalesce("contradiction_count", F.lit(0)) + F.col("_against")).otherwise(F.col("contradiction_count")),
        "lifecycle_state": F.when(F.col("_gone"), "retired").otherwise(F.col("lifecycle_state")),
    }
    return d.select(*[values[c].alias(c) if c in values else F.col(c) for c in memories.columns]), moved.select(*support.columns)
