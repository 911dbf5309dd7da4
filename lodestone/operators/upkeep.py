"""Upkeep of the stored memory: artifacts, review rows, retention, demotion, compaction, priorities, dates, evaluation totals.

Changes are rewrites with a ``touched`` flag, as in ``merge``; ``now`` is a column.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import merge

#: A published memory is stale after so many days; reasons of retention reviews with their least risk. Fixed values.
STALE_DAYS = 180
PROPOSALS = {
    "retire": ("Adaptive retention review: contradictions exceed support; review retirement.", 0.90),
    "demote": ("Adaptive retention review: published memory is stale; review demotion to draft.", 0.70),
    "refresh": ("Adaptive retention review: active memory lacks evidence support; refresh or relink evidence.", 0.50),
}
#: Strings that stand for no date. Fixed values.
NO_DATE = ("null", "n/a", "na", "tbd", "none", "unknown", "-", "")


def new_artifact_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", "tenant", "source_key"), 256), 1, 32)


def ensure_artifacts(artifacts: DataFrame, items: DataFrame, unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ids, new rows): the artifact of every item (tenant, source_key, source_type, original_path, content, scope_path), and what is to be added.

    ``unique``: no key of the items repeats.
    """
    known = artifacts.select("tenant", "source_key", "artifact_id")
    one = (items if unique else merge.one_per_key(items, ["tenant", "source_key"])).join(known, ["tenant", "source_key"], "left")
    fresh_id = new_artifact_id()
    ids = one.select("tenant", "source_key", F.coalesce("artifact_id", fresh_id).alias("artifact_id"), F.col("artifact_id").isNull().alias("created"))
    content = F.coalesce("content", F.lit(""))
    new = one.where("artifact_id is null").select("tenant", "source_key", fresh_id.alias("artifact_id"), "source_type", "original_path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("size_bytes"), "scope_path", F.lit("discovered").alias("preservation_state"))
    return ids, new


def new_reviews(queue: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (target_type, target_id, reason) without a pending review of the same target and reason."""
    keys = ["target_type", "target_id", "reason"]
    open_ = queue.where("status = 'pending'").select(*keys)
    return wanted.dropDuplicates(keys).join(open_, keys, "left_anti").withColumn("status", F.lit("pending"))


def prune_outbox(outbox: DataFrame, before: Column) -> DataFrame:
    """What is left without completed and dead rows that ended, or came, before a time."""
    gone = F.col("status").isin("completed", "dead_letter") & (F.coalesce("completed_at", "received_at") < before)
    return outbox.where(~F.coalesce(gone, F.lit(False)))


def archive_oldest(artifacts: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Artifacts after the ``limit`` oldest discovered ones are archived."""
    due = artifacts.where("preservation_state = 'discovered'").orderBy(F.asc_nulls_last("discovered_at"), "artifact_id").limit(limit).select("artifact_id", F.lit(True).alias("touched"))
    d = artifacts.join(due, "artifact_id", "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    changed = {"preservation_state": F.lit("archived"), "updated_at": now}
    return d.select(*[F.when(F.col("touched"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in artifacts.columns], "touched")


def is_stale(now: Column) -> Column:
    supported = F.col("last_supported_at")
    return (F.col("lifecycle_state") == "published") & (supported.isNull() | (supported < now - F.make_dt_interval(F.lit(STALE_DAYS))))


def _too_old(now: Column, months: int) -> Column:
    """Calendar months before now, the time of day kept."""
    day = F.to_date(now)
    return F.add_months(day, -months).cast("timestamp") + (now.cast("timestamp") - day.cast("timestamp"))


def demote_stale(memories: DataFrame, support: DataFrame, facts: DataFrame, now: Column, months: int = 6) -> DataFrame:
    """Memories after published ones without support for some calendar months become drafts, unless a priority-1 fact supports them."""
    held = support.join(facts.where("priority = 1").select("fact_id"), "fact_id", "left_semi").select("memory_id").distinct().withColumn("_held", F.lit(True))
    old = (F.col("lifecycle_state") == "published") & (F.col("last_supported_at") < _too_old(now, months)) & F.col("_held").isNull()
    d = memories.join(held, "memory_id", "left").withColumn("touched", F.coalesce(old, F.lit(False)))
    return d.select(*[F.when(F.col("touched"), "draft").otherwise(F.col(c)).alias(c) if c == "lifecycle_state" else F.col(c) for c in memories.columns], "touched")


def usage(memories: DataFrame, now: Column) -> DataFrame:
    """One row of counts and of ratios (two decimals, 0 to 1) over the memories."""
    state = F.coalesce("lifecycle_state", F.lit("draft"))
    unsupported = (F.coalesce("support_count", F.lit(0)) == 0) & (state != "retired")
    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("narrative", F.lit("")))
    d = memories.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.coalesce(F.col("lifecycle_state") == s, F.lit(False))).alias(s) for s in ("published", "draft", "retired")],
        F.count_if(unsupported).alias("unsupported"),
        F.count_if(F.coalesce(is_stale(now), F.lit(False))).alias("stale"),
        F.coalesce(F.sum(F.coalesce("contradiction_count", F.lit(0))), F.lit(0)).alias("contradictions"),
        F.avg("confidence").alias("avg_confidence"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("bytes"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.least(F.round(F.col(c) / F.col("total"), 2), F.lit(1.0))).otherwise(F.lit(0.0)).alias(f"{c}_ratio")
    return d.select("*", share("unsupported"), share("stale"), share("contradictions"))


def latest_health(health: DataFrame) -> DataFrame:
    """(scope_path, risk_score) of the last assessment of each scope; '' stands for every scope."""
    return health.groupBy(F.coalesce("scope_path", F.lit("")).alias("scope_path")).agg(F.max_by("risk_score", F.struct("assessed_at", "risk_score")).alias("risk_score"))


def retention(memories: DataFrame, health: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """Memories to retire, demote or refresh, without those that have a pending review of that reason.

    The risk is the greatest of the proposal's and of the health of any scope above the memory. Scopes
    meet by all prefixes of a memory's path that are as long as some health scope: equi joins, one row for a memory.
    """
    d = memories.where(F.coalesce("lifecycle_state", F.lit("draft")) != "retired")
    against, support = F.coalesce("contradiction_count", F.lit(0)), F.coalesce("support_count", F.lit(0))
    kind = F.when(against > support, "retire").when(is_stale(now), "demote").when(support == 0, "refresh")
    d = d.withColumn("proposal_type", kind).where("proposal_type is not null")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PROPOSALS.items() for x in (k, v[i])]), F.col("proposal_type"))
    d = d.select("memory_id", F.coalesce("title", "fingerprint", "memory_id").alias("title"), F.coalesce("scope_path", F.lit("")).alias("_path"), "proposal_type", pick(0).alias("reason"), pick(1).alias("_least"))
    last = latest_health(health)
    lengths = last.select(F.length("scope_path").alias("_n")).distinct().agg(F.collect_set("_n").alias("_lengths"))  # lengths of paths, few
    prefixes = d.crossJoin(F.broadcast(lengths)).select("memory_id", F.explode(F.expr("transform(filter(_lengths, n -> n <= length(_path)), n -> left(_path, n))")).alias("scope_path"))
    risk = prefixes.join(last, "scope_path").groupBy("memory_id").agg(F.max("risk_score").alias("_risk"))
    d = d.join(risk, "memory_id", "left").withColumn("risk_score", F.round(F.least(F.greatest("_least", F.coalesce("_risk", F.lit(0.0))), F.lit(1.0)), 2))
    pending = queue.where("target_type = 'memory' and status = 'pending'").select(F.col("target_id").alias("memory_id"), "reason")
    return d.join(pending, ["memory_id", "reason"], "left_anti").select("memory_id", "title", "proposal_type", "reason", "risk_score")


def compact(memories: DataFrame, now: Column, min_quality: float = 0.3, days: int = 30) -> DataFrame:
    """Memories after open ones of low quality that nothing touched for some days are archived."""
    poor = F.coalesce("quality_score", "confidence", F.lit(0.0)) < min_quality
    old = F.coalesce("last_supported_at", "updated_at", "created_at") < now - F.make_dt_interval(F.lit(days))
    hit = F.coalesce(F.col("governance_status").isin("candidate", "review_required", "active") & poor & old, F.lit(False))
    d = memories.withColumn("touched", hit)
    return d.select(*[F.when(F.col("touched"), "archived").otherwise(F.col(c)).alias(c) if c == "governance_status" else F.col(c) for c in memories.columns], "touched")


def priority(milestone: Column, severity: Column, assertion_class: Column) -> Column:
    """1 milestone, 2 critical episode, 3 corroborated, 4 deterministic, else 5."""
    return F.when(milestone, 1).when(severity.isin("critical", "P1"), 2).when(assertion_class == "corroborated_llm", 3).when(assertion_class == "deterministic", 4).otherwise(5)


def parse_date(text: Column) -> Column:
    """A date or time in ISO form, or month/day/year; null for words that stand for none and, in ISO form, years outside 2020 to 2030."""
    said = F.trim(text)
    at = F.coalesce(F.try_to_timestamp(said), F.try_to_timestamp(said, F.lit("yyyy-MM-dd")))
    us = F.when(said.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(said, F.lit("M/d/yyyy")))
    return F.when(F.lower(said).isin(*NO_DATE), None).when(at.isNotNull(), F.when(F.year(at).between(2020, 2030), at)).otherwise(us)


def date_range(start: Column, end: Column) -> Column:
    """struct(start, end) of two date texts, swapped if they are the wrong way round."""
    a, b = parse_date(start), parse_date(end)
    wrong = F.coalesce(a > b, F.lit(False))
    return F.struct(F.when(wrong, b).otherwise(a).alias("start"), F.when(wrong, a).otherwise(b).alias("end"))


def fact_fingerprint(subject: Column, predicate: Column, value_json: Column) -> Column:
    """SHA-256 of subject, predicate and the value as JSON text."""
    return F.sha2(fact_text(subject, predicate, value_json), 256)


def fact_text(subject: Column, predicate: Column, value_json: Column) -> Column:
    """What a fingerprint is the digest of."""
    return F.concat_ws("|", F.coalesce(subject, F.lit("")), F.coalesce(predicate, F.lit("")), F.coalesce(value_json, F.lit('""')))


def eval_totals(cases: DataFrame, *by: str) -> DataFrame:
    """Means over evaluation cases, in all or by device or complexity; rates leave cases without a gold answer out."""
    rate = lambda c: F.coalesce(F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("int"))), F.lit(0.0)).alias(f"{c}_rate")
    return cases.groupBy(*by).agg(F.count("*").alias("cases"), *[F.avg(c).alias(f"avg_{c}") for c in ("entity_f1", "fact_ratio")], rate("root_cause"), rate("fix_summary"))


def extremes(cases: DataFrame, score: str, key: str, n: int = 5) -> DataFrame:
    """The ``n`` worst and the ``n`` best cases with their place from either end."""
    worst = cases.orderBy(F.asc(score), F.asc(key)).limit(n).withColumn("side", F.lit("worst"))
    best = cases.orderBy(F.desc(score), F.desc(key)).limit(n).withColumn("side", F.lit("best"))
    order = Window.partitionBy("side").orderBy(F.when(F.col("side") == "worst", F.col(score)).otherwise(-F.col(score)), F.when(F.col("side") == "worst", F.col(key)).otherwise(-F.col(key)))
    return worst.unionByName(best).withColumn("place", F.row_number().over(order).cast("long"))


#: Sources that are extracted by themselves once they are archived. Fixed values.
PENDING_SOURCES = ("vault_incident", "claude_session")
COUNTED = ("artifact", "entity", "episode", "fact", "memory", "segment", "memory_support", "fact_evidence")


def pending_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts of PENDING_SOURCES that wait for extraction, with their place: the oldest first."""
    d = artifacts.where(F.col("source_type").isin(*PENDING_SOURCES) & ~F.coalesce(F.col("preservation_state").isin("extracted", "published"), F.lit(False)))
    return d.select("artifact_id", "source_key", "original_path", "source_type", "discovered_at")


def outcomes(extracted: DataFrame, gated: DataFrame) -> DataFrame:
    """(artifact_id, state, reason): what became of each artifact of a batch. One that failed does not hold up others: its rows
    and reasons are set apart. extracted: (artifact_id, error or null); gated: (artifact_id, reject_reason or null) for each fact."""
    g = gated.groupBy("artifact_id").agg(F.count("*").alias("n"), F.count("reject_reason").alias("bad"), F.min("reject_reason").alias("why"))
    d = extracted.groupBy("artifact_id").agg(F.max("error").alias("error")).join(g, "artifact_id", "left")
    state = F.when(F.col("error").isNotNull(), "failed").when((F.col("n") > 0) & (F.col("bad") == F.col("n")), "rejected").otherwise("extracted")
    return d.select("artifact_id", state.alias("state"), F.coalesce("error", F.when(state == "rejected", F.col("why"))).alias("reason"))


def status(tables: Mapping[str, DataFrame], now: Column, stale_months: int = 6) -> DataFrame:
    """(name, n): rows of the COUNTED tables, published memories without recent support, and milestones (facts of priority 1)."""
    rows = [tables[t].agg(F.count("*").alias("n")).select(F.lit(f"rows:{t}").alias("name"), "n") for t in COUNTED if t in tables]
    memory = tables["memory"]
    stale = memory.where((F.col("lifecycle_state") == "published") & (F.col("last_supported_at") < now - F.make_interval(months=F.lit(stale_months))))
    rows += [stale.agg(F.count("*").alias("n")).select(F.lit("stale memories").alias("name"), "n"), tables["fact"].where("priority = 1").agg(F.count("*").alias("n")).select(F.lit("milestones").alias("name"), "n")]
    return reduce(lambda a, b: a.unionByName(b), rows)


def time_coverage(facts: DataFrame) -> DataFrame:
    """One row: facts with a start, with an end, and all."""
    return facts.agg(F.count("valid_from").alias("with_start"), F.count("valid_to").alias("with_end"), F.count("*").alias("facts"))
