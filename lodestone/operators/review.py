"""Reviews, project tags, provenance, notes, coverage counts and fingerprints of derived rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import TRUSTED_CLASSES
from ..functions.text import json_text, redact
from . import ranking

#: Kinds of facts that make event frames, and those whose value is an outcome. Fixed values.
FRAME_KINDS = ("cause", "impact", "decision", "remediation", "config_change")
OUTCOME_KINDS = ("remediation", "decision", "lesson")
#: The order of referents in the key of an evidence row. Fixed values.
REFERENTS = (("fact", "fact_id"), ("episode", "episode_id"), ("segment", "segment_id"), ("memory", "memory_id"), ("edge", "edge_id"), ("event-frame", "event_frame_id"), ("usage", "usage_id"))


def listed(queue: DataFrame, artifacts: DataFrame, runs: DataFrame, facts: DataFrame, reason: str, status: str = "pending", limit: int = 50) -> DataFrame:
    """Reviews of artifacts, oldest first, with the number of active facts of the artifact."""
    n = facts.where("current_status = 'active'").groupBy(F.col("created_run_id").alias("run_id")).agg(F.count("*").alias("_n"))
    per = runs.select("run_id", "artifact_id").join(n, "run_id").groupBy("artifact_id").agg(F.sum("_n").alias("fact_count"))
    wanted = queue.where((F.col("target_type") == "artifact") & (F.col("reason") == reason) & (F.col("status") == status)).select("review_id", "status", "reason", F.col("created_at").alias("asked_at"), F.col("target_id").alias("artifact_id"))
    d = wanted.join(artifacts.select("artifact_id", "source_type", "source_key", "scope_path"), "artifact_id").join(per, "artifact_id", "left")
    d = d.withColumn("fact_count", F.coalesce("fact_count", F.lit(0)))
    return ranking.top(d, [F.asc_nulls_last("asked_at"), F.asc("review_id")], max(1, min(200, limit)))


def decide(queue: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """The queue after decisions (review_id, status): pending reviews are approved or rejected, approved ones may be rejected; with ``touched``."""
    d = queue.join(decisions.groupBy("review_id").agg(F.max("status").alias("_to")), "review_id", "left")
    may = (F.col("status") == "pending") & F.col("_to").isin("approved", "rejected") | (F.col("status") == "approved") & (F.col("_to") == "rejected")
    d = d.withColumn("touched", F.coalesce(may, F.lit(False)))
    changed = {"status": F.col("_to"), "reviewed_at": now}
    return d.select(*[F.when(F.col("touched"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in queue.columns], "touched")


def project_tags(memories: DataFrame, support: DataFrame, facts: DataFrame, episodes: DataFrame, projects: DataFrame) -> DataFrame:
    """(memory_id, project_id, n_projects): the project of the supporting facts and episodes if there is one, else null."""
    by_fact = support.select("memory_id", "fact_id").join(facts.select("fact_id", "project_id"), "fact_id").select("memory_id", "project_id")
    by_episode = support.select("memory_id", "episode_id").join(episodes.select("episode_id", "project_id"), "episode_id").select("memory_id", "project_id")
    met = by_fact.unionByName(by_episode).distinct().join(projects.select("project_id"), "project_id", "left_semi")
    per = met.groupBy("memory_id").agg(F.count("*").alias("n"), F.min("project_id").alias("first"))
    d = memories.select("memory_id").join(per, "memory_id", "left")
    return d.select("memory_id", F.when(F.col("n") == 1, F.col("first")).alias("project_id"), F.coalesce("n", F.lit(0)).alias("n_projects"))


def services(project_map: DataFrame) -> DataFrame:
    """Each project's services, sorted."""
    return project_map.groupBy("project_id").agg(F.array_sort(F.collect_set("service_name")).alias("services"))


def unarchived(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows without a project, or whose project (project_id, status) is not archived."""
    return rows.join(projects.where("status = 'archived'").select("project_id"), "project_id", "left_anti").select(*rows.columns)


def frame_candidates(facts: DataFrame, episodes: DataFrame, entities: DataFrame, evidence: DataFrame, frames: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    """Event frames that trusted facts with evidence call for, by time; none for a fact that has one."""
    f = facts.where((F.col("current_status") == "active") & F.col("assertion_class").isin(*TRUSTED_CLASSES) & F.col("fact_kind").isin(*FRAME_KINDS))
    f = f.join(frames.select(F.col("source_fact_id").alias("fact_id")), "fact_id", "left_anti")
    ep = episodes.select("episode_id", "start_at", F.col("scope_path").alias("_es"))
    best = F.struct(F.coalesce("weight", F.lit(float("-inf"))), -F.coalesce(F.unix_micros("created_at"), F.lit(1 << 62)))
    proof = evidence.where("segment_id is not null").groupBy("fact_id").agg(F.max_by("segment_id", best).alias("evidence_segment_id"))
    d = f.join(ep, "episode_id").join(entities.select(F.col("entity_id").alias("subject_entity_id")), "subject_entity_id", "left_semi").join(proof, "fact_id")
    scope = F.coalesce("scope_path", "_es")
    said = F.substring("object_value", 1, 500)
    part = lambda label, c, low=False: F.concat(F.lit(f"{label}="), F.lower(F.trim(c)) if low else F.trim(c))
    key = F.concat_ws("|", F.lit("event-frame-v1"), F.lit(f"tenant={tenant.strip()}"), part("episode", F.col("episode_id"), True), part("fact", F.col("fact_id"), True), part("event_type", F.col("fact_kind")), part("action", F.col("predicate")), part("scope", F.coalesce(scope, F.lit(""))))
    sure = F.coalesce(F.nanvl("confidence", F.lit(0.5)), F.lit(0.5))
    d = d.select(F.col("fact_id").alias("source_fact_id"), "episode_id", F.col("fact_kind").alias("event_type"), F.col("subject_entity_id").alias("actor_entity_id"), F.col("predicate").alias("action"), F.coalesce("valid_from", "start_at").alias("time_start"), F.col("valid_to").alias("time_end"),
        F.when(F.col("fact_kind").isin(*OUTCOME_KINDS), said).alias("outcome"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), "assertion_class", "evidence_segment_id", scope.alias("scope_path"), F.sha2(key, 256).alias("frame_fingerprint"))
    return ranking.top(d, [F.asc_nulls_last("time_start"), F.desc_nulls_last("confidence"), F.asc("source_fact_id")], max(1, min(limit, 1000)))


def evidence_key(row: Column, columns: Sequence[str]) -> Column:
    """The referents of an evidence row as text; empty if it has none."""
    parts = [F.when(F.trim(row[c]) != "", F.concat(F.lit(f"{name}:"), F.lower(F.trim(row[c])))) for name, c in REFERENTS if c in columns]
    return F.concat_ws(",", *parts)


def reflection_fingerprint(tenant: Column, kind: str, subject: Column, scope: Column, statement: Column, keys: Column) -> Column:
    """SHA-256 of a derived statement and its evidence keys in any order; null without evidence."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    linked = F.array_sort(F.filter(keys, lambda k: k != ""))
    text = F.concat_ws("|", F.lit("reflection-v1"), F.concat(F.lit("tenant="), norm(tenant)), F.lit(f"kind={kind}"), F.concat(F.lit("subject="), norm(subject)), F.concat(F.lit("scope="), norm(scope)), F.concat(F.lit("statement="), norm(statement)), F.concat(F.lit("evidence="), F.array_join(linked, "|")))
    return F.when(F.size(linked) > 0, F.sha2(text, 256))


def beliefs(statements: DataFrame, tenant: str) -> DataFrame:
    """Belief candidates of statements (subject_id, scope_path, statement, confidence, evidence array<struct>) that have evidence."""
    columns = statements.schema["evidence"].dataType.elementType.names  # type: ignore[attr-defined]
    keys = F.transform("evidence", lambda e: evidence_key(e, columns))
    sure = F.coalesce(F.nanvl("confidence", F.lit(0.5)), F.lit(0.5))
    mark = reflection_fingerprint(F.lit(tenant), "belief", F.col("subject_id"), F.col("scope_path"), F.col("statement"), keys)
    return statements.withColumns({"fingerprint": mark, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure))}).where("fingerprint is not null")


def attribution(memories: DataFrame, meta: str) -> DataFrame:
    """Where a memory came from, by the event in its governance JSON (either spelling of the key)."""
    get = lambda k: F.coalesce(F.get_json_object(meta, f"$.lifecycleEvent.{k}"), F.get_json_object(meta, f"$.lifecycle_event.{k}"))
    refs = F.coalesce(F.from_json(get("evidenceRefs"), "array<string>"), F.array().cast("array<string>"))
    return memories.select("memory_id", get("sourceService").alias("source_service"), get("eventId").alias("event_id"), get("episodeId").alias("episode_id"), get("traceId").alias("trace_id"), refs.alias("evidence_refs"))


def summary_line(text: Column, limit: int = 120) -> Column:
    """The first line with content, cut with dots."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), text)
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def notes(memories: DataFrame, published: DataFrame) -> DataFrame:
    """(memory_id, file_name, body, content_hash, stale_name) of published memories whose note is new or changed; secrets are redacted."""
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Untitled Memory").otherwise(redact("title"))
    text = redact(F.coalesce("narrative", F.lit("")))
    quoted = lambda c: json_text(F.regexp_replace(c, r"[\r\n]+", " "))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("name: "), quoted(title)), F.concat(F.lit("description: "), quoted(summary_line(text))), F.lit("type: reference"),
        F.format_string("support_count: %d", F.coalesce("support_count", F.lit(0))), F.concat(F.lit("scope_path: "), quoted(redact("scope_path"))), F.lit("---"))
    foot = F.format_string("*Confidence: %.0f%% | Support: %d episodes | Contradictions: %d*", F.coalesce("confidence", F.lit(0.0)) * 100, F.coalesce("support_count", F.lit(0)), F.coalesce("contradiction_count", F.lit(0)))
    body = F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.when(text != "", text), F.lit("---"), F.lit(""), foot)
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)
    name = F.concat(F.when(slug == "", "memory").otherwise(slug), F.lit("-"), F.substring(F.regexp_replace("memory_id", "[^a-zA-Z0-9-]", ""), 1, 80), F.lit(".md"))
    d = memories.where("lifecycle_state = 'published'").select("memory_id", name.alias("file_name"), body.alias("body")).withColumn("content_hash", F.sha2("body", 256))
    old = published.select("memory_id", F.col("note_path").alias("_name"), F.col("content_hash").alias("_hash"))
    d = d.join(old, "memory_id", "left").where(~(F.col("_name").eqNullSafe(F.col("file_name")) & F.col("_hash").eqNullSafe(F.col("content_hash"))))
    return d.select("memory_id", "file_name", "body", "content_hash", F.when(F.col("_name") != F.col("file_name"), F.col("_name")).alias("stale_name"))


def coverage(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(name, total, pending): rows of each table and those that lack a column's value."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("total"), F.count_if(F.col(c).isNull()).alias("pending")) for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
