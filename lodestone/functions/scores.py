"""Scoring formulas: importance, health, risk, prompt rank, freshness, confidence, draft scores, ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

#: Score changes for feedback on lifecycle targets: (salience, strength, stability, quality). Fixed values.
OVERLAY_DELTAS = {
    "retrieved_not_injected": (-0.01, 0.0, 0.0, 0.0),
    "injected_referenced": (0.05, 0.04, 0.02, 0.03),
    "injected_ignored": (-0.02, -0.01, 0.0, -0.01),
    "injected_contradicted": (0.03, -0.08, -0.08, -0.10),
    "led_to_success": (0.06, 0.05, 0.03, 0.04),
    "led_to_failure": (0.02, -0.05, -0.04, -0.07),
    "user_corrected": (0.06, -0.06, -0.05, -0.08),
    "user_confirmed": (0.04, 0.06, 0.04, 0.06),
    "admin_suppressed": (-0.20, -0.20, 0.0, -0.20),
    "admin_promoted": (0.15, 0.10, 0.05, 0.10),
}
#: Score changes for feedback on governed memories: (strength, stability, quality). Fixed values.
GOVERNANCE_DELTAS = (
    {s: (0.05, 0.03, 0.04) for s in ("injected_referenced", "led_to_success", "user_confirmed", "admin_promoted")}
    | {s: (-0.08, -0.03, -0.08) for s in ("injected_contradicted", "led_to_failure", "user_corrected")}
    | {"admin_suppressed": (-0.2, -0.05, -0.15)}
)
HIDDEN_STATUSES = ("suppressed", "retired")
EXCLUDED_STATUSES = ("archived", "quarantined", "suppressed", "retired")
EXCLUDED_TRUST = ("retired_superseded",)
TRUSTED_CLASSES = ("deterministic", "human_curated", "corroborated_llm")
CAUSAL_TYPES = ("cause", "config_change", "impact", "decision", "remediation")
FAILURE = r"(fail|failed|failure|unresolved|regress|regressed|unsuccessful|did not|error)"
#: Weights of the fused streams, without and with the graph stream. Fixed values.
WEIGHTS = {"vector": 0.35, "structured": 0.25, "fts": 0.20, "temporal": 0.20}
GRAPH_WEIGHTS = {"vector": 0.30, "structured": 0.22, "fts": 0.18, "temporal": 0.15, "graph": 0.15}
RRF_K = 60


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def priority_boost(priority: Column | str) -> Column:
    """(11 - p) / 5; rows without a priority keep their score."""
    return F.when(col(priority).isNull(), F.lit(1.0)).otherwise((F.lit(11.0) - col(priority)) / 5.0)


def importance(milestone: Column, assertion_class: Column, severity: Column, created: Column, now: Column) -> Column:
    """50 for milestones, 10 or 15 for the class, 20 or 10 for severity, up to 20 for recency; at most 100, rounded."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    classes = F.when(assertion_class == "human_curated", 15).when(assertion_class == "deterministic", 10).otherwise(0)
    grave = F.when(severity == "critical", 20).when(severity == "high", 10).otherwise(0)
    total = F.when(milestone, 50).otherwise(0) + classes + grave + F.greatest(F.lit(0.0), 20 - 0.1 * days)
    return F.round(F.least(F.lit(100.0), total)).cast("int")


def pattern_confidence(support: Column) -> Column:
    return F.least(0.5 + 0.1 * support, F.lit(0.95))


def health_status(contradictions: Column, unsupported: Column, stale: Column, gaps: Column) -> Column:
    return (
        F.when((contradictions > 0) | (unsupported >= 0.25) | (gaps >= 10), "critical")
        .when((unsupported >= 0.10) | (stale >= 0.25) | (gaps > 0), "degraded")
        .when((unsupported > 0) | (stale > 0), "watch")
        .otherwise("healthy")
    )


def retention_risk(unsupported: Column, stale: Column, contradicted: Column, status: Column) -> Column:
    bump = F.when(status == "critical", 0.35).when(status == "degraded", 0.20).when(status == "watch", 0.08).otherwise(0.0)
    return clamp(0.45 * unsupported + 0.25 * stale + 0.30 * contradicted + bump)


def prompt_rank(score: Column, quality: Column, corrected: Column, validated: Column, strength: Column, priority: Column) -> Column:
    boost = F.when(priority.isNull() | (priority == 0), 0.0).otherwise((11 - priority) / 50)
    return score + F.coalesce(quality, F.lit(0.5)) + F.when(corrected, 0.2).otherwise(0.0) + F.when(validated, 0.15).otherwise(0.0) + F.coalesce(strength, F.lit(0.0)) * 0.2 + boost


def freshness(updated: Column, now: Column, half_life_s: float = 86400.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / 1e6)
    return clamp(F.pow(F.lit(0.5), age / half_life_s))


def confidence(base: Column, support: Column, contradictions: Column, fresh: Column) -> Column:
    return clamp(base + F.least(F.lit(0.2), support * 0.03) + fresh * 0.1 - F.least(F.lit(0.3), contradictions * 0.08))


def backoff_seconds(attempt: Column, base: float = 30.0, cap: float = 3600.0) -> Column:
    return F.least(F.lit(cap), F.pow(F.lit(2.0), attempt) * base)


def source_reliability(event_type: Column, service: Column) -> Column:
    return F.when(event_type == "user_corrected", 1.0).when(service == "approval-service", 0.9).when(F.contains(service, F.lit("agent")) | F.contains(service, F.lit("orchestrator")), 0.75).otherwise(0.6)


def draft_scores(event_type: Column, service: Column, has_evidence: Column, n_cues: Column, explicit: Column) -> dict[str, Column]:
    """Quality, salience, strength, stability, class, trust and namespace of a memory drafted from an event."""
    reliable = source_reliability(event_type, service)
    quality = clamp(F.when(has_evidence, 0.25).otherwise(0.05) + reliable * 0.35 + F.when(n_cues > 0, 0.2).otherwise(0.05) + F.when(event_type.isin("user_corrected", "approval_decided"), 0.2).otherwise(0.1))
    part = lambda word, x: F.when(F.contains(event_type, F.lit(word)), x).otherwise(0.0)
    salience = clamp(0.25 + part("failed", 0.25) + F.when(event_type == "user_corrected", 0.3).otherwise(0.0) + part("completed", 0.15) + F.coalesce(explicit, F.lit(0.0)) * 0.3)
    klass = F.when(event_type == "user_corrected", "corrected_by_user").when(event_type == "approval_decided", "user_stated").when(event_type.rlike("completed|failed"), "observed").otherwise("system_inferred")
    return {
        "quality": quality,
        "salience": salience,
        "strength": clamp(0.15 + 0.65 * salience + 0.2 * quality),
        "stability": clamp(0.08 + 0.12 * reliable + F.when(event_type == "user_corrected", 0.15).otherwise(0.0)),
        "source_class": klass,
        "trust_class": F.when(klass.isin("corrected_by_user", "user_stated"), "human_curated").when(klass == "observed", "deterministic").otherwise("single_source_llm"),
        "namespace": F.when((event_type == "approval_decided") | F.contains(event_type, F.lit("policy")), "policy").when(event_type.rlike("tool|failed|session|mission"), "episodic").otherwise("semantic"),
        "status": F.when(klass.isin("corrected_by_user", "user_stated"), "validated").when(quality < 0.45, "review_required").otherwise("active"),
    }


def section(namespace: Column, status: Column, text: Column) -> Column:
    failing = text.rlike(r"(?i)\b(error|fail|failed|failure)\b")
    return F.when(namespace == "policy", "policy_and_user_corrected_memory").when((status == "disputed") | failing, "failure_warnings").when(namespace == "procedural", "procedural_suggestions").when(namespace == "episodic", "episodic_context").otherwise("validated_facts")


def role(namespace: Column, status: Column, text: Column) -> Column:
    failing = text.rlike(r"(?i)\b(error|fail|failed|failure)\b")
    return F.when(failing, "warning").when(namespace == "procedural", "guidance").when(status.isin("disputed", "review_required"), "uncertainty").when(namespace == "episodic", "context").otherwise("fact")


def cue_type(text: Column) -> Column:
    t = F.lower(text)
    has = lambda *w: t.rlike("|".join(w))
    return F.when(has("fail", "error"), "failure_mode").when(has("tool"), "tool").when(has("policy", "approval"), "policy").when(has("/", r"\.ts", r"\.md"), "file_path").when(has("mission", "goal"), "goal").otherwise("action")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays in double precision; null where a norm is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)
