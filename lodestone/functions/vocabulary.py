"""Closed vocabularies of the lifecycle, target pairs and the evidence boundary, as reasons for refusal.

Each check is a column that is null where a row may pass and else says why not, so that a batch is told apart in one scan
instead of failing at its first bad row. ``refused`` raises for callers that want the failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TARGET_KINDS = ("fact", "memory", "procedure", "event_frame", "working_memory")
STATUSES = ("candidate", "archived", "active", "review_required", "validated", "disputed", "suppressed", "retired")
SIGNALS = (
    "retrieved_not_injected", "injected_referenced", "injected_ignored", "injected_contradicted", "led_to_success",
    "led_to_failure", "user_corrected", "user_confirmed", "admin_suppressed", "admin_promoted",
)
EVENT_TYPES = (
    "mission_started", "mission_completed", "mission_failed", "session_started", "session_completed", "session_failed", "model_call_started", "model_call_completed", "model_call_failed",
    "tool_called", "tool_completed", "tool_failed", "approval_decided", "user_corrected", "context_compacted", "memory_retrieved", "memory_injected", "memory_omitted", "memory_feedback",
    "memory_written", "memory_suppressed", "memory_retired", "memory_promoted", "admin_memory_suppressed", "admin_memory_retired", "admin_memory_promoted", "admin_memory_disputed",
    "admin_feedback_resolved", "admin_policy_override", "artifact_archived", "extraction_completed", "fact_inserted", "memory_consolidated", "procedure_used", "working_memory_added", "working_memory_promoted",
)
CUE_TYPES = ("entity", "action", "tool", "failure_mode", "goal", "file_path", "policy", "user_preference", "environment", "project", "procedure", "session")
CUE_METHODS = ("template", "keyword", "entity", "llm", "manual")
#: Events that may create a fact, given evidence.
FACT_EVENTS = ("approval_decided", "user_corrected", "fact_inserted")


def choice(value: Column, allowed: tuple[str, ...], label: str) -> Column:
    """Null values are no choice and pass."""
    return F.when(value.isNotNull() & ~value.isin(*allowed), F.lit(f"{label} must be one of: {', '.join(allowed)}"))


def target_pair(kind: Column, target: Column) -> Column:
    return F.when(kind.isNull() != target.isNull(), F.lit("target kind and target id must be given together"))


def or_default(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    """The value if the vocabulary has it, else the default; exact words only."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def has_segment(refs: Column) -> Column:
    """Whether a JSON list of evidence has an object with a ``segment_id`` that is a string and not blank."""
    items = F.try_variant_get(F.try_parse_json(refs), "$", "array<variant>")
    one = lambda x: F.coalesce(F.schema_of_variant(F.try_variant_get(x, "$.segment_id", "variant")) == "STRING", F.lit(False)) & (F.trim(F.try_variant_get(x, "$.segment_id", "string")) != "")
    return F.coalesce(F.exists(items, one), F.lit(False))


def creation(event_type: Column, target_kind: Column, refs: Column) -> Column:
    """Why an event may not create a target: only facts are created, by some events, on evidence; working memory always may."""
    durable = F.when(target_kind != "fact", "lifecycle events cannot directly create durable memories, procedures or event frames")
    proof = F.when(~(event_type.isin(*FACT_EVENTS) & has_segment(refs)), "a fact needs an approved, corrected or inserted event and a segment as evidence")
    return F.when(target_kind.isNull() | (target_kind == "working_memory"), None).otherwise(F.coalesce(durable, proof))


def native_change(requested: Column, what: str = "feedback") -> Column:
    """Feedback and status changes reach lifecycle rows, cues, audits and reviews, never what a target itself holds."""
    return F.when(F.coalesce(requested, F.lit(False)), F.lit(f"{what} may not change a target's own columns"))


def first_reason(*checks: Column) -> Column:
    return F.coalesce(*checks, F.lit(None).cast("string"))


def refused(reason: Column, value: Column) -> Column:
    """``value``, or an error with the reason."""
    return F.when(reason.isNotNull(), F.raise_error(reason).cast("string")).otherwise(value)
