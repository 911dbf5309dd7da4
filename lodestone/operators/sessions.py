"""Task sessions and working memory: state changes as table rewrites, guarded by status, expiry and evidence.

Requests come as rows, so any number of sessions or items change in one join on their key. ``now`` is a column, which
makes every change repeatable. Tables without a row for a request stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bounded, in_scope
from . import merge, ranking

#: Days a session or item lives by default; states of sessions and items. Fixed values.
TTL_DAYS = 14
OPEN, CLOSED = ("active", "idle"), ("completed", "failed")
EXPIRABLE = ("not_promoted", "promotion_candidate", "rejected")
KEY = ["tenant", "session_key"]


def ttl(days: Column | str) -> Column:
    """Days bounded to 1 to 365; null is the default."""
    d = F.col(days) if isinstance(days, str) else days
    return F.coalesce(F.least(F.greatest(d.cast("int"), F.lit(1)), F.lit(365)), F.lit(TTL_DAYS))


def _in_days(now: Column, days: Column) -> Column:
    return (now.cast("timestamp") + F.make_dt_interval(days)).cast("timestamp")


def is_open(now: Column) -> Column:
    return F.col("status").isin(*OPEN) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def start(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Sessions after starting or resuming those of ``requests`` (tenant, session_key, agent_name, task_title, scope_path, ttl_days).

    A resumed session keeps its id, start, and whatever title or scope the request leaves out.
    """
    fresh = requests.withColumns(
        {
            "session_id": F.substring(F.sha2(F.concat_ws("\x1f", "tenant", "session_key"), 256), 1, 32),
            "status": F.lit("active"),
            "expires_at": _in_days(now, ttl("ttl_days")),
            **{c: now.cast("timestamp") for c in ("started_at", "last_seen_at", "created_at", "updated_at")},
        }
    )
    fresh = merge.one_per_key(fresh, KEY)
    return merge.upsert(sessions, fresh, KEY, {c: "keep" for c in ("session_id", "started_at", "created_at")})


def update(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Sessions after ``requests`` (tenant, session_key, status, task_title, scope_path); nulls leave values as they are."""
    return _changed(sessions, requests, now, ("status", "task_title", "scope_path"), {})


def close(sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Sessions after closing those of ``requests`` (tenant, session_key, status); other states than completed and failed raise."""
    bad = F.raise_error(F.concat(F.lit("a session cannot be closed as "), F.coalesce("status", F.lit("null"))))
    asked = requests.withColumn("status", F.when(F.col("status").isin(*CLOSED), F.col("status")).otherwise(bad))
    return _changed(sessions, asked, now, ("status",), {"ended_at": F.coalesce("ended_at", now.cast("timestamp"))})


def _changed(sessions: DataFrame, requests: DataFrame, now: Column, taken: tuple[str, ...], also: dict[str, Column]) -> DataFrame:
    asked = merge.one_per_key(requests, KEY).select(*KEY, *[F.col(c).alias(f"_{c}") for c in taken], F.lit(True).alias("_asked"))
    d = sessions.join(asked, KEY, "left")
    values = {c: F.coalesce(f"_{c}", c) for c in taken} | also | {c: now.cast("timestamp") for c in ("last_seen_at", "updated_at")}
    kept = [F.when(F.col("_asked"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in sessions.columns]
    return d.select(*kept, F.coalesce("_asked", F.lit(False)).alias("touched"))


def list_active(sessions: DataFrame, now: Column, scope: str | None = None, limit: int = 50) -> DataFrame:
    d = sessions.where(is_open(now))
    d = d.where(in_scope(scope)) if scope else d
    return ranking.top(d, [F.desc_nulls_first("last_seen_at"), F.asc("session_key")], bounded(limit, 1, 200))


def fingerprint(*parts: Column | str) -> Column:
    """SHA-256 of the trimmed, lower-cased parts; nulls are empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.lower(F.trim(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")))) for p in parts]), 256)


def add_items(items: DataFrame, sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Items after adding ``requests`` (tenant, session_key, memory_kind, content, source_segment_id, source_fact_id, evidence_segment_id, ttl_days).

    Requests for sessions that are not open are left out; an item that is there already is renewed.
    """
    live = sessions.where(is_open(now)).select(*KEY, "session_id")
    mark = fingerprint("tenant", "session_key", "memory_kind", "content", "source_segment_id", "source_fact_id", "evidence_segment_id")
    fresh = requests.join(live, KEY).withColumns({"working_memory_fingerprint": mark, "promotion_status": F.lit("not_promoted"), "expires_at": _in_days(now, ttl("ttl_days")), "created_at": now.cast("timestamp"), "updated_at": now.cast("timestamp")})
    fresh = fresh.withColumn("working_memory_id", F.substring("working_memory_fingerprint", 1, 32)).dropDuplicates(["tenant", "working_memory_fingerprint"])
    keep = [c for c in items.columns if c not in ("tenant", "working_memory_fingerprint", "content", "expires_at", "updated_at")]
    return merge.upsert(items, fresh, ["tenant", "working_memory_fingerprint"], dict.fromkeys(keep, "keep"))


def list_items(items: DataFrame, sessions: DataFrame, now: Column, session_key: str | None = None, status: str | None = None, expired: bool = False, limit: int = 50) -> DataFrame:
    """Items with their session's key, the newest first."""
    d = items.join(sessions.select(*KEY, "session_id"), ["tenant", "session_id"])
    d = d if expired else d.where(F.col("expires_at") > now)
    d = d.where(F.col("session_key") == session_key) if session_key else d
    d = d.where(F.col("promotion_status") == status) if status else d
    return ranking.top(d, [F.desc_nulls_first("created_at"), F.asc("working_memory_id")], bounded(limit, 1, 200))


def mark_candidates(items: DataFrame, sessions: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Items after ``requests`` (tenant, working_memory_id, promotion_reason, promotion_target_kind, promotion_target_id).

    Only unexpired items of closed sessions that point to some evidence become candidates; ``touched`` tells which.
    """
    taken = ("promotion_reason", "promotion_target_kind", "promotion_target_id")
    asked = merge.one_per_key(requests, ["tenant", "working_memory_id"]).select("tenant", "working_memory_id", *[F.col(c).alias(f"_{c}") for c in taken], F.lit(True).alias("_asked"))
    done = sessions.where(F.col("status").isin(*CLOSED)).select("tenant", "session_id", F.lit(True).alias("_closed"))
    d = items.join(asked, ["tenant", "working_memory_id"], "left").join(done, ["tenant", "session_id"], "left")
    proof = F.coalesce("evidence_segment_id", "source_segment_id", "source_fact_id").isNotNull()
    hit = F.coalesce(F.col("_asked") & F.col("_closed") & (F.col("expires_at") > now) & proof, F.lit(False))
    values = {c: F.col(f"_{c}") for c in taken} | {"promotion_status": F.lit("promotion_candidate"), "promotion_marked_at": now.cast("timestamp"), "updated_at": now.cast("timestamp")}
    kept = [F.when(F.col("touched"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in items.columns]
    return d.withColumn("touched", hit).select(*kept, "touched")


def expire(items: DataFrame, now: Column, limit: int = 500) -> DataFrame:
    """Items after at most ``limit`` overdue ones (the longest overdue first) that were not promoted are marked expired."""
    due = items.where((F.col("expires_at") <= now) & F.col("promotion_status").isin(*EXPIRABLE))
    due = ranking.top(due, [F.asc("expires_at"), F.asc("working_memory_id")], bounded(limit, 1, 5000)).select("tenant", "working_memory_id", F.lit(True).alias("touched"))
    d = items.join(due, ["tenant", "working_memory_id"], "left").withColumn("touched", F.coalesce("touched", F.lit(False)))
    changed = {"promotion_status": F.lit("expired"), "updated_at": now.cast("timestamp")}
    return d.select(*[F.when(F.col("touched"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in items.columns], "touched")
