"""Row predicates and validators shared by all read paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import EXCLUDED_STATUSES, EXCLUDED_TRUST
from .text import col


def tenant_is(tenant: str, c: str = "tenant") -> Column:
    return F.col(c) == tenant


def in_scope(scope: str | None, c: Column | str = "scope_path") -> Column:
    """Prefix match; a null path matches only when no scope is asked for."""
    return F.lit(True) if scope is None else F.coalesce(col(c).startswith(scope), F.lit(False))


def valid_at(t: Column, start: Column | str = "valid_from", end: Column | str = "valid_to") -> Column:
    """Half-open validity: from <= t < to, open ends are null."""
    return (col(start).isNull() | (col(start) <= t)) & (col(end).isNull() | (col(end) > t))


def within(c: Column | str, start: Column | None, end: Column | None) -> Column:
    """[start, end); a null value is outside any bounded window."""
    out = F.lit(True)
    if start is not None:
        out = out & (col(c) >= start)
    if end is not None:
        out = out & (col(c) < end)
    return F.coalesce(out, F.lit(False))


def any_ilike(pattern: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns; LIKE metacharacters are taken literally."""
    p = "%" + pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.col(c).ilike(p), F.lit(False))
    return out


def any_ilike_list(c: str, pattern: str) -> Column:
    """Case-insensitive substring in any string of an array column."""
    return F.coalesce(F.exists(F.col(c), lambda x: F.contains(F.lower(x), F.lit(pattern.lower()))), F.lit(False))


def governed(include_excluded: bool = False, status: str = "governance_status", trust: str = "trust_class") -> Column:
    if include_excluded:
        return F.lit(True)
    return ~F.coalesce(F.col(status).isin(*EXCLUDED_STATUSES), F.lit(False)) & ~F.coalesce(F.col(trust).isin(*EXCLUDED_TRUST), F.lit(False))


def unsafe(status: str = "governance_status", trust: str = "trust_class") -> Column:
    return ~governed(False, status, trust)


def live_session(now: Column, status: str = "status", expires: str = "expires_at") -> Column:
    return F.col(status).isin("active", "idle") & (F.col(expires).isNull() | (F.col(expires) > now))


def claimable(now: Column, timeout_s: int = 300, max_attempts: int = 5) -> Column:
    """Outbox rows that a worker may take: new, stuck in processing, or failed and due again."""
    stuck = (F.col("status") == "processing") & (F.unix_timestamp(F.col("claimed_at")) < F.unix_timestamp(now) - timeout_s)
    due = (F.col("status") == "failed") & (F.col("attempt_count") < max_attempts) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return F.coalesce((F.col("status") == "pending") | stuck | due, F.lit(False))


def bounded(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null for a row counts as kept."""
    return F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))


def both_or_neither(a: str, b: str) -> Column:
    return F.col(a).isNull() == F.col(b).isNull()


def exactly_one(*columns: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) == 1
