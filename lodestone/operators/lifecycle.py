"""Lifecycle of stored objects: what is known of each target, its status, feedback, cues and audit rows.

Targets are (tenant, target_kind, target_id). Requests come in batches; each function is a few keyed joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.scores import OVERLAY_DELTAS, clamp
from . import folds

KEY = ("tenant", "target_kind", "target_id")
SCORES = ("salience", "strength", "stability", "quality")
START = 0.5
MAX_CUES, SURE = 25, 0.7
#: Signals that count for or against a target, and those that ask for a review. Fixed values.
FOR = ("injected_referenced", "led_to_success", "user_confirmed", "admin_promoted")
AGAINST = ("injected_contradicted", "led_to_failure", "user_corrected")
REVIEWED = ("injected_contradicted", "led_to_failure", "user_corrected")


def missing(intelligence: DataFrame, kind: str, objects: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """Rows for the first ``limit`` objects (tenant, key) that have none yet."""
    known = intelligence.where(F.col("target_kind") == kind).select("tenant", F.col("target_id").alias(key))
    new = objects.select("tenant", key).distinct().join(known, ["tenant", key], "left_anti").orderBy(key, "tenant").limit(max(1, min(limit, 10_000)))
    return new.select("tenant", F.lit(kind).alias("target_kind"), F.col(key).alias("target_id"), F.lit("active").alias("lifecycle_status"), *[F.lit(START).alias(s) for s in SCORES], F.lit(0).alias("support_count"), F.lit(0).alias("contradiction_count"), F.lit(0).alias("lock_version"))


def _joined(intelligence: DataFrame, changes: DataFrame) -> DataFrame:
    """Every target with its changes; targets without a row have the starting values, and ``_new``."""
    d = intelligence.select(*KEY, "lifecycle_status", *SCORES, "support_count", "contradiction_count", "lock_version", F.lit(False).alias("_old")).join(changes, list(KEY), "full")
    start = {"lifecycle_status": "active", **dict.fromkeys(SCORES, START), "support_count": 0, "contradiction_count": 0, "lock_version": 0}
    return d.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in start.items()})


def set_status(intelligence: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the next version, audit rows): targets take the requested status (KEY, status, asked_at), the last of a target in a
    batch, and each request raises the lock version."""
    last = requests.groupBy(*KEY).agg(F.max_by("status", F.struct("asked_at", "status")).alias("_to"), F.count("*").alias("_n"))
    d = _joined(intelligence, last)
    out = d.select(*KEY, F.coalesce("_to", "lifecycle_status").alias("lifecycle_status"), *SCORES, "support_count", "contradiction_count", (F.col("lock_version") + F.coalesce("_n", F.lit(0))).cast("int").alias("lock_version"))
    audit = d.where("_to is not null").select(*KEY, F.lit("admin_status_change").alias("action"), F.to_json(F.struct(F.col("lifecycle_status").alias("before"), F.col("_to").alias("after"))).alias("details"))
    return out, audit


def feedback(intelligence: DataFrame, events: DataFrame, order: Sequence[str] = ("created_at", "feedback_id"), bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the next version, score changes): each signal moves the four scores, clamped to 0..1 after every step, in order.

    Unknown signals are refused with an error. ``bucket`` is as in ``folds.clamped_sums``.
    """
    moves = F.create_map(*[x for s, v in OVERLAY_DELTAS.items() for x in (F.lit(s), F.array(*map(F.lit, v)))])
    known = F.when(F.col("signal").isin(*OVERLAY_DELTAS), F.col("signal")).otherwise(F.raise_error(F.concat(F.lit("unknown signal "), F.coalesce("signal", F.lit("null")))))
    e = events.withColumn("_m", F.element_at(moves, known))
    e = e.withColumns({f"_{s}": F.get("_m", F.lit(i)) for i, s in enumerate(SCORES)})
    effect = folds.clamped_sums(e, list(KEY), list(order), {f"_e_{s}": f"_{s}" for s in SCORES}, bucket)
    counts = events.groupBy(*KEY).agg(F.count_if(F.col("signal").isin(*FOR)).alias("_for"), F.count_if(F.col("signal").isin(*AGAINST)).alias("_against"), F.count_if(F.col("signal").isin(*REVIEWED)).alias("_review"))
    d = _joined(intelligence, effect.join(counts, list(KEY)))
    after = {s: F.when(F.col("steps").isNull(), F.col(s)).otherwise(folds.apply_clamped(F.col(f"_e_{s}"), F.col(s))) for s in SCORES}
    plus = lambda c, n: (F.col(c) + F.coalesce(n, F.lit(0))).cast("int").alias(c)
    out = d.select(*KEY, F.when(F.col("_review") > 0, "review_required").otherwise(F.col("lifecycle_status")).alias("lifecycle_status"), *[c.alias(s) for s, c in after.items()], plus("support_count", "_for"), plus("contradiction_count", "_against"), plus("lock_version", "steps"))
    moved = d.where("steps is not null").select(*KEY, F.explode(F.array(*[F.struct(F.lit(s).alias("field"), F.col(s).alias("old_value"), c.alias("new_value")) for s, c in after.items()])).alias("x"))
    return out, moved.select(*KEY, "x.*")


def cues(events: DataFrame, stored: DataFrame) -> DataFrame:
    """The cue table after events (KEY, cues array<struct<text,type[,method,confidence]>>): the first MAX_CUES of each event without blank ones,
    one row per target and hash.

    Types outside the vocabulary count as goals, methods outside it as manual; a confidence is kept between 0 and 1 and is 0.7
    where none is given. A cue that is there keeps its text, and the greater of its usefulness and that of a new one. Columns
    that ``stored`` lacks are left out.
    """
    given = events.schema["cues"].dataType.elementType.fieldNames()  # type: ignore[attr-defined]
    e = events.select(*KEY, F.explode(F.slice("cues", 1, MAX_CUES)).alias("c"))
    method = F.col("c.method") if "method" in given else F.lit(None).cast("string")
    sure = F.col("c.confidence").cast("double") if "confidence" in given else F.lit(None).cast("double")
    e = e.select(*KEY, F.trim("c.text").alias("cue_text"), V.or_default(F.col("c.type"), V.CUE_TYPES, "goal").alias("cue_type"), V.or_default(method, V.CUE_METHODS, "manual").alias("extraction_method"), clamp(F.coalesce(sure, F.lit(SURE))).alias("confidence")).where("cue_text <> ''")
    e = e.withColumn("cue_hash", F.sha2(F.concat(F.lower(F.trim("cue_type")), F.lit("\x1f"), F.lower("cue_text")), 256))
    least = F.struct("cue_text", "extraction_method", "confidence")
    new = e.groupBy(*KEY, "cue_hash").agg(F.min(least).alias("x"), F.min("cue_type").alias("cue_type"))
    more = [c for c in ("extraction_method", "confidence") if c in stored.columns]
    new = new.select(*KEY, "cue_hash", "x.cue_text", "cue_type", *[F.col(f"x.{c}").alias(c) for c in more], F.lit(START).alias("_start"))
    columns = [*KEY, "cue_hash", "cue_text", "cue_type", "usefulness", *more]
    old = stored.select(*columns).join(new.select(*KEY, "cue_hash", "_start"), [*KEY, "cue_hash"], "left")
    old = old.withColumn("usefulness", F.greatest("usefulness", "_start")).select(*columns)
    added = new.join(stored.select(*KEY, "cue_hash"), [*KEY, "cue_hash"], "left_anti").withColumnRenamed("_start", "usefulness")
    return old.unionByName(added.select(*columns))
