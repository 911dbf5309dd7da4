"""Lifecycle operators over the driver tables: events are feedback on users, orders ask for states, conversations bring cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import OVERLAY_DELTAS
from ..functions import vocabulary as V
from ..operators import lifecycle
from .queries import Tables, query

SIGNALS = {"click": "injected_referenced", "purchase": "led_to_success", "error": "led_to_failure", "signup": "user_confirmed"}
OTHER = "injected_ignored"


def _signal():
    out = F.lit(OTHER)
    for kind, signal in SIGNALS.items():
        out = F.when(F.col("event_type") == kind, signal).otherwise(out)
    return out


def _known(t: Tables) -> DataFrame:
    """What is known of customers with a debt: scores by nation, a count each."""
    share = (F.col("c_nationkey") / 25).cast("double")
    return t.customer.where("c_acctbal < 0").select(
        F.lit("default").alias("tenant"), F.lit("fact").alias("target_kind"), F.col("c_custkey").cast("string").alias("target_id"), F.when(F.col("c_nationkey") < 3, "suppressed").otherwise("active").alias("lifecycle_status"),
        *[share.alias(s) for s in lifecycle.SCORES], F.lit(1).alias("support_count"), F.lit(2).alias("contradiction_count"), F.lit(5).alias("lock_version"))


def _delta(i: int) -> str:
    cases = " ".join(f"WHEN '{kind}' THEN {OVERLAY_DELTAS[s][i]}" for kind, s in SIGNALS.items())
    return f"CAST(CASE event_type {cases} ELSE {OVERLAY_DELTAS[OTHER][i]} END AS DOUBLE)"


@query(f"""WITH RECURSIVE k AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_nationkey < 3 THEN 'suppressed' ELSE 'active' END AS st, c_nationkey / 25.0::DOUBLE AS s FROM customer WHERE c_acctbal < 0),
e AS (SELECT CAST(user_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {', '.join(f'{_delta(i)} AS d{i}' for i in range(4))} FROM events),
f AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, {', '.join(f'coalesce(s, 0.5)::DOUBLE AS s{i}' for i in range(4))} FROM e LEFT JOIN k USING (id) UNION ALL SELECT e.id, e.n, {', '.join(f'greatest(0.0, least(1.0, f.s{i} + e.d{i}))' for i in range(4))} FROM f JOIN e ON e.id = f.id AND e.n = f.n + 1),
z AS (SELECT id, max(n) AS steps, {', '.join(f'arg_max(s{i}, n) AS s{i}' for i in range(4))} FROM f GROUP BY 1),
c AS (SELECT CAST(user_id AS VARCHAR) AS id, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS up, count(*) FILTER (event_type = 'error') AS down FROM events GROUP BY 1)
SELECT coalesce(k.id, z.id) AS target_id, CASE WHEN down > 0 THEN 'review_required' ELSE coalesce(st, 'active') END AS lifecycle_status, round(coalesce(s0, s), 6) AS salience, round(coalesce(s1, s), 6) AS strength, round(coalesce(s2, s), 6) AS stability, round(coalesce(s3, s), 6) AS quality,
CASE WHEN k.id IS NULL THEN 0 ELSE 1 END + coalesce(up, 0) AS support_count, CASE WHEN k.id IS NULL THEN 0 ELSE 2 END + coalesce(down, 0) AS contradiction_count, CASE WHEN k.id IS NULL THEN 0 ELSE 5 END + coalesce(steps, 0) AS lock_version FROM k FULL JOIN z ON z.id = k.id LEFT JOIN c ON c.id = z.id""")
def x06_feedback_scores(t: Tables) -> DataFrame:
    e = t.events.select(F.lit("default").alias("tenant"), F.lit("fact").alias("target_kind"), F.col("user_id").cast("string").alias("target_id"), _signal().alias("signal"), "ts", "event_id")
    out, _ = lifecycle.feedback(_known(t), e, ("ts", "event_id"), F.to_date("ts"))
    whole = [F.col(c).cast("long").alias(c) for c in ("support_count", "contradiction_count", "lock_version")]
    return out.select("target_id", "lifecycle_status", *[F.round(s, 6).alias(s) for s in lifecycle.SCORES], *whole)


@query("""WITH r AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'retired' ELSE 'suppressed' END, (o_orderdate, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'retired' ELSE 'suppressed' END)) AS s, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT c_custkey, CASE WHEN c_nationkey < 3 THEN 'suppressed' ELSE 'active' END AS st FROM customer WHERE c_acctbal < 0)
SELECT CAST(coalesce(c_custkey, o_custkey) AS VARCHAR) AS target_id, coalesce(s, st) AS lifecycle_status, CASE WHEN c_custkey IS NULL THEN 0 ELSE 5 END + coalesce(n, 0) AS lock_version, CASE WHEN s IS NOT NULL THEN '{"before":"' || coalesce(st, 'active') || '","after":"' || s || '"}' END AS details FROM k FULL JOIN r ON o_custkey = c_custkey""")
def x07_status_changes(t: Tables) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "retired").otherwise("suppressed")
    r = t.orders.select(F.lit("default").alias("tenant"), F.lit("fact").alias("target_kind"), F.col("o_custkey").cast("string").alias("target_id"), state.alias("status"), F.col("o_orderdate").alias("asked_at"))
    out, audit = lifecycle.set_status(_known(t), r)
    return out.join(audit.select("target_id", "details"), "target_id", "left").select("target_id", "lifecycle_status", F.col("lock_version").cast("long").alias("lock_version"), "details")


@query("SELECT CAST(c_custkey AS VARCHAR) AS target_id FROM customer WHERE NOT (c_acctbal < 0) ORDER BY 1 LIMIT 1000")
def x08_backfill(t: Tables) -> DataFrame:
    objects = t.customer.select(F.lit("default").alias("tenant"), F.col("c_custkey").cast("string").alias("fact_id"))
    return lifecycle.missing(_known(t), "fact", objects, "fact_id").select("target_id")


@query(r"""WITH c AS (SELECT conv_id, trim(unnest(list_slice(str_split(text, '.'), 1, 25))) AS t FROM conversations), n AS (SELECT conv_id, sha256('goal' || chr(31) || lower(t)) AS cue_hash, min(t) AS cue_text FROM c WHERE t <> '' GROUP BY 1, 2)
SELECT CAST(conv_id AS VARCHAR) AS target_id, cue_hash, cue_text FROM n""")
def x03_cues(t: Tables) -> DataFrame:
    parts = F.transform(F.split("text", r"\."), lambda x: F.struct(x.alias("text"), F.lit(None).cast("string").alias("type")))
    e = t.conversations.select(F.lit("default").alias("tenant"), F.lit("episode").alias("target_kind"), F.col("conv_id").cast("string").alias("target_id"), parts.alias("cues"))
    stored = t.spark.createDataFrame([], "tenant string, target_kind string, target_id string, cue_hash string, cue_text string, cue_type string, usefulness double")
    return lifecycle.cues(e, stored).select("target_id", "cue_hash", "cue_text")


_CUE = "SELECT event_id, user_id, event_type || ' ' || (event_id % 40) AS t, CASE event_type WHEN 'error' THEN 'failure_mode' WHEN 'click' THEN 'action' ELSE 'goal' END AS k, CASE WHEN event_id % 3 = 0 THEN 'llm' ELSE 'manual' END AS m, CAST(CASE WHEN event_id % 5 = 0 THEN 0.7 ELSE least(1.0, value / 50) END AS DOUBLE) AS c FROM events"


@query(f"""WITH e AS ({_CUE}), n AS (SELECT user_id, sha256(k || chr(31) || lower(t)) AS h, min({{'t': t, 'm': m, 'c': round(c, 6)}}) AS x, min(k) AS k FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2),
o AS (SELECT user_id, sha256(k || chr(31) || lower(t)) AS h, min(t) AS t, min(k) AS k, CASE WHEN user_id % 2 = 0 THEN 0.9 ELSE 0.1 END AS u FROM e WHERE event_id % 2 = 0 GROUP BY user_id, k, lower(t))
SELECT CAST(coalesce(n.user_id, o.user_id) AS VARCHAR) AS target_id, coalesce(o.t, x.t) AS cue_text, coalesce(o.k, n.k) AS cue_type, CASE WHEN o.h IS NULL THEN x.m ELSE 'template' END AS extraction_method, CAST(CASE WHEN o.h IS NULL THEN x.c ELSE 0.25 END AS DOUBLE) AS confidence,
CAST(CASE WHEN o.h IS NULL THEN 0.5 WHEN n.h IS NULL THEN u ELSE greatest(u, 0.5) END AS DOUBLE) AS usefulness FROM n FULL JOIN o ON n.user_id = o.user_id AND n.h = o.h""")
def x03_cue_vocabulary(t: Tables) -> DataFrame:
    """Cues of odd events over those of even ones: types and methods outside the vocabulary, confidences, the greater usefulness."""
    e, i = t.events, F.col("event_id")
    text = F.concat_ws(" ", "event_type", i % 40)
    kind = F.when(F.col("event_type") == "error", "failure_mode").when(F.col("event_type") == "click", "action").otherwise(F.col("event_type"))
    key = [F.lit("default").alias("tenant"), F.lit("fact").alias("target_kind"), F.col("user_id").cast("string").alias("target_id")]
    cue = F.struct(text.alias("text"), kind.alias("type"), F.when(i % 3 == 0, "llm").otherwise("guess").alias("method"), F.when(i % 5 != 0, F.round(F.col("value") / 50, 6)).alias("confidence"))
    known = F.when(F.col("event_type").isin("error", "click"), kind).otherwise("goal")
    stored = e.where(i % 2 == 0).select(*key, "user_id", text.alias("cue_text"), known.alias("cue_type")).distinct()
    mark = F.sha2(F.concat("cue_type", F.lit("\x1f"), F.lower("cue_text")), 256)
    stored = stored.withColumns({"cue_hash": mark, "usefulness": F.when(F.col("user_id") % 2 == 0, 0.9).otherwise(0.1), "extraction_method": F.lit("template"), "confidence": F.lit(0.25)})
    d = lifecycle.cues(e.where(i % 2 == 1).select(*key, F.array(cue).alias("cues")), stored)
    return d.select("target_id", "cue_text", "cue_type", "extraction_method", F.round("confidence", 6).alias("confidence"), "usefulness")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'fact_inserted' WHEN event_type = 'click' THEN 'tool_called' ELSE event_type END AS t, [NULL, 'fact', 'memory', 'working_memory', 'planet'][event_id % 5 + 1] AS k, event_id % 7 = 0 AS lone, event_id % 3 AS r FROM events)
SELECT event_id, CASE WHEN t NOT IN ('fact_inserted', 'tool_called') THEN 'event type' WHEN k = 'planet' THEN 'target kind' WHEN (k IS NULL) <> (lone OR k IS NULL) THEN 'pair' WHEN k = 'memory' THEN 'durable' WHEN k = 'fact' AND NOT (t = 'fact_inserted' AND r = 1) THEN 'proof' END AS reason FROM e""")
def f24_event_validation(t: Tables) -> DataFrame:
    """Why each event would be refused: its type, its target's kind, half a target, or the evidence boundary."""
    i = F.col("event_id")
    kind = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, ("fact", "memory", "working_memory", "planet"))), (i % 5).cast("int"))
    e = t.events.select(i, F.when(F.col("event_type") == "error", "fact_inserted").when(F.col("event_type") == "click", "tool_called").otherwise(F.col("event_type")).alias("t"), kind.alias("k"))
    target = F.when((i % 7 != 0) & F.col("k").isNotNull(), F.concat(F.lit("id-"), i))
    refs = F.when(i % 3 == 1, F.lit('[{"note": 1}, {"segment_id": "s"}]')).when(i % 3 == 2, F.lit('[{"segment_id": " "}, {"segment_id": 5}, "x"]'))
    d = e.withColumns({"target": target, "refs": refs})
    checks = {"event type": V.choice(F.col("t"), V.EVENT_TYPES, "event type"), "target kind": V.choice(F.col("k"), V.TARGET_KINDS, "target kind"), "pair": V.target_pair(F.col("k"), F.col("target"))}
    boundary = V.creation(F.col("t"), F.col("k"), F.col("refs"))
    named = [F.when(c.isNotNull(), n) for n, c in checks.items()]
    return d.select("event_id", V.first_reason(*named, F.when(boundary.contains("durable"), "durable").when(boundary.isNotNull(), "proof")).alias("reason"))
