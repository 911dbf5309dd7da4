"""Sessions, working memory and upkeep over the driver tables (see ``queries``), each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions as S
from ..operators import upkeep as U
from .queries import Tables, query

AT = "2024-01-20 00:00:00"


def now():
    return F.lit(AT).cast("timestamp")


def stamp(c: str):
    return F.col(c).cast("timestamp")


def _sessions(t: Tables) -> DataFrame:
    """Sessions keyed by supplier: every state, some without an end, seen and expiring at dates of their key."""
    k = F.col("s_suppkey")
    state = F.element_at(F.array(*map(F.lit, ("active", "idle", "completed", "failed"))), (k % 4 + 1).cast("int"))
    day = lambda n: (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(n.cast("int"))).cast("timestamp")
    null = lambda kind: F.lit(None).cast(kind)
    return t.supplier.select(
        F.lit("default").alias("tenant"), k.cast("string").alias("session_key"), F.concat(F.lit("id-"), k.cast("string")).alias("session_id"), F.col("s_name").alias("agent_name"),
        F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("task_title"), state.alias("status"), F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")).alias("scope_path"),
        day(k % 7).alias("started_at"), day(k % 30).alias("last_seen_at"), null("timestamp").alias("ended_at"), F.when(k % 5 != 0, day(k % 40)).alias("expires_at"), day(k % 7).alias("created_at"), day(k % 7).alias("updated_at"),
    )


SESSIONS = """s AS (SELECT CAST(s_suppkey AS VARCHAR) AS session_key, 'id-' || s_suppkey AS session_id, s_name AS agent_name, CASE WHEN s_acctbal > 0 THEN s_name END AS task_title, ['active', 'idle', 'completed', 'failed'][s_suppkey % 4 + 1] AS status,
'n/' || s_nationkey AS scope_path, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 30 AS INTEGER)) AS last_seen_at, CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 40 AS INTEGER)) END AS expires_at FROM supplier)"""


@query(f"""WITH {SESSIONS}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS session_key, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS title, c_nationkey FROM customer)
SELECT coalesce(r.session_key, s.session_key) AS session_key, coalesce(c_name, agent_name) AS agent_name, coalesce(title, task_title) AS task_title, CASE WHEN c_name IS NULL THEN status ELSE 'active' END AS status, scope_path,
CASE WHEN c_name IS NULL THEN expires_at ELSE TIMESTAMP '{AT}' + to_days(CASE WHEN c_nationkey = 0 THEN 1 ELSE CAST(c_nationkey AS INTEGER) END) END AS expires_at, s.session_key IS NULL AS inserted FROM s FULL JOIN r ON s.session_key = r.session_key""")
def x09_session_start(t: Tables) -> DataFrame:
    r = t.customer.select(F.lit("default").alias("tenant"), F.col("c_custkey").cast("string").alias("session_key"), F.col("c_name").alias("agent_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("task_title"), F.lit(None).cast("string").alias("scope_path"), F.col("c_nationkey").alias("ttl_days"))
    return S.start(_sessions(t), r, now()).select("session_key", "agent_name", "task_title", "status", "scope_path", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"), "inserted")


@query(f"""WITH {SESSIONS}, r AS (SELECT CAST(l_suppkey AS VARCHAR) AS session_key, CASE WHEN sum(l_quantity) > 15000 THEN 'failed' ELSE 'completed' END AS new FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT session_key, coalesce(new, status) AS status, CASE WHEN new IS NOT NULL THEN TIMESTAMP '{AT}' END AS ended_at, CASE WHEN new IS NOT NULL THEN TIMESTAMP '{AT}' ELSE last_seen_at END AS last_seen_at, new IS NOT NULL AS touched FROM s LEFT JOIN r USING (session_key)""")
def x09_session_close(t: Tables) -> DataFrame:
    r = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("string").alias("session_key")).agg(F.when(F.sum("l_quantity") > 15000, "failed").otherwise("completed").alias("status")).withColumn("tenant", F.lit("default"))
    return S.close(_sessions(t), r, now()).select("session_key", "status", F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), F.col("last_seen_at").cast("timestamp_ntz").alias("last_seen_at"), "touched")


@query(f"WITH {SESSIONS} SELECT session_key, status FROM s WHERE status IN ('active', 'idle') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AT}') ORDER BY last_seen_at DESC, session_key LIMIT 50")
def x09_active_sessions(t: Tables) -> DataFrame:
    return S.list_active(_sessions(t), now()).select("session_key", "status")


def _items(t: Tables) -> DataFrame:
    """Working memory of the conversations' turns, added to an empty table; sessions are the suppliers', by conversation."""
    empty = t.spark.createDataFrame([], "working_memory_id string, tenant string, session_id string, working_memory_fingerprint string, memory_kind string, content string, promotion_status string, promotion_reason string, promotion_target_kind string, promotion_target_id string, promotion_marked_at timestamp, source_segment_id string, source_fact_id string, evidence_segment_id string, expires_at timestamp, created_at timestamp, updated_at timestamp")
    null = F.lit(None).cast("string")
    r = t.conversations.select(F.lit("default").alias("tenant"), F.col("conv_id").cast("string").alias("session_key"), F.col("role").alias("memory_kind"), F.col("text").alias("content"), null.alias("source_segment_id"), null.alias("source_fact_id"), F.when(F.col("role") == "user", F.concat_ws("-", "conv_id", "turn")).alias("evidence_segment_id"), F.col("turn").alias("ttl_days"))
    return S.add_items(empty, _sessions(t), r, now())


@query(rf"""WITH {SESSIONS}, r AS (SELECT CAST(conv_id AS VARCHAR) AS session_key, role, text, CASE WHEN role = 'user' THEN conv_id || '-' || turn END AS evidence FROM conversations)
SELECT DISTINCT session_id, sha256(array_to_string(['default', lower(trim(session_key)), lower(trim(role)), lower(trim(coalesce(text, ''))), '', '', coalesce(evidence, '')], chr(31))) AS mark, 'not_promoted' AS promotion_status FROM r JOIN s USING (session_key)
WHERE status IN ('active', 'idle') AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AT}')""")
def x10_working_add(t: Tables) -> DataFrame:
    return _items(t).select("session_id", F.col("working_memory_fingerprint").alias("mark"), "promotion_status")


def _owned(t: Tables) -> DataFrame:
    """Items keyed by event, of the suppliers' sessions, some expired, some without evidence."""
    null = F.lit(None).cast("string")
    return t.events.select(
        F.col("event_id").cast("string").alias("working_memory_id"), F.lit("default").alias("tenant"), F.concat(F.lit("id-"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(F.col("event_type") == "purchase", "promoted").otherwise("not_promoted").alias("promotion_status"), null.alias("promotion_reason"), null.alias("promotion_target_kind"), null.alias("promotion_target_id"), F.lit(None).cast("timestamp").alias("promotion_marked_at"),
        F.when(F.col("event_type") == "click", "seg").alias("source_segment_id"), null.alias("source_fact_id"), F.when(F.col("event_type") == "view", "seg").alias("evidence_segment_id"), stamp("ts").alias("expires_at"), stamp("ts").alias("created_at"), stamp("ts").alias("updated_at"),
    )


@query(f"""WITH {SESSIONS} SELECT event_id, CASE WHEN status IN ('completed', 'failed') AND ts > TIMESTAMP '2024-01-10' AND event_type IN ('click', 'view') THEN 'promotion_candidate' WHEN event_type = 'purchase' THEN 'promoted' ELSE 'not_promoted' END AS promotion_status
FROM events LEFT JOIN s ON s.session_id = 'id-' || user_id""")
def f21_promotion_guard(t: Tables) -> DataFrame:
    items = _owned(t)
    r = items.select("tenant", "working_memory_id", F.lit("useful").alias("promotion_reason"), F.lit("fact").alias("promotion_target_kind"), F.lit("f").alias("promotion_target_id"))
    return S.mark_candidates(items, _sessions(t), r, F.lit("2024-01-10").cast("timestamp")).select(F.col("working_memory_id").cast("long").alias("event_id"), "promotion_status")


@query("""SELECT event_id, CASE WHEN d.event_id IS NOT NULL THEN 'expired' WHEN event_type = 'purchase' THEN 'promoted' ELSE 'not_promoted' END AS promotion_status FROM events e
LEFT JOIN (SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type <> 'purchase' ORDER BY ts, CAST(event_id AS VARCHAR) LIMIT 500) d USING (event_id)""")
def x10_working_expire(t: Tables) -> DataFrame:
    return S.expire(_owned(t), F.lit("2024-01-10").cast("timestamp")).select(F.col("working_memory_id").cast("long").alias("event_id"), "promotion_status")


@query(f"""WITH {SESSIONS} SELECT event_id, session_key FROM events JOIN s ON s.session_id = 'id-' || user_id WHERE ts > TIMESTAMP '2024-01-10' AND event_type = 'purchase' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 200""")
def j30_working_items(t: Tables) -> DataFrame:
    d = S.list_items(_owned(t), _sessions(t), F.lit("2024-01-10").cast("timestamp"), status="promoted", limit=200)
    return d.select(F.col("working_memory_id").cast("long").alias("event_id"), "session_key")


@query("""SELECT 'doc:' || doc_id AS source_key, coalesce('sup-' || s_suppkey, substr(sha256('default' || chr(31) || 'doc:' || doc_id), 1, 32)) AS artifact_id, s_suppkey IS NULL AS created FROM documents LEFT JOIN supplier ON s_suppkey = doc_id""")
def k01_ensure_artifacts(t: Tables) -> DataFrame:
    known = t.supplier.select(F.lit("default").alias("tenant"), F.concat(F.lit("doc:"), F.col("s_suppkey").cast("string")).alias("source_key"), F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("artifact_id"))
    items = t.documents.select(F.lit("default").alias("tenant"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_key"), F.lit("note").alias("source_type"), F.lit("p").alias("original_path"), F.col("text").alias("content"), F.col("source").alias("scope_path"))
    return U.ensure_artifacts(known, items)[0].drop("tenant")


@query("""SELECT DISTINCT l_suppkey AS target_id, l_returnflag AS reason FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0 AND l_returnflag = 'R')""")
def k10_new_reviews(t: Tables) -> DataFrame:
    kind = F.lit("artifact").alias("target_type")
    queue = t.supplier.select(kind, F.col("s_suppkey").alias("target_id"), F.lit("R").alias("reason"), F.when(F.col("s_acctbal") > 0, "pending").otherwise("approved").alias("status"))
    return U.new_reviews(queue, t.lineitem.select(kind, F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("reason"))).select("target_id", "reason")


def _memories(t: Tables) -> DataFrame:
    """Memories keyed by order: published, draft or retired; support, contradictions and last support from the order."""
    state = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "draft").otherwise("retired")
    n = lambda m: (F.col("o_custkey") % m).cast("int")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("memory_id"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("fingerprint"), F.col("o_orderpriority").alias("narrative"), state.alias("lifecycle_state"), n(4).alias("support_count"), n(3).alias("contradiction_count"),
        (F.col("o_totalprice") / 1000000).cast("double").alias("confidence"), stamp("o_orderdate").alias("last_supported_at"), F.concat(F.lit("infra/"), (F.col("o_custkey") % 9).cast("string")).alias("scope_path"),
        F.when(F.col("o_custkey") % 2 == 0, "active").otherwise("validated").alias("governance_status"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_totalprice") / 400000).cast("double").alias("quality_score"), stamp("o_orderdate").alias("updated_at"), stamp("o_orderdate").alias("created_at"),
    )


LATE = "1997-06-01"
MEMORIES = f"""m AS (SELECT CAST(o_orderkey AS VARCHAR) AS memory_id, 'T' || o_custkey AS title, o_orderpriority AS narrative, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'retired' END AS state, o_custkey % 4 AS support, o_custkey % 3 AS against, o_totalprice / 1000000 AS confidence,
CAST(o_orderdate AS TIMESTAMP) AS last, 'infra/' || (o_custkey % 9) AS scope, CASE WHEN o_custkey % 2 = 0 THEN 'active' ELSE 'validated' END AS gov, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 400000 END AS quality FROM orders),
x AS (SELECT *, state = 'published' AND (last IS NULL OR last < TIMESTAMP '{LATE}' - INTERVAL 180 DAY) AS is_stale FROM m)"""


@query(f"""WITH {MEMORIES} SELECT count(*) AS total, count(*) FILTER (state = 'published') AS published, count(*) FILTER (state = 'draft') AS draft, count(*) FILTER (state = 'retired') AS retired, count(*) FILTER (support = 0 AND state <> 'retired') AS unsupported, count(*) FILTER (is_stale) AS stale,
CAST(sum(against) AS BIGINT) AS contradictions, CAST(sum(strlen(title) + strlen(narrative)) AS BIGINT) AS bytes, round(unsupported / total, 2) AS unsupported_ratio, round(stale / total, 2) AS stale_ratio, least(round(contradictions / total, 2), 1.0) AS contradictions_ratio FROM x""")
def c13_memory_usage(t: Tables) -> DataFrame:
    return U.usage(_memories(t), F.lit(LATE).cast("timestamp")).drop("avg_confidence")


@query(f"""WITH {MEMORIES}, h AS (SELECT CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'infra' ELSE 'infra/' || n_nationkey END AS scope, n_nationkey AS n, n_nationkey / 25.0 AS risk FROM nation), lh AS (SELECT scope, arg_max(risk, n) AS risk FROM h GROUP BY 1),
c AS (SELECT memory_id, title, scope, CASE WHEN against > support THEN 'retire' WHEN is_stale THEN 'demote' WHEN support = 0 THEN 'refresh' END AS proposal_type FROM x WHERE state <> 'retired'), r AS (SELECT memory_id, max(lh.risk) AS risk FROM c JOIN lh ON starts_with(c.scope, lh.scope) GROUP BY 1)
SELECT memory_id, title, proposal_type, round(least(greatest(CASE proposal_type WHEN 'retire' THEN 0.9 WHEN 'demote' THEN 0.7 ELSE 0.5 END, coalesce(risk, 0)), 1), 2)::DOUBLE AS risk_score FROM c LEFT JOIN r USING (memory_id) WHERE proposal_type IS NOT NULL""")
def c16_retention(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    health = t.nation.select(F.when(k % 5 == 0, None).when(k % 5 == 1, "infra").otherwise(F.concat(F.lit("infra/"), k.cast("string"))).alias("scope_path"), (k / 25).alias("risk_score"), k.alias("assessed_at"))
    queue = t.spark.createDataFrame([], "target_type string, target_id string, reason string, status string")
    return U.retention(_memories(t), health, queue, F.lit(LATE).cast("timestamp")).drop("reason")


@query(f"""WITH {MEMORIES} SELECT memory_id, CASE WHEN state = 'published' AND last < TIMESTAMP '{LATE}' - INTERVAL 6 MONTH AND NOT EXISTS (SELECT 1 FROM lineitem WHERE CAST(l_orderkey AS VARCHAR) = memory_id AND l_linestatus = 'F' AND l_quantity > 45) THEN 'draft' ELSE state END AS state FROM m""")
def c04_stale_demotion(t: Tables) -> DataFrame:
    support = t.lineitem.select(F.col("l_orderkey").cast("string").alias("memory_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"))
    facts = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("fact_id"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45), 1).otherwise(5).alias("priority"))
    return U.demote_stale(_memories(t), support, facts, F.lit(LATE).cast("timestamp")).select("memory_id", F.col("lifecycle_state").alias("state"))


@query(f"""WITH {MEMORIES} SELECT memory_id, CASE WHEN gov = 'active' AND coalesce(quality, confidence, 0) < 0.3 AND last < TIMESTAMP '{LATE}' - INTERVAL 30 DAY THEN 'archived' ELSE gov END AS status FROM m""")
def c20_compaction(t: Tables) -> DataFrame:
    return U.compact(_memories(t), F.lit(LATE).cast("timestamp")).select("memory_id", F.col("governance_status").alias("status"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 49 THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'O' THEN 3 WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 4 ELSE 5 END AS priority FROM lineitem""")
def c24_priority(t: Tables) -> DataFrame:
    cls = F.when(F.col("l_linestatus") == "O", "corroborated_llm").when(F.col("l_returnflag") == "A", "deterministic").otherwise("single_source_llm")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", U.priority(F.col("l_quantity") > 49, F.when(F.col("l_returnflag") == "R", "P1"), cls).alias("priority"))


@query("""WITH d AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN ' N/A ' WHEN 2 THEN ts + INTERVAL 10 YEAR WHEN 3 THEN make_timestamp(2021, 3, CAST(event_id % 28 + 1 AS INT), 0, 0, 0.0) ELSE ts END AS a, event_id % 6 AS k, ts FROM (SELECT event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, 1 AS one FROM events))
SELECT event_id, CASE WHEN k = 3 THEN least(x, y) ELSE x END AS started, CASE WHEN k = 3 THEN greatest(x, y) ELSE y END AS ended FROM (SELECT event_id, k, CASE WHEN k IN (0, 1, 2) THEN NULL WHEN k = 3 THEN make_timestamp(2021, 3, CAST(event_id % 28 + 1 AS INT), 0, 0, 0.0) ELSE ts END AS x, make_timestamp(2021, 3, 15, 0, 0, 0.0) AS y FROM (SELECT event_id, event_id % 6 AS k, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM events)) q WHERE k <> 4 AND k <> 5
UNION ALL SELECT event_id, TIMESTAMP '2021-03-15', CAST(date_trunc('second', ts) AS TIMESTAMP) FROM events WHERE event_id % 6 IN (4, 5)""")
def c27_date_ranges(t: Tables) -> DataFrame:
    k, at = F.col("event_id") % 6, F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss")
    far = F.date_format(F.date_trunc("second", F.add_months("ts", 120)), "yyyy-MM-dd HH:mm:ss")
    us = F.format_string("3/%d/2021", (F.col("event_id") % 28 + 1).cast("int"))
    said = F.when(k == 0, None).when(k == 1, " N/A ").when(k == 2, far).when(k == 3, us).otherwise(at)
    r = t.events.select("event_id", U.date_range(said, F.lit("2021-03-15")).alias("r"))
    return r.select("event_id", F.col("r.start").cast("timestamp_ntz").alias("started"), F.col("r.end").cast("timestamp_ntz").alias("ended"))


_CASES = """c AS (SELECT c_custkey AS id, c_mktsegment AS device, c_acctbal / 10000 AS f1, c_nationkey / 10.0 AS ratio, CASE WHEN c_nationkey % 3 <> 0 THEN c_acctbal > 0 END AS root, CASE WHEN c_nationkey % 4 <> 0 THEN c_acctbal > 5000 END AS fix FROM customer)"""


def _cases(t: Tables) -> DataFrame:
    n = F.col("c_nationkey")
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("device"), (F.col("c_acctbal") / 10000).cast("double").alias("entity_f1"), (n / 10).alias("fact_ratio"), F.when(n % 3 != 0, F.col("c_acctbal") > 0).alias("root_cause"), F.when(n % 4 != 0, F.col("c_acctbal") > 5000).alias("fix_summary"))


@query(f"WITH {_CASES} SELECT device, count(*) AS cases, round(avg(f1), 9) AS avg_entity_f1, round(avg(ratio), 9) AS avg_fact_ratio, round(coalesce(avg(root::INT), 0), 9) AS root_cause_rate, round(coalesce(avg(fix::INT), 0), 9) AS fix_summary_rate FROM c GROUP BY 1")
def a15_eval_totals(t: Tables) -> DataFrame:
    d = U.eval_totals(_cases(t), "device")
    return d.select("device", "cases", *[F.round(c, 9).alias(c) for c in d.columns[2:]])


@query(f"WITH {_CASES} SELECT * FROM (SELECT id, 'worst' AS side, row_number() OVER (ORDER BY f1, id) AS place FROM c UNION ALL SELECT id, 'best', row_number() OVER (ORDER BY f1 DESC, id DESC) FROM c) WHERE place <= 5")
def t11_extreme_cases(t: Tables) -> DataFrame:
    return U.extremes(_cases(t), "entity_f1", "id").select("id", "side", "place")
