"""Loading, reviews, tags, notes and coverage over the driver tables. Orders are the items of a load, line items their facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import schema
from ..operators import ingest, review
from ..operators.written import written
from .queries import Tables, query


def _now():
    return F.lit("2024-01-15").cast("timestamp")


def _text(c: str):
    return F.col(c).cast("string")


def _bytes(c: str):
    """The bytes of an id in hexadecimal digits."""
    return F.unhex(c).alias(c)


def _items(t: Tables) -> DataFrame:
    """One item per order: an episode, one segment, and a fact for each line; lines with a large discount have no valid confidence."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    fact = lambda x: F.struct(
        F.concat(F.lit("part "), x["l_partkey"].cast("string")).alias("subject"), x["l_returnflag"].alias("predicate"), x["l_linestatus"].alias("value"), F.when(x["l_quantity"] > 25, "cause").otherwise("impact").alias("kind"),
        F.lit("deterministic").alias("assertion_class"), (x["l_discount"] * 12.5).cast("double").alias("confidence"), F.array(F.lit(0)).alias("segments"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("map<string,string>").alias("meta"))
    d = t.orders.join(lines, "o_orderkey", "left")
    none = F.lit(None).cast("string")
    episode = F.struct(F.lit("order").alias("type"), F.concat(F.lit("Order "), _text("o_orderkey")).alias("title"), none.alias("start"), none.alias("end"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").alias("severity"), F.col("o_orderstatus").alias("outcome"), none.alias("summary"))
    segment = F.struct(F.lit(0).alias("ordinal"), F.lit("all").alias("label"), F.col("o_orderpriority").alias("content"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"))
    kind = F.when(F.col("o_orderstatus") == "P", "project_doc_draft").when(F.col("o_orderstatus") == "F", "pai_auto_memory").otherwise("note")
    return d.select(
        F.lit("default").alias("tenant"), F.concat(F.lit("order:"), _text("o_orderkey")).alias("source_key"), kind.alias("source_type"), F.lit("p").alias("original_path"), F.col("o_orderpriority").alias("content"), F.lit("orders").alias("scope_path"), episode.alias("episode"),
        F.array().cast("array<struct<name:string,type:string>>").alias("entities"), F.array(segment).alias("segments"), F.transform(F.coalesce("lines", F.array()), fact).alias("facts"))


def _stored(t: Tables) -> dict[str, DataFrame]:
    """The tables before the load: a fact for each supplier, some of which the load brings again."""
    # The filter tells the planner that they are empty.
    tables = {name: t.spark.createDataFrame([], schema(name)).where(F.lit(False)) for name in ingest.TABLES}
    subject = F.concat(F.lit("part "), _text("s_suppkey"))
    mark = F.sha2(F.concat(subject, F.lit('|R|"F"')), 256)
    old = t.supplier.select(F.concat(F.lit("old-"), _text("s_suppkey")).alias("fact_id"), F.lit("default").alias("tenant"), F.lit("cause").alias("fact_kind"), F.lit("R").alias("predicate"), F.lit("F").alias("object_value"), mark.alias("canonical_fingerprint"), F.lit("run-0").alias("created_run_id"))
    tables["fact"] = tables["fact"].unionByName(old, allowMissingColumns=True).select(*tables["fact"].columns)
    return tables


FACTS = """f AS (SELECT 'order:' || l_orderkey AS source_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_linestatus) AS place, 'part ' || l_partkey AS subject, l_returnflag AS predicate, l_linestatus AS value,
CASE WHEN l_quantity > 25 THEN 'cause' ELSE 'impact' END AS kind, l_discount * 12.5 <= 1 AS ok, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 4 END AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT * FROM f WHERE ok AND NOT (kind = 'cause' AND predicate = 'R' AND value = 'F' AND subject IN (SELECT 'part ' || s_suppkey FROM supplier)) QUALIFY row_number() OVER (PARTITION BY subject, predicate, value, kind ORDER BY source_key, place) = 1)"""


@query(f"""WITH {FACTS} SELECT source_key, subject, predicate, value, kind, priority, 1 AS n_evidence, sha256(subject || '|' || predicate || '|"' || value || '"') AS fingerprint FROM n""")
def k02_load_facts(t: Tables) -> DataFrame:
    out = ingest.load(_stored(t), _items(t), _now(), keep=written)
    # Ids are compared as bytes, half as wide as their digits; facts meet the largest tables by their ids alone.
    run, entity = out["extraction_run"].select(_bytes("run_id"), _bytes("artifact_id")), out["entity"].select(_bytes("entity_id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))
    runs = run.join(out["artifact"].select(_bytes("artifact_id"), "source_key"), "artifact_id").select(F.col("run_id").alias("created_run_id"), "source_key")
    facts = out["fact"].select(*[_bytes(c) for c in ("fact_id", "created_run_id", "subject_entity_id", "canonical_fingerprint")], "predicate", "object_value", "fact_kind", "priority")
    proof = out["fact_evidence"].groupBy(_bytes("fact_id")).agg(F.count("*").alias("n_evidence"))
    d = facts.join(runs, "created_run_id").join(entity, "subject_entity_id").join(proof, "fact_id", "left")
    return d.select("source_key", "subject", "predicate", F.col("object_value").alias("value"), F.col("fact_kind").alias("kind"), "priority", "n_evidence", F.lower(F.hex("canonical_fingerprint")).alias("fingerprint"))


@query(f"""WITH {FACTS} SELECT 'entity' AS name, count(DISTINCT subject) AS n FROM n UNION ALL SELECT 'fact', count(*) + (SELECT count(*) FROM supplier) FROM n UNION ALL SELECT 'fact_evidence', count(*) FROM n UNION ALL SELECT 'rejected', count(*) FROM f WHERE NOT ok
UNION ALL SELECT 'review_queue', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT unnest(['artifact', 'episode', 'extraction_run', 'segment']), (SELECT count(*) FROM orders)""")
def k24_load_counters(t: Tables) -> DataFrame:
    out = ingest.load(_stored(t), _items(t), _now(), keep=written)
    parts = [out[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in (*ingest.TABLES, "rejected") if name != "memory_support"]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("SELECT 'doc:' || doc_id AS source_key, 'source_too_large' AS reason, coalesce(source, 'incident:doc:' || doc_id) AS scope_path FROM documents WHERE strlen(text) > 2000")
def k17_oversized(t: Tables) -> DataFrame:
    items = t.documents.select(F.lit("default").alias("tenant"), F.concat(F.lit("doc:"), _text("doc_id")).alias("source_key"), F.lit("incident_note").alias("source_type"), F.lit("p").alias("original_path"), F.col("text").alias("content"), F.col("source").alias("scope_path"))
    items = t.spark.createDataFrame([], ingest.ITEM).unionByName(items, allowMissingColumns=True)
    tables = {name: t.spark.createDataFrame([], schema(name)) for name in ingest.TABLES}
    out = ingest.load(tables, items, _now(), max_bytes=2000)
    a = out["artifact"].where("preservation_state = 'pending_escalation'").select(F.col("artifact_id").alias("target_id"), "source_key", "scope_path")
    return out["review_queue"].join(a, "target_id").select("source_key", "reason", "scope_path")


def _queue(t: Tables) -> DataFrame:
    """A review of every order: pending, approved or rejected."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    return t.orders.select(_text("o_orderkey").alias("review_id"), F.lit("artifact").alias("target_type"), _text("o_orderkey").alias("target_id"), F.lit("check").alias("reason"), status.alias("status"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS review_id, o_orderpriority AS source_type, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O') AS fact_count FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 200""")
def j29_review_list(t: Tables) -> DataFrame:
    artifacts = t.orders.select(_text("o_orderkey").alias("artifact_id"), F.col("o_orderpriority").alias("source_type"), _text("o_orderkey").alias("source_key"), F.lit("s").alias("scope_path"))
    runs = t.orders.select(F.concat(F.lit("r"), _text("o_orderkey")).alias("run_id"), _text("o_orderkey").alias("artifact_id"))
    facts = t.lineitem.select(F.concat(F.lit("r"), _text("l_orderkey")).alias("created_run_id"), F.when(F.col("l_linestatus") == "O", "active").otherwise("retired").alias("current_status"))
    return review.listed(_queue(t), artifacts, runs, facts, "check", limit=200).select("review_id", "source_type", "fact_count")


@query("""WITH q AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS s, CASE WHEN o_custkey % 3 = 0 THEN 'approved' WHEN o_custkey % 3 = 1 THEN 'rejected' END AS w FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CASE WHEN s = 'pending' AND w IS NOT NULL OR s = 'approved' AND w = 'rejected' THEN w ELSE s END AS status, coalesce(s = 'pending' AND w IS NOT NULL OR s = 'approved' AND w = 'rejected', false) AS touched FROM q""")
def c30_review_decisions(t: Tables) -> DataFrame:
    wish = F.when(F.col("o_custkey") % 3 == 0, "approved").when(F.col("o_custkey") % 3 == 1, "rejected")
    return review.decide(_queue(t), t.orders.select(_text("o_orderkey").alias("review_id"), wish.alias("status")).where("status is not null"), _now()).select("review_id", "status", "touched")


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS m, CAST(p_size AS VARCHAR) AS p FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 30 UNION SELECT l_orderkey, CAST(s_nationkey AS VARCHAR) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity < 3),
c AS (SELECT m, count(*) AS n, min(p) AS p FROM s WHERE CAST(p AS INTEGER) < 20 GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS memory_id, CASE WHEN n = 1 THEN p END AS project_id, coalesce(n, 0) AS n_projects FROM orders LEFT JOIN c ON m = o_orderkey""")
def c26_project_tags(t: Tables) -> DataFrame:
    memories = t.orders.select(_text("o_orderkey").alias("memory_id"))
    few, many = F.col("l_quantity") < 3, F.col("l_quantity") > 30
    support = t.lineitem.where(few | many).select(_text("l_orderkey").alias("memory_id"), F.when(many, _text("l_partkey")).alias("fact_id"), F.when(few, _text("l_suppkey")).alias("episode_id"))
    facts = t.part.select(_text("p_partkey").alias("fact_id"), _text("p_size").alias("project_id"))
    episodes = t.supplier.select(_text("s_suppkey").alias("episode_id"), _text("s_nationkey").alias("project_id"))
    projects = t.part.where("p_size < 20").select(_text("p_size").alias("project_id")).union(t.nation.where("n_nationkey < 20").select(_text("n_nationkey"))).distinct()
    return review.project_tags(memories, support, facts, episodes, projects)


@query("SELECT p_brand AS project_id, list(DISTINCT p_type ORDER BY p_type) AS services FROM part GROUP BY 1")
def a30_services(t: Tables) -> DataFrame:
    return review.services(t.part.select(F.col("p_brand").alias("project_id"), F.col("p_type").alias("service_name")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def f19_unarchived(t: Tables) -> DataFrame:
    projects = t.customer.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_acctbal") < 0, "archived").alias("status"))
    return review.unarchived(t.orders.select("o_orderkey", F.col("o_custkey").alias("project_id")), projects).select("o_orderkey")


@query("""WITH f AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, * FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N') AND l_quantity > 10), e AS (SELECT id, max_by(seg, (w, seg)) AS seg FROM
(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS id, 'g' || l_suppkey AS seg, l_discount AS w FROM lineitem) GROUP BY 1), u AS (SELECT DISTINCT id, CAST(l_orderkey AS VARCHAR) AS ep, l_shipdate, o_orderdate, l_discount, CASE l_returnflag WHEN 'A' THEN 'cause' ELSE 'decision' END AS k, l_linestatus AS a, o_orderpriority AS v FROM f)
SELECT id AS source_fact_id, ep AS episode_id, CAST(coalesce(l_shipdate, o_orderdate) AS TIMESTAMP) AS time_start, CASE WHEN k = 'decision' THEN v END AS outcome, sha256('event-frame-v1|tenant=default|episode=' || ep || '|fact=' || id || '|event_type=' || k || '|action=' || a || '|scope=s') AS frame_fingerprint
FROM u ORDER BY 3, l_discount DESC, id LIMIT 500""")
def c10_event_frames(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("fact_id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "cause").when(F.col("l_returnflag") == "N", "decision").otherwise("state")
    facts = d.select("fact_id", _text("l_orderkey").alias("episode_id"), F.lit("x").alias("subject_entity_id"), F.col("l_linestatus").alias("predicate"), F.col("o_orderpriority").alias("object_value"), kind.alias("fact_kind"), F.when(F.col("l_quantity") > 10, "deterministic").otherwise("single_source_llm").alias("assertion_class"),
        F.when(F.col("l_linestatus") == "O", "active").otherwise("retired").alias("current_status"), F.col("l_shipdate").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.col("l_discount").cast("double").alias("confidence"), F.lit("s").alias("scope_path")).distinct()
    episodes = t.orders.select(_text("o_orderkey").alias("episode_id"), F.col("o_orderdate").cast("timestamp").alias("start_at"), F.lit("t").alias("scope_path"))
    entities = t.spark.createDataFrame([("x",)], "entity_id string")
    evidence = d.select("fact_id", F.concat(F.lit("g"), _text("l_suppkey")).alias("segment_id"), F.col("l_discount").cast("double").alias("weight"), F.lit(None).cast("timestamp").alias("created_at"))
    out = review.frame_candidates(facts, episodes, entities, evidence, t.spark.createDataFrame([], "source_fact_id string"), "default", 500)
    return out.select("source_fact_id", "episode_id", F.col("time_start").cast("timestamp_ntz").alias("time_start"), "outcome", "frame_fingerprint")


@query("""SELECT c_custkey, sha256('reflection-v1|tenant=default|kind=belief|subject=' || c_custkey || '|scope=' || lower(c_mktsegment) || '|statement=' || lower(c_name) || '|evidence=' || string_agg('fact:' || o_orderkey, '|' ORDER BY 'fact:' || o_orderkey)) AS fingerprint
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment""")
def c18_beliefs(t: Tables) -> DataFrame:
    proof = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.struct(_text("o_orderkey").alias("fact_id"))).alias("evidence"))
    none = F.array().cast("array<struct<fact_id:string>>")
    d = t.customer.join(proof, "c_custkey", "left").select("c_custkey", _text("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("scope_path"), F.concat(F.lit(" "), "c_name").alias("statement"), (F.col("c_acctbal") / 10000).cast("double").alias("confidence"), F.coalesce("evidence", none).alias("evidence"))
    return review.beliefs(d, "Default").select("c_custkey", "fingerprint")


@query("""SELECT CAST(event_id AS VARCHAR) AS memory_id, event_type AS source_service, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_type = 'click' THEN ['a', CAST(user_id AS VARCHAR)] ELSE [] END AS evidence_refs FROM events""")
def c31_attribution(t: Tables) -> DataFrame:
    refs = F.when(F.col("event_type") == "click", F.array(F.lit("a"), _text("user_id")))
    inner = F.struct(F.col("event_type").alias("sourceService"), _text("event_id").alias("eventId"), refs.alias("evidenceRefs"))
    meta = F.when(F.col("user_id") % 2 == 0, F.to_json(F.struct(inner.alias("lifecycleEvent")))).otherwise(F.to_json(F.struct(inner.alias("lifecycle_event"))))
    d = t.events.select(_text("event_id").alias("memory_id"), meta.alias("meta"))
    return review.attribution(d, "meta").select("memory_id", "source_service", "event_id", "evidence_refs")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS memory_id, regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g') || '-' || c_custkey || '.md' AS file_name, sha256('---' || chr(10) || 'name: "' || c_name || '"' || chr(10) || 'description: "' || c_mktsegment || '"' || chr(10) || 'type: reference' || chr(10) || 'support_count: ' || c_nationkey || chr(10) || '---' || chr(10)
|| chr(10) || '# ' || c_name || chr(10) || chr(10) || c_mktsegment || chr(10) || '---' || chr(10) || chr(10) || '*Confidence: 50% | Support: ' || c_nationkey || ' episodes | Contradictions: 0*') AS content_hash, CASE WHEN c_nationkey < 5 THEN 'old.md' END AS stale_name FROM customer WHERE c_acctbal > 0""")
def k13_published_notes(t: Tables) -> DataFrame:
    d = t.customer.select(_text("c_custkey").alias("memory_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("narrative"), F.lit(None).cast("string").alias("scope_path"), F.col("c_nationkey").cast("int").alias("support_count"), F.lit(0.5).alias("confidence"), F.lit(0).alias("contradiction_count"), F.when(F.col("c_acctbal") > 0, "published").otherwise("draft").alias("lifecycle_state"))
    old = t.customer.where("c_nationkey < 5").select(_text("c_custkey").alias("memory_id"), F.lit("old.md").alias("note_path"), F.lit("0").alias("content_hash"))
    return review.notes(d, old).select("memory_id", "file_name", "content_hash", "stale_name")


@query("SELECT 'documents' AS name, count(*) AS total, count(*) FILTER (lang IS NULL) AS pending FROM documents UNION ALL SELECT 'events', count(*), count(*) FILTER (props IS NULL) FROM events UNION ALL SELECT 'embeddings', count(*), count(*) FILTER (embedding IS NULL) FROM embeddings")
def a23_pending_counts(t: Tables) -> DataFrame:
    return review.coverage({"documents": (t.documents, "lang"), "events": (t.events, "props"), "embeddings": (t.embeddings, "embedding")})
