"""Queries of repair and derivation: tenants, clones, coerced model results, backfilled times, revisions, contradictions, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import coerce, mining, revisions, temporal, tenants
from ..operators.written import folder
from ..sources import manifest
from .queries import Tables, query

# ------------------------------------------------------------------ tenants


def tenant_graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders belong to tenants; customers are known by their orders, nations by customers and suppliers, suppliers by lines of orders."""
    s = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string").alias("tenant")
    kind = lambda k: F.lit(k).alias("kind")
    nodes = (
        t.orders.select(kind("order"), s("o_orderkey").alias("id"), F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("tenant"))
        .unionByName(t.customer.select(kind("customer"), s("c_custkey").alias("id"), none))
        .unionByName(t.supplier.select(kind("supplier"), s("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 9 == 0, "t9").alias("tenant")))
        .unionByName(t.nation.select(kind("nation"), s("n_nationkey").alias("id"), none))
        .unionByName(t.region.select(kind("region"), s("r_regionkey").alias("id"), none))
    )
    ref = lambda d, a, b, c, e: d.select(F.lit(a).alias("from_kind"), s(b).alias("from_id"), F.lit(c).alias("kind"), s(e).alias("id"))
    lines = t.lineitem.where("l_quantity > 48").select("l_orderkey", "l_suppkey")
    refs = ref(t.orders, "order", "o_orderkey", "customer", "o_custkey").unionByName(ref(lines, "order", "l_orderkey", "supplier", "l_suppkey")).unionByName(ref(t.customer, "customer", "c_custkey", "nation", "c_nationkey"))
    refs = refs.unionByName(ref(t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey")).unionByName(ref(t.nation, "nation", "n_nationkey", "region", "n_regionkey"))
    return nodes, refs


_GRAPH = """o AS (SELECT o_orderkey, o_custkey, 't' || (o_custkey % 7) AS tenant FROM orders),
c AS (SELECT DISTINCT c_custkey AS id, c_nationkey AS up, tenant FROM customer JOIN o ON o_custkey = c_custkey),
s AS (SELECT DISTINCT s_suppkey AS id, s_nationkey AS up, tenant FROM supplier JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity > 48 JOIN o ON o_orderkey = l_orderkey UNION SELECT s_suppkey, s_nationkey, 't9' FROM supplier WHERE s_suppkey % 9 = 0),
n AS (SELECT DISTINCT n_nationkey AS id, n_regionkey AS up, tenant FROM nation JOIN (SELECT up, tenant FROM c UNION SELECT up, tenant FROM s) ON up = n_nationkey),
r AS (SELECT DISTINCT up AS id, tenant FROM n),
a AS (SELECT 'order' AS kind, o_orderkey AS id, tenant FROM o UNION ALL SELECT 'customer', id, tenant FROM c UNION ALL SELECT 'supplier', id, tenant FROM s UNION ALL SELECT 'nation', id, tenant FROM n UNION ALL SELECT 'region', id, tenant FROM r)"""


@query(f"WITH {_GRAPH} SELECT kind, CAST(id AS VARCHAR) AS id, tenant FROM a")
def k19_inferred_tenants(t: Tables) -> DataFrame:
    return tenants.infer(*tenant_graph(t))


@query(f"""WITH {_GRAPH}, k AS (SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier) SELECT kind, CAST(id AS VARCHAR) AS id, count(tenant) AS n FROM k LEFT JOIN a USING (kind, id) GROUP BY 1, 2 HAVING count(tenant) <> 1""")
def k19_ambiguous(t: Tables) -> DataFrame:
    nodes, refs = tenant_graph(t)
    return tenants.ambiguous(nodes, tenants.infer(nodes, refs), ["customer", "supplier"])


def shared_nations(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nations as entities of tenant t0, and some of t1 under the same names, what other tenants need, customers that refer to them)."""
    entity = t.nation.select(F.col("n_nationkey").cast("string").alias("entity_id"), F.lit("t0").alias("tenant"), F.lit("project").alias("entity_type"), F.col("n_name").alias("canonical_name"), F.create_map(F.lit("status"), F.lit("archived"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("attrs"), F.lit("2024-01-01").cast("timestamp").alias("last_seen_at"))
    own = entity.where("cast(entity_id as int) % 4 = 1").withColumns({"entity_id": F.concat(F.lit("own-"), "entity_id"), "tenant": F.lit("t1"), "last_seen_at": F.lit("2023-01-01").cast("timestamp")})
    rows = t.customer.select("c_custkey", F.concat(F.lit("t"), F.col("c_custkey") % 3).alias("tenant"), F.col("c_nationkey").cast("string").alias("entity_id"))
    return entity.unionByName(own), rows.select(F.col("entity_id").alias("id"), "tenant"), rows


_NEW_ID = "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))"


@query(f"""WITH d AS (SELECT c_custkey, 't' || (c_custkey % 3) AS tenant, c_nationkey AS n, md5('t' || (c_custkey % 3) || '|' || c_nationkey) AS h FROM customer)
SELECT c_custkey, tenant, CASE WHEN tenant = 't0' THEN CAST(n AS VARCHAR) WHEN tenant = 't1' AND n % 4 = 1 THEN 'own-' || n ELSE {_NEW_ID} END AS entity_id FROM d""")
def k19_split_and_remap(t: Tables) -> DataFrame:
    """Customers after the nations that several tenants shared were split."""
    entities, wanted, rows = shared_nations(t)
    _, ids = tenants.split(entities, wanted, "entity_id", ["entity_type", "canonical_name"], tenants.LIFE)
    return tenants.remap(rows, ids, ["entity_id"])


@query(f"""WITH d AS (SELECT n_nationkey AS n, n_name, n_regionkey, md5('t1|' || n_nationkey) AS h FROM nation), m AS (SELECT DISTINCT c_mktsegment AS service_name, c_nationkey AS n FROM customer)
SELECT 'entity' AS part, {_NEW_ID} AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM d WHERE n % 4 <> 1 UNION ALL SELECT 'seen', 'own-' || n, NULL, NULL FROM d WHERE n % 4 = 1 UNION ALL
SELECT 'mapping', CASE WHEN n % 4 = 1 THEN 'own-' || n ELSE {_NEW_ID} END, service_name, NULL FROM m JOIN d USING (n) UNION ALL SELECT 'again', CAST(0 AS VARCHAR), NULL, NULL""")
def k18_clone(t: Tables) -> DataFrame:
    """What a clone of the defaults adds for another tenant; a second run adds 0 rows."""
    entities, _, _ = shared_nations(t)
    mappings = t.customer.select(F.col("c_nationkey").cast("string").alias("project_id"), F.col("c_mktsegment").alias("service_name"), F.lit("t0").alias("tenant")).distinct()
    rows, newer, led = tenants.clone(entities, mappings, "t1", "t0")
    none = F.lit(None).cast("string")
    later = entities.unionByName(rows)
    again, _, more = tenants.clone(later, mappings.unionByName(led), "t1", "t0")
    count = again.select("tenant").unionByName(more.select("tenant")).agg(F.count("*").cast("string").alias("id"))
    return (
        rows.select(F.lit("entity").alias("part"), F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"), F.concat_ws("+", F.map_values("attrs")).alias("region"))
        .unionByName(newer.select(F.lit("seen").alias("part"), F.col("entity_id").alias("id"), none.alias("name"), none.alias("region")))
        .unionByName(led.select(F.lit("mapping").alias("part"), F.col("project_id").alias("id"), F.col("service_name").alias("name"), none.alias("region")))
        .unionByName(count.select(F.lit("again").alias("part"), "id", none.alias("name"), none.alias("region")))
    )


# ------------------------------------------------------------------ model results


def model_results(t: Tables) -> DataFrame:
    """(result_id, raw): what a model might say of each event, right in one way and wrong in eleven; props are a value as they are."""
    i = F.col("event_id")
    who, kind = F.concat(F.lit('"subject": "u'), "user_id", F.lit('"')), F.concat(F.lit('"fact_kind": "'), F.when(i % 12 == 2, "Fix").when(i % 12 == 3, "weird").otherwise("state"), F.lit('"'))
    value = F.when(i % 12 == 4, '[1, "a", null]').when(i % 12 == 9, F.coalesce("props", F.lit("{}"))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    sure = F.when(i % 12 == 5, '"confidence": 1.5').when(i % 12 == 10, '"confidence": "high"').otherwise('"confidence": 0.9')
    where = F.when(i % 12 == 7, '"segment_ids": []').otherwise('"segment_ids": ["s1"]')
    first = F.concat(F.lit("{"), F.when(i % 12 != 6, F.concat(who, F.lit(", "))).otherwise(""), F.lit('"predicate": "did", '), kind, F.lit(', "object_value": '), value, F.lit(", "), sure, F.lit(", "), where, F.lit("}"))
    second = F.concat(F.lit(', {"subject": "u'), "user_id", F.lit('", "predicate": "did", "fact_kind": "state", "object_value": "other", "confidence": 0.8, "segment_ids": ["s2"]}'))
    body = F.concat(F.lit('{"facts": ['), first, F.when(i % 12 == 11, second).otherwise(""), F.lit("]}"))
    return t.events.select(i.alias("result_id"), F.when(i % 12 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 12 == 8, F.substring(body, 1, 30)).otherwise(body).alias("raw"))


@query("""WITH e AS (SELECT event_id, 'u' || user_id AS who, event_id % 12 AS k, event_type FROM events)
SELECT event_id AS result_id, k NOT IN (5, 6, 7, 8, 10) AS valid, CASE k WHEN 5 THEN 'facts.0.confidence: above 1' WHEN 6 THEN 'facts.0.subject: missing' WHEN 7 THEN 'facts.0.segment_ids: empty' WHEN 8 THEN 'JSON parse error' WHEN 10 THEN 'facts.0.confidence: no number' ELSE '' END AS errors,
CASE k WHEN 2 THEN 'Coerced fact_kind "Fix" -> "remediation"' WHEN 3 THEN 'Unknown fact_kind "weird" -> "state"' WHEN 11 THEN 'Contradiction: ' || who || '::did has 2 different values at high confidence' ELSE '' END AS warnings, CASE k WHEN 8 THEN 0 WHEN 11 THEN 2 ELSE 1 END AS n_facts FROM e""")
def c29_model_results(t: Tables) -> DataFrame:
    documents, _ = coerce.read(model_results(t))
    return documents.select("result_id", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), F.col("n_facts").cast("int").alias("n_facts"))


@query("""WITH e AS (SELECT event_id, 'u' || user_id AS who, event_id % 12 AS k, event_type, props FROM events)
SELECT event_id AS result_id, who AS subject, CASE k WHEN 2 THEN 'remediation' ELSE 'state' END AS kind, CASE k WHEN 4 THEN '1, a, null' WHEN 9 THEN replace(coalesce(props, '{}'), ' ', '') ELSE event_type END AS value, 's1' AS segments FROM e WHERE k NOT IN (5, 6, 7, 8, 10) UNION ALL SELECT event_id, who, 'state', 'other', 's2' FROM e WHERE k = 11""")
def c29_valid_facts(t: Tables) -> DataFrame:
    _, facts = coerce.read(model_results(t))
    return facts.where("valid").select("result_id", "subject", "kind", "value", F.array_join("segment_ids", ",").alias("segments"))


# ------------------------------------------------------------------ times, revisions, contradictions


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 'cause' WHEN 1 THEN 'impact' ELSE 'state' END AS kind, CAST(CAST(l_quantity AS INTEGER) % 3 AS VARCHAR) AS value, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate END AS a,
CASE WHEN l_linenumber % 5 = 0 THEN l_shipdate + INTERVAL 400 DAY END AS b, CASE WHEN l_linestatus = 'F' THEN 'archived' ELSE 'active' END AS status, o_orderdate AS s, o_orderdate + INTERVAL 90 DAY AS e, o_orderstatus IN ('F', 'O') AS ended FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
g AS (SELECT *, coalesce(a, s) AS vf, CASE WHEN b IS NULL AND ended AND kind IN ('cause', 'impact') THEN e ELSE b END AS vt FROM f),
n AS (SELECT x.l_orderkey, x.l_linenumber, min(y.vf) AS other FROM g x JOIN g y ON x.l_partkey = y.l_partkey AND x.l_returnflag = y.l_returnflag AND x.kind = y.kind AND x.vf < y.vf AND (x.vt IS NULL OR x.vt > y.vf) AND x.value <> y.value AND x.status = 'active' AND y.status = 'active' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, count(*) AS copies, min(vf) AS valid_from, min(coalesce(other, vt)) AS valid_to, min(CASE WHEN other IS NOT NULL THEN 'superseded' ELSE status END) AS status FROM g LEFT JOIN n USING (l_orderkey, l_linenumber) GROUP BY 1, 2 HAVING count(*) = 1""")
def c25_temporal_backfill(t: Tables) -> DataFrame:
    """Lines as facts of orders as episodes: starts from orders, ends of causes and impacts, supersession. Lines whose key repeats are left out of the report."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "cause").when(n % 3 == 1, "impact").otherwise("state")
    facts = t.lineitem.select(
        F.struct("l_orderkey", "l_linenumber").alias("fact_id"), F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("subject_entity_id"), F.col("l_returnflag").alias("predicate"), kind.alias("fact_kind"),
        (F.col("l_quantity").cast("int") % 3).cast("string").alias("object_value"), F.when(n % 2 == 0, F.col("l_shipdate")).alias("valid_from"), F.when(n % 5 == 0, F.col("l_shipdate") + F.expr("interval 400 days")).alias("valid_to"), F.when(F.col("l_linestatus") == "F", "archived").otherwise("active").alias("current_status"),
    )
    episodes = t.orders.select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").alias("start_at"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("end_at"), F.when(F.col("o_orderstatus") == "P", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("resolved").alias("outcome"))
    d = temporal.backfill(facts, episodes)
    d = d.groupBy("fact_id").agg(F.count("*").alias("copies"), F.min("valid_from").alias("valid_from"), F.min("valid_to").alias("valid_to"), F.min("current_status").alias("status")).where("copies = 1")
    return d.select("fact_id.l_orderkey", "fact_id.l_linenumber", "copies", "valid_from", "valid_to", "status")


def memory_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, support, facts): documents as memories, lines of the order of the same number as support."""
    i = F.col("doc_id")
    when = lambda days: F.lit("2024-01-20").cast("timestamp") - F.make_dt_interval(days=days.cast("int"))
    memories = t.documents.select(
        i.cast("string").alias("memory_id"), F.when(i % 17 == 0, None).otherwise(F.concat(F.lit("Title "), i % 150)).alias("title"), F.substring("text", 1, 300).alias("narrative"), F.col("lang").alias("scope_path"), F.get(F.array(*map(F.lit, ("entity_summary", "playbook", "pattern", "other"))), (i % 4).cast("int")).alias("memory_type"),
        F.get(F.array(*map(F.lit, ("draft", "published", "retired"))), (i % 3).cast("int")).alias("lifecycle_state"), (i % 5).cast("int").alias("support_count"), (i % 7).cast("int").alias("contradiction_count"), (i % 10 / 10).alias("confidence"), when(i % 13).alias("updated_at"), when(i % 20).alias("created_at"),
        F.when(i % 6 != 0, when(i % 400)).alias("last_supported_at"), F.when(i % 8 == 0, when(i % 5)).alias("valid_from"),
    )
    support = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").cast("string").alias("memory_id"), F.col("l_partkey").cast("string").alias("fact_id"), F.when(F.col("l_linenumber") == 2, F.col("l_suppkey").cast("string")).alias("episode_id"), F.lit("supporting").alias("support_type"), F.col("l_shipdate").alias("created_at"))
    facts = t.part.select(F.col("p_partkey").cast("string").alias("fact_id"), F.when(F.col("p_size") < 10, 1).otherwise(5).alias("priority"))
    return memories, support, facts


_DAYS = "TIMESTAMP '2024-01-20' - to_days(CAST({0} AS INTEGER))"
_MEM = f"""m AS (SELECT CAST(doc_id AS VARCHAR) AS memory_id, CASE WHEN doc_id % 17 <> 0 THEN 'Title ' || (doc_id % 150) END AS title, substr(text, 1, 300) AS narrative, lang AS scope_path, ['entity_summary', 'playbook', 'pattern', 'other'][doc_id % 4 + 1] AS memory_type, ['draft', 'published', 'retired'][doc_id % 3 + 1] AS state,
doc_id % 5 AS sup, doc_id % 7 AS con, doc_id % 10 / 10 AS confidence, {_DAYS.format("doc_id % 13")} AS updated_at, {_DAYS.format("doc_id % 20")} AS created_at, CASE WHEN doc_id % 6 <> 0 THEN {_DAYS.format("doc_id % 400")} END AS last_at, CASE WHEN doc_id % 8 = 0 THEN 1 END AS valid_from FROM documents),
ms AS (SELECT CAST(l_orderkey AS VARCHAR) AS memory_id, CAST(l_partkey AS VARCHAR) AS fact_id, CASE WHEN l_linenumber = 2 THEN CAST(l_suppkey AS VARCHAR) END AS episode_id, l_shipdate FROM lineitem WHERE l_linenumber <= 2),
keep AS (SELECT memory_id, first_value(memory_id) OVER w AS keeper, row_number() OVER w AS place FROM m WHERE title IS NOT NULL WINDOW w AS (PARTITION BY lower(title), coalesce(scope_path, '') ORDER BY sup DESC, confidence DESC, updated_at DESC, memory_id))"""


@query(f"""WITH {_MEM}, s AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY l_shipdate, fact_id, episode_id) = 1), g AS (SELECT DISTINCT memory_id FROM ms JOIN part ON CAST(p_partkey AS VARCHAR) = fact_id AND p_size < 10),
a AS (SELECT m.*, keeper, place, fact_id, episode_id, g.memory_id IS NOT NULL AS guarded FROM m LEFT JOIN keep USING (memory_id) LEFT JOIN s USING (memory_id) LEFT JOIN g ON g.memory_id = m.memory_id),
k AS (SELECT *, 'created' AS revision_type FROM a WHERE state = 'draft' AND sup >= 2 UNION ALL SELECT *, 'enriched' FROM a WHERE state <> 'retired' AND sup >= 2 AND length(coalesce(narrative, '')) < 220 UNION ALL SELECT *, 'merged' FROM a WHERE state <> 'retired' AND place > 1
UNION ALL SELECT *, 'demoted' FROM a WHERE state = 'published' AND (last_at IS NULL OR last_at < TIMESTAMP '2024-01-20' - INTERVAL 6 MONTH) AND NOT guarded UNION ALL SELECT *, 'retired' FROM a WHERE state <> 'retired' AND con > sup AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY)
SELECT memory_id, revision_type, CASE WHEN memory_type = 'entity_summary' THEN 'entity_summary' WHEN valid_from IS NOT NULL OR episode_id IS NOT NULL THEN 'experience' WHEN memory_type = 'playbook' THEN 'rule' ELSE 'belief' END AS derived_class, coalesce(title, '(untitled memory)') AS title,
CASE WHEN revision_type = 'enriched' THEN concat(narrative, chr(10), chr(10), 'Evidence refresh: support=', sup, ', contradictions=', con, '.') ELSE narrative END AS new_narrative, fact_id, episode_id, CASE WHEN revision_type = 'merged' THEN keeper END AS keeper FROM k""")
def c12_revisions(t: Tables) -> DataFrame:
    d = revisions.proposals(*memory_tables(t), F.lit("2024-01-20").cast("timestamp"))
    return d.select("memory_id", "revision_type", "derived_class", "title", "new_narrative", "fact_id", "episode_id", "keeper")


@query(f"""WITH {_MEM}, c AS (SELECT memory_id, keeper FROM keep JOIN m USING (memory_id) WHERE place > 1 AND state <> 'retired'),
mv AS (SELECT DISTINCT coalesce(keeper, memory_id) AS memory_id, fact_id, episode_id FROM ms LEFT JOIN c USING (memory_id)), n AS (SELECT memory_id, count(*) AS n FROM mv GROUP BY 1), x AS (SELECT keeper AS memory_id, sum(con) AS con FROM c JOIN m USING (memory_id) GROUP BY 1)
SELECT m.memory_id, CASE WHEN c.keeper IS NOT NULL THEN 0 WHEN x.con IS NOT NULL THEN coalesce(n, 0) ELSE sup END AS support_count, m.con + coalesce(x.con, 0) AS contradiction_count, CASE WHEN c.keeper IS NOT NULL THEN 'retired' ELSE state END AS lifecycle_state FROM m LEFT JOIN c USING (memory_id) LEFT JOIN x ON x.memory_id = m.memory_id LEFT JOIN n ON n.memory_id = m.memory_id""")
def t06_united_support(t: Tables) -> DataFrame:
    """Memories after all proposed merges were approved."""
    memories, support, facts = memory_tables(t)
    found = revisions.proposals(memories, support, facts, F.lit("2024-01-20").cast("timestamp"))
    d, _ = revisions.unite(memories, support, found.where("revision_type = 'merged'").select("memory_id", "keeper"))
    return d.select("memory_id", "support_count", "contradiction_count", "lifecycle_state")


def conflict_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    i = F.col("doc_id")
    memories = t.documents.select(i.alias("memory_id"), F.lit("t").alias("tenant"), F.col("lang").alias("scope_path"), F.when(i % 3 == 0, "One Title").otherwise(F.concat(F.lit("title "), i % 200)).alias("title"), F.col("text").alias("narrative"))
    return memories, t.labels.select(F.col("doc_id").alias("memory_id"), F.concat(F.lit("q"), F.col("quality") * 2 + F.col("toxic")).alias("cue_hash"))


@query("""WITH m AS (SELECT doc_id AS id, coalesce(lang, '') AS s, lower(CASE WHEN doc_id % 3 = 0 THEN 'One Title' ELSE 'title ' || (doc_id % 200) END) AS t, sha256(coalesce(text, '')) AS h FROM documents),
r AS (SELECT id, s, 't:' || t AS k, h FROM m UNION ALL SELECT id, s, 'c:q' || (quality * 2 + toxic), h FROM m JOIN labels ON doc_id = id), hd AS (SELECT s, k, h, min(id) AS head FROM r GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY s, k ORDER BY head) AS n FROM hd),
p AS (SELECT r.id, CASE WHEN r.h <> a.h THEN a.head ELSE b.head END AS other FROM r JOIN o a ON a.s = r.s AND a.k = r.k AND a.n = 1 JOIN o b ON b.s = r.s AND b.k = r.k AND b.n = 2)
SELECT DISTINCT least(id, other) AS source_id, greatest(id, other) AS target_id FROM p""")
def c19_conflict_edges(t: Tables) -> DataFrame:
    """A third of all memories share one title; edges stay as many as memories in classes."""
    memories, cues = conflict_tables(t)
    known = t.spark.createDataFrame([], "tenant string, edge_fingerprint string")
    return mining.conflict_edges(memories, cues, known, "t")[0].select("source_id", "target_id")


@query("""WITH m AS (SELECT doc_id AS id, coalesce(lang, '') AS s, lower(CASE WHEN doc_id % 3 = 0 THEN 'One Title' ELSE 'title ' || (doc_id % 200) END) AS t, sha256(coalesce(text, '')) AS h FROM documents), n AS (SELECT s, t FROM m GROUP BY 1, 2 HAVING count(DISTINCT h) > 1),
c AS (SELECT id FROM m JOIN n USING (s, t)), e AS (SELECT s, quality * 2 + toxic AS q FROM m JOIN labels ON doc_id = id GROUP BY 1, 2 HAVING count(DISTINCT h) > 1), u AS (SELECT id FROM m JOIN labels ON doc_id = id JOIN e ON e.s = m.s AND e.q = quality * 2 + toxic)
SELECT id AS memory_id, 1 AS n FROM (SELECT id FROM c UNION SELECT id FROM u)""")
def c19_counter_bumps(t: Tables) -> DataFrame:
    """Every memory that contradicts another is at an end of some edge, and is bumped once; the SQL knows only the classes."""
    memories, cues = conflict_tables(t)
    return mining.conflict_edges(memories, cues, t.spark.createDataFrame([], "tenant string, edge_fingerprint string"), "t")[1]


# ------------------------------------------------------------------ manifests


def archive(t: Tables, root: str, changed: bool = False) -> None:
    """A file of customer names for each nation; in the changed copy one byte differs, one file is missing and one is new."""
    n = F.col("c_nationkey")
    rows = t.customer.select(n.alias("k"), "c_custkey", F.col("c_name").alias("value"))
    if changed:
        rows = rows.where("k <> 4").withColumn("value", F.when((F.col("k") == 3) & (F.col("c_custkey") == rows.where("k = 3").agg(F.min("c_custkey")).first()[0]), F.translate("value", "C", "c")).otherwise(F.col("value")))
        rows = rows.unionByName(rows.where("k = 5").withColumn("k", F.lit(99)))
    rows.repartition("k").sortWithinPartitions("k", "c_custkey").select("value", F.col("k").alias("n")).write.partitionBy("n").text(root)


@query("""WITH f AS (SELECT c_nationkey AS n, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY 1) SELECT 'n=' || n AS folder, strlen(content) AS size, sha256(content) AS sha256 FROM f""")
def k16_manifest(t: Tables) -> DataFrame:
    root = folder(t.spark)
    archive(t, root)
    return manifest.files(t.spark, root, "part-*").select(F.substring_index("name", "/", 1).alias("folder"), "size", "sha256")


@query("SELECT * FROM (VALUES ('n=3', 'changed'), ('n=4', 'missing'), ('n=99', 'unexpected')) v(folder, problem)")
def j26_archive_check(t: Tables) -> DataFrame:
    """A changed byte, a missing file and a file that should not be there are found; the digests of both archives differ."""
    root, other = folder(t.spark), folder(t.spark)
    archive(t, root)
    archive(t, other, True)
    plain = lambda d: d.withColumn("name", F.substring_index("name", "/", 1))
    return manifest.verify(plain(manifest.files(t.spark, root, "part-*")), plain(manifest.files(t.spark, other, "part-*"))).select(F.col("name").alias("folder"), "problem")
