"""The engine's own calls over a catalog whose tables come from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .engine import Engine
from .queries import Tables, query, ts


def text(c: str) -> F.Column:  # type: ignore[name-defined]
    return F.col(c).cast("string")


def event_catalog(t: Tables) -> Catalog:
    """Customers as entities; events as frames of users, of episodes of six hours; orders as facts of customers, with lines as evidence."""
    tenant = F.lit("default").alias("tenant")
    i = F.col("event_id")
    entities = t.customer.select(tenant, text("c_custkey").alias("entity_id"), F.col("c_name").alias("canonical_name"), F.lit("customer").alias("entity_type"))
    frames = t.events.select(
        tenant, text("event_id").alias("event_frame_id"), text("user_id").alias("actor_entity_id"), "event_type", F.col("ts").cast("timestamp").alias("time_start"), F.col("ts").cast("timestamp").alias("created_at"), F.concat(F.lit("project:"), i % 3).alias("scope_path"),
        F.when(i % 2 == 0, (i / 2).cast("long").cast("string")).alias("source_fact_id"), F.concat(F.lit("s"), i % 3).alias("evidence_segment_id"), F.concat_ws("-", F.col("user_id") % 20, F.date_format("ts", "yyyyMMdd")).alias("episode_id"), F.col("event_type").alias("action"), F.lit("done").alias("outcome"),
    )
    facts = t.orders.select(
        tenant, text("o_orderkey").alias("fact_id"), text("o_custkey").alias("subject_entity_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_value"), F.col("o_orderdate").alias("valid_from"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 200 days")).alias("valid_to"), F.when(F.col("o_orderstatus") == "P", "superseded").otherwise("active").alias("current_status"), F.concat(F.lit("project:"), F.col("o_custkey") % 4).alias("scope_path"),
    )
    evidence = t.lineitem.select(text("l_orderkey").alias("fact_id"), F.concat(F.lit("s"), F.col("l_suppkey") % 3).alias("segment_id"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("excerpt"), F.col("l_discount").alias("weight"))
    support = t.lineitem.where("l_linenumber = 1").select(F.concat(F.lit("m"), F.col("l_suppkey")).alias("memory_id"), text("l_orderkey").alias("fact_id"), F.lit(None).cast("string").alias("episode_id"), F.lit("supporting").alias("support_type"), F.col("l_returnflag").alias("notes"))
    memories = t.supplier.select(tenant, F.concat(F.lit("m"), F.col("s_suppkey")).alias("memory_id"), F.col("s_name").alias("title"), F.when(F.col("s_suppkey") % 10 == 0, "quarantined").otherwise("active").alias("governance_status"))
    hidden = t.orders.where("o_orderkey % 50 = 0").select(tenant, F.lit("event_frame").alias("target_kind"), text("o_orderkey").alias("target_id"), F.lit("suppressed").alias("lifecycle_status"))
    return Catalog(t.spark, tables={"entity": entities, "event_frame": frames, "fact": facts, "fact_evidence": evidence, "memory_support": support, "memory": memories, "lifecycle_target_intelligence": hidden})


_FRAMES = """f AS (SELECT CAST(e.event_id AS VARCHAR) AS id, event_id, ts, event_type, c_name AS actor, CASE WHEN event_id % 2 = 0 THEN event_id // 2 END AS fact, 's' || (event_id % 3) AS seg, user_id, (user_id % 20) || '-' || strftime(ts, '%Y%m%d') AS episode FROM events e LEFT JOIN customer ON c_custkey = user_id
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = event_id AND o_orderkey % 50 = 0))"""


@query(f"""WITH {_FRAMES} SELECT event_id, ts, actor FROM f WHERE actor ILIKE '%00000004%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts, id LIMIT 40""")
def r14_timeline(t: Tables) -> DataFrame:
    d = Engine(event_catalog(t)).timeline("00000004", start=ts("2024-01-05 00:00:00").cast("timestamp"), end=ts("2024-01-25 00:00:00").cast("timestamp"), limit=40)
    return d.select(F.col("event_frame_id").cast("long").alias("event_id"), F.col("time_start").cast("timestamp_ntz").alias("ts"), "actor")


@query(f"""WITH {_FRAMES} SELECT event_id, l_linenumber || '/' || l_partkey AS excerpt FROM f LEFT JOIN lineitem ON l_orderkey = fact AND 's' || (l_suppkey % 3) = seg""")
def j09_frame_evidence(t: Tables) -> DataFrame:
    engine = Engine(event_catalog(t))
    return engine.with_frame_evidence(engine.frames()).select(F.col("event_frame_id").cast("long").alias("event_id"), "excerpt")


@query(f"""WITH {_FRAMES}, s AS (SELECT * FROM f WHERE actor ILIKE '%00000002%') (SELECT event_id, 'before' AS side FROM s WHERE ts < TIMESTAMP '2024-01-12' ORDER BY ts DESC, id DESC LIMIT 5) UNION ALL (SELECT event_id, 'after' FROM s WHERE ts >= TIMESTAMP '2024-01-12' ORDER BY ts, id LIMIT 5)""")
def r15_before_after(t: Tables) -> DataFrame:
    d = Engine(event_catalog(t)).before_after(ts("2024-01-12 00:00:00").cast("timestamp"), 5, "00000002")
    return d.select(F.col("event_frame_id").cast("long").alias("event_id"), "side")


@query("""SELECT o_orderkey AS fact_id, o_orderstatus AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name = 'Customer#000000007' AND o_orderstatus <> 'P' AND o_orderdate <= TIMESTAMP '1998-06-01' AND (o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 200 DAY > TIMESTAMP '1998-06-01')""")
def r20_state_at(t: Tables) -> DataFrame:
    d = Engine(event_catalog(t)).state_at("Customer#000000007", ts("1998-06-01 00:00:00").cast("timestamp"))
    return d.select(F.col("fact_id").cast("long").alias("fact_id"), F.col("object_value").alias("value"))


@query("""WITH s AS (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 1 AND l_suppkey = 3) SELECT 'fact' AS kind, CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS excerpt FROM s UNION ALL SELECT 'segment', 's' || (l_suppkey % 3), l_linenumber || '/' || l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM s)""")
def r24_explain(t: Tables) -> DataFrame:
    return Engine(event_catalog(t)).explain("m3")


@query("""SELECT DISTINCT l_orderkey AS fact_id FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 10 = 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def f08_tainted_facts(t: Tables) -> DataFrame:
    """Facts that support an excluded memory."""
    return Engine(event_catalog(t)).tainted("fact").select(F.col("fact_id").cast("long").alias("fact_id"))


@query("""SELECT DISTINCT 's' || (e.l_suppkey % 3) AS segment_id FROM lineitem e WHERE e.l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 10 = 0)""")
def f08_tainted_segments(t: Tables) -> DataFrame:
    return Engine(event_catalog(t)).tainted("segment")


@query(f"WITH {_FRAMES} SELECT event_id FROM f")
def f09_visible_frames(t: Tables) -> DataFrame:
    """Frames that no lifecycle status hides."""
    return Engine(event_catalog(t)).frames().select(F.col("event_frame_id").cast("long").alias("event_id"))


@query("""WITH e AS (SELECT l_orderkey AS fact, -coalesce(l_discount, 0) AS w, 's' || (l_suppkey % 3) AS seg, l_linenumber || '/' || l_partkey AS x FROM lineitem), m AS (SELECT 'm' || l_suppkey AS id, l_orderkey AS fact FROM lineitem WHERE l_linenumber = 1 AND l_suppkey < 5),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS fact FROM orders WHERE o_orderkey < 40 UNION ALL SELECT id, fact FROM m) SELECT id AS object_id, string_agg(x, ' ' ORDER BY w, seg, x) AS excerpts FROM o JOIN e USING (fact) GROUP BY 1""")
def j28_engine_evidence(t: Tables) -> DataFrame:
    """Evidence of facts, and of memories through their facts, heaviest first."""
    catalog = event_catalog(t)
    wanted = t.orders.where("o_orderkey < 40").select(text("o_orderkey").alias("object_id")).unionByName(t.supplier.where("s_suppkey < 5").select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("object_id")))
    d = Engine(catalog).with_evidence(wanted).where(F.size("evidence") > 0)
    return d.select("object_id", F.array_join(F.transform("evidence", lambda x: x["excerpt"]), " ").alias("excerpts"))
