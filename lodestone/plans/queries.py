"""The engine's operators over the driver tables, each with the equivalent SQL.

Roles: orders are episodes, lineitem facts, part, supplier and customer entities, events frames (a user is an
episode or subject, the event type a kind), documents and embeddings are memories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fulltext
from ..functions import predicates as P
from ..functions import scores as S
from ..functions import text as X
from ..operators import folds, graph, merge, mining, ranking, temporal
from . import text_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def ts(text: str) -> F.Column:  # type: ignore[name-defined]
    return F.lit(text).cast("timestamp_ntz")


NOW = "2024-01-20 00:00:00"
LEX = text_sql.LEX

# ------------------------------------------------------------------ filters and scans


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def f01_exact_filter(t: Tables) -> DataFrame:
    return t.orders.where(P.tenant_is("O", "o_orderstatus") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def f02_scope_prefix(t: Tables) -> DataFrame:
    return t.customer.where(P.in_scope("Customer#00000001", "c_name")).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1998-06-01') AND (l_shipdate IS NULL OR l_shipdate > TIMESTAMP '1998-06-01')")
def f03_as_of_validity(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return d.where(P.valid_at(ts("1998-06-01 00:00:00"), "o_orderdate", "l_shipdate")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%ring%' OR p_type ILIKE '%ring%'")
def f04_any_ilike(t: Tables) -> DataFrame:
    return t.part.where(P.any_ilike("RING", "p_name", "p_type")).select("p_partkey", "p_name", "p_type")


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def f05_time_window(t: Tables) -> DataFrame:
    return t.events.where(P.within("ts", ts("2024-01-10 00:00:00"), ts("2024-01-12 00:00:00"))).select("event_id", "ts", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderpriority NOT IN ('5-LOW')")
def f06_governance_exclusion(t: Tables) -> DataFrame:
    d = t.orders.withColumns({"governance_status": F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active"), "trust_class": F.when(F.col("o_orderpriority") == "5-LOW", "retired_superseded").otherwise("deterministic")})
    return d.where(P.governed()).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F') OR o_orderpriority IN ('5-LOW')")
def f07_unsafe_rows(t: Tables) -> DataFrame:
    d = t.orders.withColumns({"governance_status": F.when(F.col("o_orderstatus") == "F", "archived").otherwise("active"), "trust_class": F.when(F.col("o_orderpriority") == "5-LOW", "retired_superseded").otherwise("deterministic")})
    return d.where(P.unsafe()).select("o_orderkey")


@query("""SELECT o.o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)""")
def f08_tainted_exclusion(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    debt = t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    return t.orders.select("o_orderkey").join(returned.union(debt).distinct(), "o_orderkey", "left_anti")


@query(f"SELECT doc_id FROM documents WHERE list_has_all({LEX}, ['the', 'and', 'tion'])")
def f14_text_match(t: Tables) -> DataFrame:
    return t.documents.where(X.has_words("text", ("the", "and", "tion"))).select("doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), event_type) AS label FROM events")
def f17_json_paths(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), "event_type").alias("label"))


@query("SELECT doc_id, substr(text, 1, 500) AS head FROM documents")
def f18_truncated_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("head"))


@query("SELECT doc_id, length(trim(text)) >= 20 AND NOT regexp_matches(lower(trim(text)), '^(ok|okay|yes|no|thanks|done)$') AS substantial FROM documents")
def f25_substantial_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.substantial("text").alias("substantial"))


@query("SELECT conv_id, turn, contains(lower(text), 'act as') OR contains(lower(text), 'system:') OR contains(lower(text), 'ignore previous') OR contains(lower(text), 'ignore above') OR contains(lower(text), 'developer:') OR contains(lower(text), 'assistant:') OR contains(lower(text), 'you are now') OR contains(lower(text), 'follow these instructions instead') OR contains(lower(text), '<|im_start|>') OR contains(lower(text), '<|system|>') OR contains(lower(text), 'begin prompt') OR contains(lower(text), 'role:') AS marked FROM conversations")
def f26_injection_markers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.injection_marker("text").isNotNull().alias("marked"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, list_filter(['discount', 'quantity', 'dates'], lambda x, i: [l_discount > 0.09, l_quantity < 2, l_shipdate < o_orderdate][i]) AS broken
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_discount > 0.09 OR l_quantity < 2 OR l_shipdate < o_orderdate""")
def f27_row_rules(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rules = {"discount": F.col("l_discount") <= 0.09, "quantity": F.col("l_quantity") >= 2, "dates": F.col("l_shipdate") >= F.col("o_orderdate")}
    return d.select("l_orderkey", "l_linenumber", "l_partkey", P.violations(rules).alias("broken")).where(F.size("broken") > 0)


# ------------------------------------------------------------------ joins


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 5000
WHERE p_name = 'red widget'""")
def j01_facts_of_entities(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.part.where("p_name = 'red widget'"), F.col("l_partkey") == F.col("p_partkey"))
    return d.join(t.supplier.where("s_acctbal > 5000"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "s_name")


@query("""SELECT DISTINCT a.l_orderkey AS a_order, a.l_partkey, b.l_orderkey AS b_order FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey
WHERE a.l_quantity = 50""")
def j03_same_subject(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("a_order"), "l_partkey")
    b = t.lineitem.select(F.col("l_orderkey").alias("b_order"), "l_partkey")
    return a.join(b, "l_partkey").where("a_order <> b_order").distinct()


EDGES_SQL = "(SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS p, CAST(l_suppkey AS VARCHAR) AS s FROM lineitem)"


def edges(t: Tables) -> DataFrame:
    """Part to supplier edges, as the evidence graph holds them."""
    e = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return e.select(
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("edge_id"), F.lit("part").alias("source_type"), F.col("l_partkey").cast("string").alias("source_id"), F.lit("supplier").alias("target_type"),
        F.col("l_suppkey").cast("string").alias("target_id"), F.lit("supplied_by").alias("edge_type"), F.lit("deterministic").alias("assertion_class"), F.least(F.col("n") / 10, F.lit(1.0)).alias("confidence"),
    )


def seeds(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("part", "1"), ("part", "2"), ("supplier", "3")], "node_type string, node_id string")


@query(f"""WITH e AS {EDGES_SQL} SELECT p || '-' || s AS edge_id, 'supplier' AS far_type, s AS far_id FROM e WHERE p IN ('1', '2') UNION
SELECT p || '-' || s, 'part', p FROM e WHERE s = '3'""")
def j04_edges_at_either_end(t: Tables) -> DataFrame:
    return graph.touching(edges(t), seeds(t)).select("edge_id", "far_type", "far_id")


@query(f"""WITH e AS {EDGES_SQL}, m AS (SELECT 'supplier' AS far_type, s AS far_id FROM e WHERE p IN ('1', '2') UNION SELECT 'part', p FROM e WHERE s = '3')
SELECT * FROM m WHERE NOT (far_type = 'supplier' AND far_id = '3') AND NOT (far_type = 'part' AND far_id IN ('1', '2'))""")
def j05_far_ends_without_seeds(t: Tables) -> DataFrame:
    return graph.far_ends(edges(t), seeds(t), 1_000_000).select("far_type", "far_id").distinct()


@query(f"""WITH e AS {EDGES_SQL}, h0 AS (SELECT 'part' AS node_type, '1' AS node_id), h1 AS (SELECT 'supplier' AS node_type, s AS node_id FROM e WHERE p = '1'),
h2 AS (SELECT DISTINCT 'part' AS node_type, p AS node_id FROM e WHERE s IN (SELECT node_id FROM h1) AND p <> '1')
SELECT *, 0 AS hops FROM h0 UNION ALL SELECT DISTINCT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2""")
def r06_two_hop_walk(t: Tables) -> DataFrame:
    return graph.walk(edges(t), seeds(t).where("node_id = '1'"), 2)


@query("""SELECT e.event_id, n.n_name AS nation, r.r_name AS region FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def j08_frame_dimensions(t: Tables) -> DataFrame:
    d = t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return d.select("event_id", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def j11_best_evidence(t: Tables) -> DataFrame:
    return ranking.first_per_key(t.lineitem, ["l_orderkey"], [F.desc_nulls_last("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey, min(l_linenumber) AS next_step FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def j12_next_step(t: Tables) -> DataFrame:
    return t.lineitem.where("l_linenumber > 2").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("next_step"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j14_not_materialized(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""(SELECT event_id, ts, 'before' AS side FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 7) UNION ALL
(SELECT event_id, ts, 'after' FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 7)""")
def j15_before_after(t: Tables) -> DataFrame:
    return temporal.around(t.events, ts("2024-01-15 00:00:00"), "ts", "event_id", 7).select("event_id", "ts", "side")


@query("""SELECT e.event_id, p.event_id AS last_signup FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def j15_as_of_join(t: Tables) -> DataFrame:
    right = t.events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("rts"), F.col("event_id").alias("last_signup"))
    return temporal.asof(t.events.where("event_type = 'error'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "rts", ["last_signup"], 86400).select("event_id", "last_signup")


@query("""WITH i AS (SELECT event_id AS w, ts AS s, ts + INTERVAL 10 MINUTE AS e FROM events WHERE event_type = 'error' AND value > 20)
SELECT w, event_id FROM i JOIN events ON ts >= s AND ts < e""")
def j16_points_in_intervals(t: Tables) -> DataFrame:
    i = t.events.where("event_type = 'error' and value > 20").select(F.col("event_id").alias("w"), F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 10 minutes")).alias("e"))
    return temporal.points_in_intervals(t.events.select("event_id", "ts"), i, "ts", "s", "e", 600).select("w", "event_id")


@query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, lower(coalesce(split_part(text, chr(10), 1), '')) AS title, coalesce(text, '') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY source, title, text) AS class_id, count(*) OVER (PARTITION BY source, title) - count(*) OVER (PARTITION BY source, title, text) AS n_conflicts FROM d""")
def j17_conflicts(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"), "text")
    return mining.conflict_counts(d, "doc_id", ["source"], "title", "text")


@query("""WITH f AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f), n AS (SELECT user_id, run - 1 AS run, min(ts) AS nxt FROM r GROUP BY 1, 2)
SELECT event_id, nxt AS valid_to FROM r LEFT JOIN n USING (user_id, run)""")
def j18_supersession(t: Tables) -> DataFrame:
    d = t.events.withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return temporal.superseded(d, ["user_id"], "event_type", "ts", "valid_to").select("event_id", "valid_to")


@query("""SELECT a.event_id AS alert, b.event_id AS incident FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 86400000000 WHERE a.event_type = 'error' AND b.event_type = 'signup'
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts, b.event_id) = 1""")
def j21_near_in_time(t: Tables) -> DataFrame:
    a = t.events.where("event_type = 'error'").select(F.col("event_id").alias("alert"), "user_id", F.col("ts").alias("ats"))
    b = t.events.where("event_type = 'signup'").select(F.col("event_id").alias("incident"), "user_id", F.col("ts").alias("its"))
    met = temporal.within_distance(a, b, "ats", "its", 86400, ["user_id"])
    return met.groupBy("alert").agg(F.min_by("incident", F.struct("its", "incident")).alias("incident"))


@query("SELECT DISTINCT l_orderkey, n_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey OR n_nationkey = s_nationkey")
def j22_subject_or_object(t: Tables) -> DataFrame:
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    ends = d.select("l_orderkey", F.explode(F.array("c_nationkey", "s_nationkey")).alias("n_nationkey")).distinct()
    return ends.join(F.broadcast(t.nation.select("n_nationkey")), "n_nationkey", "left_semi").select("l_orderkey", "n_nationkey")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS n_events FROM customer""")
def j27_counts_per_entity(t: Tables) -> DataFrame:
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n_events"))
    d = t.customer.select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left")
    return d.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


@query("""SELECT o_orderkey, list({'p': l_extendedprice, 'n': l_linenumber, 'k': l_partkey} ORDER BY l_extendedprice, l_linenumber, l_partkey) AS evidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def j28_evidence_lists(t: Tables) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice").alias("p"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"))))
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(e.alias("evidence"))


# ------------------------------------------------------------------ aggregates


@query("""WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, o_orderpriority AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY n DESC, v) AS r FROM c),
s AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS support FROM lineitem GROUP BY 1, 2, 3)
SELECT l_suppkey, l_returnflag, l_linestatus, support, v AS usual_value, round(CAST(least(0.5 + 0.1 * support, 0.95) AS DOUBLE), 6) AS confidence, sha256('pattern:' || l_suppkey || '|' || l_returnflag || '|' || l_linestatus) AS fingerprint
FROM s JOIN m USING (l_suppkey, l_returnflag, l_linestatus) WHERE r = 1 AND support >= 2""")
def a01_pattern_mining(t: Tables) -> DataFrame:
    f = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("fact_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    d = mining.patterns(f, ["l_suppkey", "l_returnflag", "l_linestatus"], "l_orderkey", "o_orderpriority", "fact_id", ids=False)
    return d.select("l_suppkey", "l_returnflag", "l_linestatus", "support", "usual_value", F.round("confidence", 6).alias("confidence"), "fingerprint")


@query("""SELECT l_partkey, l_returnflag AS step, count(*) AS uses, list(DISTINCT l_orderkey ORDER BY l_orderkey) AS episode_ids, round(least(max(l_discount * 10), 0.95), 6) AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'F') GROUP BY 1, 2""")
def a02_playbooks(t: Tables) -> DataFrame:
    f = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumns({"fact_id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "score": F.col("l_discount") * 10, "outcome": F.when(F.col("o_orderstatus") == "O", None).when(F.col("o_orderstatus") == "F", "closed").otherwise("open")})
    d = mining.playbooks(f, "l_partkey", "l_returnflag", "l_orderkey", "outcome", "fact_id", "score")
    return d.select("l_partkey", F.upper("step").alias("step"), "uses", "episode_ids", F.round("confidence", 6).alias("confidence"))


@query("""WITH c AS (SELECT user_id, min(ts) AS started FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 20)
SELECT user_id, started, list({'ts': ts, 'event_id': event_id, 'event_type': event_type} ORDER BY ts, event_id) AS steps FROM events JOIN c USING (user_id) WHERE event_type IN ('error', 'signup') GROUP BY 1, 2""")
def r16_causal_chains(t: Tables) -> DataFrame:
    return temporal.chains(t.events, "user_id", "ts", "event_id", ("error", "signup"), "event_type", 20, ["event_type"])


@query("""SELECT count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, min(ts) FILTER (event_type = 'error') AS first_error,
round(avg(value), 6) AS mean_value, sum(octet_length(encode(props))) AS bytes FROM events""")
def a04_conditional_counts(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return t.events.agg(F.count("*").alias("total"), F.count_if(e == "error").alias("errors"), F.count_if(e == "purchase").alias("purchases"), F.min(F.when(e == "error", F.col("ts"))).alias("first_error"), F.round(F.avg("value"), 6).alias("mean_value"), F.sum(F.octet_length("props")).alias("bytes"))


@query("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def a07_single_project(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.count_distinct("l_suppkey").alias("n")).where("n = 1").drop("n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a08_status_cube(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT r_name, count(*) AS n_nations, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a10_listing(t: Tables) -> DataFrame:
    d = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return d.groupBy("r_name").agg(F.count("*").alias("n_nations"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def a11_top_predicates(t: Tables) -> DataFrame:
    return ranking.top(t.events.groupBy("event_type").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("event_type")], 3)


@query("SELECT CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1")
def a12_bands(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.groupBy(F.when(p >= 400000, "high").when(p >= 100000, "medium").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT round(count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders), 4) AS grounding_rate FROM lineitem")
def a14_grounding_rate(t: Tables) -> DataFrame:
    n = t.orders.agg(F.count("*").alias("n"))
    return t.lineitem.agg(F.count_distinct("l_orderkey").alias("g")).crossJoin(n).select(F.round(F.col("g") / F.col("n"), 4).alias("grounding_rate"))


@query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS x, list(DISTINCT l_linestatus || l_returnflag) AS y FROM lineitem GROUP BY 1),
b AS (SELECT k, len(list_intersect(x, ['A', 'R'])) AS hit, len(x) AS n FROM a) SELECT k, round(hit / n, 6) AS precision, round(hit / 2, 6) AS recall, round(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / n) * (hit / 2) / (hit / n + hit / 2) END, 6) AS f1 FROM b""")
def a16_set_metrics(t: Tables) -> DataFrame:
    from ..operators.evaluation import set_metrics

    d = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("x"))
    m = set_metrics(F.col("x"), F.array(F.lit("A"), F.lit("R")))
    return d.select("k", *[F.round(c, 6).alias(n) for n, c in m.items()])


@query("""WITH v AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1) SELECT event_type, len(v) AS n, v[greatest(1, ceil(len(v) * 0.5)::INT)] AS p50, v[greatest(1, ceil(len(v) * 0.95)::INT)] AS p95 FROM v""")
def a17_nearest_rank(t: Tables) -> DataFrame:
    return ranking.nearest_rank(t.events, "value", (0.5, 0.95), ["event_type"])


@query("""SELECT user_id, count(DISTINCT event_type) AS n_values, count(*) FILTER (value >= 15) AS n_sure FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 AND count(*) FILTER (value >= 15) > 1""")
def a22_contradictions(t: Tables) -> DataFrame:
    return mining.contradictions(t.events, ["user_id"], "event_type", "value", 15.0)


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, round(avg(CAST(quality AS DOUBLE)), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a27_distribution(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("quality"))


# ------------------------------------------------------------------ windows, top-k, sets


@query("""WITH d AS (SELECT *, lower(split_part(text, chr(10), 1)) AS t FROM documents) SELECT doc_id, row_number() OVER w AS place, first_value(doc_id) OVER w AS keeper, count(*) OVER (PARTITION BY t, lang) AS copies
FROM d WINDOW w AS (PARTITION BY t, lang ORDER BY n_chars DESC, doc_id) QUALIFY copies > 1""")
def w01_duplicate_titles(t: Tables) -> DataFrame:
    d = t.documents.withColumn("title", F.substring_index("text", "\n", 1))
    return mining.duplicate_titles(d, "title", ["lang"], [F.desc("n_chars"), F.asc("doc_id")], "doc_id").select("doc_id", F.col("place").cast("long").alias("place"), "keeper", "copies")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w02_latest_per_key(t: Tables) -> DataFrame:
    return ranking.first_per_key(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations")
def w05_turn_segments(t: Tables) -> DataFrame:
    return folds.segments(t.conversations, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "segment")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS started FROM s GROUP BY 1, 2""")
def x13_sessions(t: Tables) -> DataFrame:
    return folds.sessions(t.events, ["user_id"], "ts", ["ts", "event_id"], 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x13_tumbling_windows(t: Tables) -> DataFrame:
    d = t.events.withColumn("b", F.window(F.col("ts"), "6 hours"))
    return d.groupBy(F.col("b.start").alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, ts FROM events ORDER BY ts ASC NULLS LAST, event_id LIMIT 50")
def t03_timeline(t: Tables) -> DataFrame:
    return ranking.top(t.events, [F.asc_nulls_last("ts"), F.asc("event_id")], 50).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25")
def t12_keyed_order(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return ranking.top(t.orders, [F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).otherwise(2), F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_totalprice")


@query("SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def u01_union_kinds(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60")
def u06_difference(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").select("user_id").distinct().join(t.events.where("event_type = 'signup' and value > 60").select("user_id"), "user_id", "left_anti")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def u06_intersection(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").select("user_id").intersect(t.events.where("event_type = 'error'").select("user_id"))


# ------------------------------------------------------------------ retrieval

TERM_SQL = text_sql.STREAM
VEC_SQL = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT e FROM q) AS DOUBLE[])), 6) AS sim FROM embeddings WHERE vec_id <> 0),
vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 60)"""
LAB_SQL = "lab AS (SELECT doc_id, row_number() OVER (ORDER BY quality DESC, toxic, doc_id) AS rank FROM labels QUALIFY rank <= 60)"


def text_stream(t: Tables, limit: int = 60, question: str = "rewhing edon") -> DataFrame:
    """The documents that hold all lexemes of the question, by cover density."""
    d = fulltext.matching(t.documents.select(F.col("doc_id").alias("object_id"), "text"), "text", question)
    return ranking.stream(d.select("object_id", F.round("v", 9).alias("v")), "fts", [F.desc("v"), F.asc("object_id")], limit).drop("v")


def vector_stream(t: Tables, limit: int = 60) -> DataFrame:
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    d = t.embeddings.where("vec_id <> 0").crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("object_id"), F.round(S.cosine(F.col("embedding"), F.col("q")), 6).alias("v"))
    return ranking.stream(d, "vector", [F.desc_nulls_last("v"), F.asc("object_id")], limit).drop("v")


def label_stream(t: Tables, limit: int = 60) -> DataFrame:
    d = t.labels.select(F.col("doc_id").alias("object_id"), "quality", "toxic")
    return ranking.stream(d, "structured", [F.desc("quality"), F.asc("toxic"), F.asc("object_id")], limit).drop("quality", "toxic")


@query(f"WITH {TERM_SQL} SELECT doc_id, rank FROM fts")
def r02_text_stream(t: Tables) -> DataFrame:
    return text_stream(t).select(F.col("object_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VEC_SQL} SELECT doc_id, rank FROM vec")
def r03_vector_stream(t: Tables) -> DataFrame:
    return vector_stream(t).select(F.col("object_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TERM_SQL}, {VEC_SQL}, {LAB_SQL}, u AS (SELECT doc_id, 0.35 / (60 + rank) AS s FROM vec UNION ALL SELECT doc_id, 0.25 / (60 + rank) FROM lab UNION ALL SELECT doc_id, 0.20 / (60 + rank) FROM fts)
SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY 1""")
def r07_rank_fusion(t: Tables) -> DataFrame:
    d = ranking.fuse([vector_stream(t), label_stream(t), text_stream(t)], S.WEIGHTS)
    return d.select(F.col("object_id").alias("doc_id"), F.round("total_score", 9).alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * (11.0 - l_linenumber) / 5.0, 6) AS boosted FROM lineitem")
def r09_priority_boost(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_discount") * S.priority_boost("l_linenumber"), 6).alias("boosted"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_.:-]*')) AS n_tokens, contains(lower(text), 'must') OR contains(lower(text), 'should') OR contains(lower(text), 'guardrail') OR contains(lower(text), 'policy') OR contains(lower(text), 'require') OR contains(lower(text), 'depends') AS asks_constraint FROM documents")
def r11_query_plan(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.query_tokens("text")).cast("long").alias("n_tokens"), F.array_contains(X.predicate_hints("text"), "constraint").alias("asks_constraint"))


# ------------------------------------------------------------------ derivation and scores


@query("""SELECT o_orderkey, CAST(round(least(100.0, CASE WHEN o_orderpriority = '1-URGENT' THEN 50 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 15 WHEN o_orderstatus = 'O' THEN 10 ELSE 0 END
+ CASE WHEN o_totalprice > 400000 THEN 20 WHEN o_totalprice > 200000 THEN 10 ELSE 0 END + greatest(0.0, 20 - 0.1 * floor((epoch(TIMESTAMP '1998-12-01') - epoch(o_orderdate)) / 86400)))) AS INTEGER) AS importance FROM orders""")
def c07_importance(t: Tables) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    classes = F.when(status == "F", "human_curated").when(status == "O", "deterministic").otherwise("single_source_llm")
    grave = F.when(price > 400000, "critical").when(price > 200000, "high").otherwise("low")
    return t.orders.select("o_orderkey", S.importance(F.col("o_orderpriority") == "1-URGENT", classes, grave, F.col("o_orderdate").cast("timestamp"), F.lit("1998-12-01 00:00:00").cast("timestamp")).alias("importance"))


@query("SELECT DISTINCT p_type, p_brand, sha256('v1|default|part|' || p_brand || '|is_a|type|' || p_type) AS fingerprint FROM part")
def c09_edge_fingerprint(t: Tables) -> DataFrame:
    e = t.part.select("p_type", "p_brand").distinct().withColumns({"tenant": F.lit("default"), "source_type": F.lit("part"), "source_id": F.col("p_brand"), "edge_type": F.lit("is_a"), "target_type": F.lit("type"), "target_id": F.col("p_type")})
    return e.select("p_type", "p_brand", graph.edge_fingerprint().alias("fingerprint"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (value < 2) AS gaps FROM events GROUP BY 1)
SELECT user_id, CASE WHEN bad > 25 OR gaps >= 10 THEN 'critical' WHEN gaps > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM u""")
def c14_health(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count_if(F.col("value") < 2).alias("gaps"))
    return u.select("user_id", S.health_status(F.greatest(F.col("bad") - 25, F.lit(0)), F.lit(0.0), F.lit(0.0), F.col("gaps")).alias("status"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (event_type = 'error') / count(*) AS a, count(*) FILTER (event_type = 'view') / count(*) AS b, count(*) FILTER (event_type = 'click') / count(*) AS c FROM events GROUP BY 1)
SELECT user_id, round(least(1.0, greatest(0.0, 0.45 * a + 0.25 * b + 0.30 * c + 0.20)), 6) AS risk FROM u""")
def c15_risk(t: Tables) -> DataFrame:
    share = lambda k: F.count_if(F.col("event_type") == k) / F.count("*")
    u = t.events.groupBy("user_id").agg(share("error").alias("a"), share("view").alias("b"), share("click").alias("c"))
    return u.select("user_id", F.round(S.retention_risk(F.col("a"), F.col("b"), F.col("c"), F.lit("degraded")), 6).alias("risk"))


@query("SELECT event_id, round(least(1.0, pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts)) / 1000000.0) / 86400.0)), 6) AS freshness FROM events")
def c22_freshness(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(S.freshness(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp")), 6).alias("freshness"))


_SAID = ("root_cause", "Happens before", "follows", "fix_summary", "status", "mitigation", "superseded by", "duplicate of", "requires", "note")
_VALUE = ("plain", "needs a FIX", "depends on x", "mitigated", "supersedes y", "duplicates z", "was remediated")


@query(f"""WITH f AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'counter' ELSE 'supporting' END AS support, ['cause', 'impact', 'decision', 'remediation', 'constraint'][p_size % 5 + 1] AS kind,
lower({list(_SAID)}[CAST(floor(p_retailprice) AS BIGINT) % 10 + 1]) AS p, lower({list(_VALUE)}[p_partkey % 7 + 1]) AS o FROM part)
SELECT p_partkey, CASE WHEN support = 'counter' THEN 'contradicts' WHEN kind = 'cause' OR p LIKE '%caus%' THEN 'caused_by' WHEN p LIKE '%preced%' OR p LIKE '%before%' THEN 'precedes' WHEN p LIKE '%follow%' OR p LIKE '%after%' THEN 'follows'
WHEN kind = 'remediation' OR p LIKE '%fix%' OR p LIKE '%remediat%' OR o LIKE '%fix%' OR o LIKE '%remediat%' THEN 'fixes' WHEN p LIKE '%mitigat%' OR o LIKE '%mitigat%' THEN 'mitigates' WHEN p LIKE '%supersed%' OR o LIKE '%supersed%' THEN 'supersedes'
WHEN p LIKE '%duplicat%' OR o LIKE '%duplicat%' THEN 'duplicates' WHEN p LIKE '%depend%' OR p LIKE '%require%' OR o LIKE '%depend%' OR o LIKE '%require%' THEN 'depends_on' ELSE 'supports' END AS edge_type FROM f""")
def c08_edge_types(t: Tables) -> DataFrame:
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    support = F.when(F.col("p_size") % 7 == 0, "counter").otherwise("supporting")
    kind = pick(("cause", "impact", "decision", "remediation", "constraint"), F.col("p_size") % 5)
    return t.part.select("p_partkey", mining.edge_type(support, kind, pick(_SAID, F.floor("p_retailprice") % 10), pick(_VALUE, F.col("p_partkey") % 7)).alias("edge_type"))


@query(r"""SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [trim(text)] END AS steps FROM (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n|;'),
lambda x: trim(regexp_replace(trim(x), '^([-*•]|[0-9]+[.)]|[sS][tT][eE][pP]\s+[0-9]+[:.)]?)\s*', ''))), lambda x: length(x) >= 4) AS s FROM documents)""")
def c11_procedure_steps(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", mining.steps(F.col("text")).alias("steps"))


@query(f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE CAST(greatest(1, ceil(greatest(length(text) / 4.0, len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) * 1.3))) AS BIGINT) END AS token_count FROM documents")
def s12_token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.token_estimate("text").alias("token_count"))


@query("SELECT doc_id, sha256(text) AS fingerprint, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM documents")
def s12_hash_and_slug(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("fingerprint"), X.slug("text").alias("slug"))


@query("SELECT c.c_custkey, c.c_acctbal FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey)")
def k04_insert_if_absent(t: Tables) -> DataFrame:
    return merge.insert_if_absent(t.supplier.select(F.col("s_suppkey").alias("c_custkey")), t.customer.select("c_custkey", "c_acctbal"), ["c_custkey"])


@query("""SELECT coalesce(s.s_suppkey, c.c_custkey) AS k, greatest(s.s_acctbal, c.c_acctbal) AS balance, coalesce(c.c_nationkey, s.s_nationkey) AS nation, s.s_suppkey IS NULL AS inserted FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey""")
def k06_upsert(t: Tables) -> DataFrame:
    old = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    new = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return merge.upsert(old, new, ["k"], {"balance": "greatest"}).drop("touched")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 300000 THEN 'C' ELSE o_orderstatus END AS o_orderstatus, o_orderstatus = 'P' AND o_totalprice > 300000 AS touched FROM orders")
def k09_guarded_update(t: Tables) -> DataFrame:
    return merge.update_where(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000), {"o_orderstatus": F.lit("C")}).drop("o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey LIMIT 100)")
def k11_bounded_delete(t: Tables) -> DataFrame:
    return merge.delete_first(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate"), F.col("o_orderstatus") == "F", [F.asc("o_orderdate"), F.asc("o_orderkey")], 100, "o_orderkey")[0].select("o_orderkey")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'purchase' THEN 0.25 WHEN 'error' THEN -0.375 WHEN 'signup' THEN 0.125 ELSE 0.0 END AS d FROM events),
f AS (SELECT user_id, n, greatest(0.0, least(1.0, 0.5 + d))::DOUBLE AS score FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, greatest(0.0, least(1.0, f.score + e.d)) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, round(arg_max(score, n), 6) AS score, max(n) AS steps FROM f GROUP BY 1""")
def x06_feedback_fold(t: Tables) -> DataFrame:
    k = F.col("event_type")
    d = t.events.withColumn("d", F.when(k == "purchase", 0.25).when(k == "error", -0.375).when(k == "signup", 0.125).otherwise(0.0))
    return folds.clamped_sum(d, ["user_id"], ["ts", "event_id"], "d", bucket=F.to_date("ts")).select("user_id", F.round("score", 6).alias("score"), "steps")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r FROM documents),
f AS (SELECT source, r, CASE WHEN n <= 20000 THEN [doc_id] ELSE [] END AS items, CASE WHEN n <= 20000 THEN n ELSE 0 END AS used FROM o WHERE r = 1
UNION ALL SELECT o.source, o.r, CASE WHEN f.used + o.n <= 20000 THEN list_append(f.items, o.doc_id) ELSE f.items END, CASE WHEN f.used + o.n <= 20000 THEN f.used + o.n ELSE f.used END FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
SELECT source, arg_max(items, r) AS items, max(used) AS used FROM f GROUP BY 1""")
def w04_budget_packing(t: Tables) -> DataFrame:
    return folds.pack(t.documents, ["source"], [F.asc("n_chars"), F.asc("doc_id")], "n_chars", "doc_id", 20_000)


@query("SELECT user_id, lead(ts) OVER w AS next_ts, lag(event_type) OVER w AS previous, ntile(4) OVER w AS quarter, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def g16_lead_lag_ntile(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("user_id", F.lead("ts").over(w).alias("next_ts"), F.lag("event_type").over(w).alias("previous"), F.ntile(4).over(w).cast("long").alias("quarter"), "event_id")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def g16_rollup(t: Tables) -> DataFrame:
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def s04_page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"))
