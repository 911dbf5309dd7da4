"""More of the engine's operators over the driver tables (see ``queries``): lookups, guards, ladders, audits, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import predicates as P
from ..functions import scores as S
from ..functions import text as X
from ..operators import evaluation, folds, graph, merge, ranking
from .engine import Engine
from .queries import EDGES_SQL, LAB_SQL, TERM_SQL, VEC_SQL, Tables, edges, label_stream, query, seeds, text_stream, ts, vector_stream


@query("SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT conv_id FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def s03_duplicate_keys(t: Tables) -> DataFrame:
    a = merge.duplicate_keys(t.documents, ["doc_id"]).select("doc_id")
    b = merge.duplicate_keys(t.conversations, ["conv_id", "role"]).select(F.col("conv_id").alias("doc_id")).distinct()
    return a.union(b)


@query("SELECT vec_id, d.text IS NULL AS orphan FROM embeddings LEFT JOIN documents d ON d.doc_id = vec_id WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def s21_embedding_candidates(t: Tables) -> DataFrame:
    d = t.embeddings.select("vec_id").join(t.labels.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")
    d = d.join(t.documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    return d.select("vec_id", F.col("text").isNull().alias("orphan"))


@query("""SELECT c_custkey, coalesce(s.s_name, n.n_name, 'none') AS project FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 8000 GROUP BY 1) s ON s.s_nationkey = c_nationkey LEFT JOIN nation n ON n.n_nationkey = c_nationkey""")
def s22_project_resolver(t: Tables) -> DataFrame:
    first = t.supplier.where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("s_name"))
    d = t.customer.join(first, "c_nationkey", "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return d.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("none")).alias("project"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.user_id AND l.toxic = 1)")
def f09_overlay_visibility(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id").join(t.labels.where("toxic = 1").select(F.col("doc_id").alias("user_id")), "user_id", "left_anti").select("event_id")


@query("SELECT event_id FROM events WHERE regexp_matches(lower(concat_ws(' ', event_type, props)), '(fail|failed|failure|unresolved|regress|regressed|unsuccessful|did not|error)')")
def f13_failure_signal(t: Tables) -> DataFrame:
    return t.events.where(F.lower(F.concat_ws(" ", "event_type", "props")).rlike(S.FAILURE)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate > TIMESTAMP '1998-01-01'")
def f20_session_liveness(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", "idle").otherwise("closed")
    return t.orders.select("o_orderkey", status.alias("status"), F.col("o_orderdate").alias("expires_at")).where(P.live_session(ts("1998-01-01 00:00:00"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND epoch(o_orderdate) < epoch(TIMESTAMP '1998-06-01') - 300) OR (o_orderstatus = 'F' AND o_custkey % 7 < 5 AND o_orderdate <= TIMESTAMP '1998-06-01')")
def f23_claimable_rows(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    d = t.orders.select("o_orderkey", F.when(s == "P", "pending").when(s == "O", "processing").otherwise("failed").alias("status"), F.col("o_orderdate").cast("timestamp").alias("claimed_at"), F.col("o_orderdate").cast("timestamp").alias("next_retry_at"), (F.col("o_custkey") % 7).alias("attempt_count"))
    return d.where(P.claimable(F.lit("1998-06-01 00:00:00").cast("timestamp"))).select("o_orderkey")


@query("SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z0-9_])the([^a-z0-9_]|$)') AS names_the FROM documents")
def f28_token_boundary(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_contains(X.token_boundary_search("text", ["the"]), "the").alias("names_the"))


@query("SELECT e.event_id, coalesce(c.c_name, 'user ' || e.user_id) AS label FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_acctbal > 0")
def j02_label_fallback(t: Tables) -> DataFrame:
    d = t.events.join(t.customer.where("c_acctbal > 0"), F.col("user_id") == F.col("c_custkey"), "left")
    return d.select("event_id", F.coalesce("c_name", F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("label"))


@query(f"""WITH e AS {EDGES_SQL}, m AS (SELECT 'supplier' AS far_type, s AS far_id FROM e WHERE p IN ('1', '2') UNION SELECT 'part', p FROM e WHERE s = '3')
SELECT far_type, far_id, coalesce(p_name, s_name) AS title FROM m LEFT JOIN part ON far_type = 'part' AND CAST(p_partkey AS VARCHAR) = far_id LEFT JOIN supplier ON far_type = 'supplier' AND CAST(s_suppkey AS VARCHAR) = far_id""")
def j06_typed_node_lookup(t: Tables) -> DataFrame:
    far = graph.touching(edges(t), seeds(t)).select("far_type", "far_id").distinct()
    part = far.where("far_type = 'part'").join(t.part.select(F.col("p_partkey").cast("string").alias("far_id"), F.col("p_name").alias("title")), "far_id", "left")
    supplier = far.where("far_type = 'supplier'").join(t.supplier.select(F.col("s_suppkey").cast("string").alias("far_id"), F.col("s_name").alias("title")), "far_id", "left")
    return part.unionByName(supplier)


@query("SELECT vec_id, lang, label FROM embeddings JOIN documents ON vec_id = doc_id WHERE label < 3 AND lang IN ('en', 'de')")
def j07_role_index(t: Tables) -> DataFrame:
    return t.embeddings.where("label < 3").join(t.documents.where(F.col("lang").isin("en", "de")), F.col("vec_id") == F.col("doc_id")).select("vec_id", "lang", "label")


@query("SELECT n_name, count(r_name) AS hits FROM nation LEFT JOIN region ON contains(n_name, CAST(r_regionkey AS VARCHAR)) GROUP BY 1")
def j20_substring_join(t: Tables) -> DataFrame:
    d = t.nation.join(F.broadcast(t.region), F.contains(F.col("n_name"), F.col("r_regionkey").cast("string")), "left")  # region has five rows
    return d.groupBy("n_name").agg(F.count("r_name").alias("hits"))


@query("SELECT a.s_suppkey AS source, b.c_custkey AS target FROM supplier a JOIN customer b ON a.s_nationkey = b.c_nationkey AND substr(a.s_name, 10) = substr(b.c_name, 10)")
def j24_cross_tenant_match(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("k"), F.expr("substr(s_name, 10)").alias("name"))
    b = t.customer.select(F.col("c_custkey").alias("target"), F.col("c_nationkey").alias("k"), F.expr("substr(c_name, 10)").alias("name"))
    return a.join(b, ["k", "name"]).select("source", "target")


@query("SELECT o_orderkey, coalesce(m, o_orderdate) AS o_orderdate FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def j25_update_from(t: Tables) -> DataFrame:
    src = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("o_orderdate"))
    return merge.update_from(t.orders.select("o_orderkey", "o_orderdate"), src, ["o_orderkey"], ["o_orderdate"])


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 49)")
def j31_unprotected(t: Tables) -> DataFrame:
    guard = t.lineitem.where("l_quantity > 49").join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.supplier.where("s_acctbal < 2000").select("s_suppkey").join(guard, "s_suppkey", "left_anti")


@query("""SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 5000) AS large, sum(n_chars) AS chars, round(avg(n_chars), 6) AS mean_chars, sum(strlen(text)) AS bytes FROM documents GROUP BY 1""")
def a05_usage(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("large"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT conv_id, to_json(list({'turn': turn, 'role': role} ORDER BY turn)) AS steps FROM conversations GROUP BY 1")
def a06_ordered_json(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("steps"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1 ORDER BY n DESC, event_type")
def a09_histogram(t: Tables) -> DataFrame:
    return t.events.where("value > 10").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("""SELECT round(avg(CAST(quality AS DOUBLE)), 6) AS useful, round(avg(CAST(toxic AS DOUBLE)), 6) AS bad, round(avg(CASE WHEN n_chars > 5000 THEN 1.0 ELSE 0.0 END), 6) AS truncated,
avg(CAST(quality AS DOUBLE)) >= 0.7 AND avg(CAST(toxic AS DOUBLE)) < 0.1 AND avg(CASE WHEN n_chars > 5000 THEN 1.0 ELSE 0.0 END) < 0.25 AS passed FROM labels JOIN documents USING (doc_id)""")
def a21_shadow_verdict(t: Tables) -> DataFrame:
    runs = t.labels.join(t.documents, "doc_id").select((F.col("quality") == 1).alias("useful"), (F.col("toxic") == 1).alias("bad"), (F.col("n_chars") > 5000).alias("truncated"))
    d = evaluation.shadow_verdict(runs)
    return d.select(*[F.round(c, 6).alias(c) for c in ("useful", "bad", "truncated")], "passed")


@query("SELECT lang, map_from_entries(list({'k': source, 'v': n} ORDER BY source)) AS sources FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def a25_class_distribution(t: Tables) -> DataFrame:
    d = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return d.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))


@query(f"WITH {LAB_SQL}, {VEC_SQL}, x AS (SELECT doc_id FROM lab WHERE rank <= 10 UNION SELECT doc_id FROM vec WHERE rank <= 10) SELECT count(*) AS queries, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM x LEFT JOIN labels USING (doc_id)")
def a28_relevance_at_k(t: Tables) -> DataFrame:
    d = label_stream(t).where("rank <= 10").select("object_id").union(vector_stream(t).where("rank <= 10").select("object_id")).distinct()
    d = d.join(t.labels, F.col("object_id") == F.col("doc_id"), "left")
    return d.agg(F.count("*").alias("queries"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("hits"))


@query("""SELECT k, ordered FROM (SELECT conv_id AS k, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1), LATERAL (SELECT contains(array_to_string(list_filter(r, lambda x: x IN ('user', 'assistant')), ' '), 'user assistant') AS ordered)""")
def w07_ordered_subset(t: Tables) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    d = t.conversations.groupBy(F.col("conv_id").alias("k")).agg(roles.alias("r"))
    return d.select("k", folds.contains_in_order(F.col("r"), F.array(F.lit("user"), F.lit("assistant"))).alias("ordered"))


@query(f"""WITH {TERM_SQL}, {LAB_SQL}, u AS (SELECT doc_id, 0.25 / (60 + rank) AS s, 0 AS p, rank FROM lab UNION ALL SELECT doc_id, 0.20 / (60 + rank), 1, rank FROM fts)
SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY 1 ORDER BY sum(s) DESC, min((p, rank)) LIMIT 10""")
def t02_stable_final_rank(t: Tables) -> DataFrame:
    fused = ranking.fuse([label_stream(t), text_stream(t)], {"structured": 0.25, "fts": 0.20})
    return ranking.ranked(fused, 10).select(F.col("object_id").alias("doc_id"), F.round("total_score", 9).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'merged' WHEN o_orderstatus = 'P' THEN 'created' END AS kind FROM orders WHERE o_totalprice > 450000 UNION ALL
SELECT o_orderkey, 'demoted' FROM orders WHERE o_orderdate < TIMESTAMP '1996-02-01' UNION ALL SELECT o_orderkey, 'retired' FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 2000""")
def u03_proposal_union(t: Tables) -> DataFrame:
    o = t.orders
    a = o.where("o_totalprice > 450000").select("o_orderkey", F.lit("merged").alias("kind"))
    b = o.where(F.col("o_orderdate") < ts("1996-02-01 00:00:00")).select("o_orderkey", F.lit("demoted").alias("kind"))
    return a.unionByName(b).unionByName(o.where("o_orderstatus = 'F' and o_totalprice < 2000").select("o_orderkey", F.lit("retired").alias("kind")))


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1")
def u08_first_of_pair(t: Tables) -> DataFrame:
    return ranking.first_per_key(t.documents, ["source", "lang"], [F.asc("doc_id")]).select("doc_id", "source", "lang")


@query(f"""WITH {TERM_SQL}, f AS (SELECT doc_id FROM fts WHERE rank <= 10), s AS (SELECT DISTINCT source FROM documents SEMI JOIN f USING (doc_id))
SELECT doc_id, n_chars FROM documents SEMI JOIN s USING (source) WHERE doc_id NOT IN (SELECT doc_id FROM f) ORDER BY n_chars DESC, doc_id LIMIT 20""")
def r05_expansion(t: Tables) -> DataFrame:
    found = text_stream(t).where("rank <= 10").select(F.col("object_id").alias("doc_id"))
    near = t.documents.join(found, "doc_id", "left_semi").select("source").distinct()
    d = t.documents.join(near, "source", "left_semi").join(found, "doc_id", "left_anti")
    return ranking.top(d.select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 20)


@query("""WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS s, l_linestatus AS p, l_returnflag AS k, CAST(l_quantity AS VARCHAR) AS v, l_orderkey AS e, concat_ws('-', l_orderkey, l_linenumber) AS f FROM lineitem),
c AS (SELECT s, p, k, count(DISTINCT e) AS n, count(DISTINCT f) AS facts FROM f GROUP BY 1, 2, 3 HAVING n >= 2), m AS (SELECT s, p, k, v FROM (SELECT s, p, k, v, count(*) AS q FROM f GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY s, p, k ORDER BY q DESC, v) = 1)
SELECT s || ' ' || p || ' (' || k || ')' AS title, 'Pattern: ' || s || ' exhibits "' || p || '" behavior.' || chr(10) || 'Kind: ' || k || chr(10) || 'Support: ' || n || ' independent episodes confirm this pattern.' || chr(10) || 'Representative value: ' || v || chr(10)
|| 'Episodes: ' || n || ' corroborating episodes.' || chr(10) || 'Facts: ' || facts || ' supporting facts.' AS narrative, CAST(n AS INTEGER) AS support_count, CAST(least(0.5 + n * 0.1, 0.95) AS DOUBLE) AS confidence, 'published' AS lifecycle_state, CAST(n + facts AS BIGINT) AS supports FROM c JOIN m USING (s, p, k)""")
def c02_reconcile(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    facts = t.lineitem.select(F.lit("default").alias("tenant"), text("l_suppkey").alias("subject_entity_id"), F.col("l_linestatus").alias("predicate"), F.col("l_returnflag").alias("fact_kind"), text("l_quantity").alias("object_value"), text("l_orderkey").alias("episode_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), F.lit("deterministic").alias("assertion_class"), F.lit("active").alias("current_status"), F.lit(0.9).alias("confidence"))
    merged, support = Engine(Catalog(t.spark, tables={"fact": facts})).reconcile_patterns()
    n = support.groupBy("memory_id").agg(F.count("*").alias("supports"))
    return merged.join(n, "memory_id").select("title", "narrative", "support_count", F.col("confidence").cast("double").alias("confidence"), "lifecycle_state", "supports")


@query("SELECT user_id, round(least(1.0, greatest(0.0, avg(value) / 30 + least(0.2, count(*) FILTER (event_type = 'purchase') * 0.03) + 0.1 - least(0.3, count(*) FILTER (event_type = 'error') * 0.08))), 6) AS confidence FROM events GROUP BY 1")
def c22_confidence(t: Tables) -> DataFrame:
    d = t.events.groupBy("user_id").agg((F.avg("value") / 30).alias("b"), F.count_if(F.col("event_type") == "purchase").alias("s"), F.count_if(F.col("event_type") == "error").alias("c"))
    return d.select("user_id", F.round(S.confidence(F.col("b"), F.col("s"), F.col("c"), F.lit(1.0)), 6).alias("confidence"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failure_mode' WHEN 'purchase' THEN 'tool' ELSE 'action' END AS cue FROM events")
def c21_cue_types(t: Tables) -> DataFrame:
    return t.events.select("event_id", S.cue_type(F.when(F.col("event_type") == "purchase", "tool_called").otherwise(F.col("event_type"))).alias("cue"))


@query("SELECT l_linenumber AS attempt, least(3600.0, pow(2.0, l_linenumber) * 30.0) AS wait FROM lineitem GROUP BY 1")
def x04_backoff(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linenumber").alias("attempt")).distinct().select("attempt", S.backoff_seconds(F.col("attempt")).alias("wait"))


@query("SELECT 'memory/' || substr(c_name, 1, 14) || '/' || c_custkey AS path FROM customer")
def k23_rebased_scopes(t: Tables) -> DataFrame:
    path = F.concat(F.lit("old/"), F.substring("c_name", 1, 14), F.lit("/"), F.col("c_custkey").cast("string"))
    return t.customer.select(merge.rebase_prefix(path, "old/", "memory/").alias("path"))


@query("""SELECT lang, '# ' || upper(lang) || chr(10) || string_agg('- ' || doc_id || ' (' || n_chars || ')', chr(10) ORDER BY doc_id) AS note FROM documents WHERE n_chars > 12000 GROUP BY 1""")
def k22_markdown_notes(t: Tables) -> DataFrame:
    line = F.format_string("- %d (%d)", "doc_id", "n_chars")
    d = t.documents.where("n_chars > 12000").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("l")))).alias("x"))
    return d.select("lang", F.concat(F.lit("# "), F.upper("lang"), F.lit("\n"), F.array_join(F.transform("x", lambda r: r["l"]), "\n")).alias("note"))


@query("SELECT (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM events) AS n, (SELECT min(ts) FROM events) AS first_ts")
def a24_corpus_stats(t: Tables) -> DataFrame:
    return t.events.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query("SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events")
def g16_frame_gaps(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return t.events.select("user_id", "event_id", (us(F.col("ts")) - us(F.lag("ts").over(w))).alias("gap_us"))


def x13_stream_windows(t: Tables) -> DataFrame:
    """The events table as a file stream through tumbling windows, complete when the stream has ended."""
    from ..streaming import streams

    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        import tempfile

        base = tempfile.mkdtemp(prefix="lodestone-stream-")
    import uuid

    root = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = streams.event_stream(t.spark, f"{t.sf_dir}/events.parquet*")
    grouped = rows.groupBy(F.window("event_time", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    flat = grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
    streams.drain(flat, lambda d, i: d.write.mode("overwrite").parquet(f"{root}/out"), f"{root}/ckpt", "complete")
    return t.spark.read.parquet(f"{root}/out")


query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(x13_stream_windows)
