"""Queries of batched retrieval and prompt packages: the engine over a catalog whose tables come from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as X
from ..operators import snapshot
from .engine import Engine
from .queries import Tables, query

ROLE_NAMES = ("evidence", "text", "procedure", "media_caption", "visual_ocr", "visual_caption")


def role_catalog(t: Tables) -> Catalog:
    """Orders as facts, documents as segments, parts as procedures, pages as media, customers as regions of media; six vectors in a row lead to five objects of one id."""
    tenant, text = F.lit("default").alias("tenant"), lambda c: F.col(c).cast("string")
    facts = t.orders.select(
        tenant, text("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_value"), F.col("o_orderdate").alias("valid_from"), F.lit("project:a").alias("scope_path"),
        F.when(F.col("o_orderstatus") == "F", "superseded").otherwise("active").alias("current_status"),
    )
    segments = t.documents.select(tenant, text("doc_id").alias("segment_id"), F.col("source").alias("section_label"), F.col("text").alias("content"), F.lit("project:a").alias("scope_path"))
    procedures = t.part.select(tenant, text("p_partkey").alias("procedure_id"), F.col("p_name").alias("title"), F.lit("project:a").alias("scope_path"), F.when(F.col("p_partkey") % 5 == 0, "retired").otherwise("draft").alias("lifecycle_state"))
    media = t.pages.select(tenant, text("page_id").alias("media_id"), F.lit("page").alias("media_type"), F.create_map(F.lit("caption"), F.col("url")).alias("media_meta"), F.when(F.col("page_id") % 3 == 0, "project:b").otherwise("project:a").alias("scope_path"))
    regions = t.customer.select(tenant, text("c_custkey").alias("region_id"), text("c_nationkey").alias("media_id"), F.col("c_name").alias("label"), F.lit("box").alias("region_type"))
    vectors = t.embeddings.select(tenant, F.get(F.array(*map(F.lit, ROLE_NAMES)), (F.col("vec_id") % 6).cast("int")).alias("role"), F.floor(F.col("vec_id") / 6).cast("string").alias("_id"), "embedding")
    vectors = vectors.withColumns({c: F.col("_id") for c in ("fact_id", "segment_id", "procedure_id", "media_id", "region_id")})
    return Catalog(t.spark, tables={"fact": facts, "segment": segments, "procedure": procedures, "media_artifact": media, "visual_region": regions, "embedding_index": vectors})


@query("""WITH o AS (SELECT 'fact' AS object_type, 1 AS part, o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1998-06-01' UNION ALL SELECT 'segment', 2, doc_id, source FROM documents
UNION ALL SELECT 'procedure', 3, p_partkey, p_name FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT 'media_artifact', 4, page_id, url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT 'visual_region', 5, c_custkey, c_name FROM customer JOIN pages ON page_id = c_nationkey WHERE page_id % 3 <> 0),
e AS (SELECT least(vec_id % 6 + 1, 5) AS part, vec_id // 6 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS question_id, object_type, part, CAST(id AS VARCHAR) AS object_id, title, max(round(list_cosine_similarity(e.v, CAST(q.embedding AS DOUBLE[])), 6)) AS similarity FROM e JOIN o USING (part, id), embeddings q WHERE q.vec_id % 20 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, part ORDER BY similarity DESC, object_id) AS n FROM s QUALIFY n <= 6)
SELECT question_id, object_type, object_id, title, similarity, row_number() OVER (PARTITION BY question_id ORDER BY part, n) AS rank FROM r""")
def r04_role_vectors(t: Tables) -> DataFrame:
    """The query set is every vector whose id is divisible by 20."""
    questions = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    d = Engine(role_catalog(t)).by_role(questions, limit=2, scope="project:a", at=F.lit("1998-06-01").cast("timestamp"))
    return d.select("question_id", "object_type", "object_id", "title", "similarity", F.col("rank").cast("long").alias("rank"))


PROFILE_NAMES = ("compact", "risk", "deep", None)


def snapshot_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests of 25 nations in three profiles and none; documents as memories of the nations' projects; every third document of the lower nations matches."""
    text = lambda c: F.col(c).cast("string")
    profiles = F.explode(F.array(*map(F.lit, PROFILE_NAMES)))
    requests = t.nation.select("n_nationkey", "n_name", profiles.alias("profile"))
    requests = requests.select(
        F.concat_ws("-", text("n_nationkey"), "profile").alias("request_id"), F.concat(F.lit("/srv/work/"), F.lower("n_name"), F.lit("/src")).alias("cwd"), F.concat(F.lit("/srv/work/"), F.lower("n_name")).alias("git_root"),
        F.concat(F.lit("status of "), "n_name").alias("prompt"), "profile", F.when(F.col("n_nationkey") % 4 == 0, F.col("n_nationkey") * 100 + 100).alias("max_tokens"), F.when(F.col("n_nationkey") == 7, "off").otherwise("shadow").alias("mode"),
    )
    names = t.nation.select("n_nationkey", F.regexp_replace(F.lower("n_name"), "[^a-z0-9_-]+", "-").alias("name"))
    i = F.col("doc_id")
    memories = t.documents.withColumn("n_nationkey", (i % 25).cast("int")).join(names, "n_nationkey").select(
        text("doc_id").alias("memory_id"), F.lit("default").alias("tenant"), F.col("source").alias("title"), F.col("text").alias("narrative"), F.concat(F.lit("project:"), "name").alias("scope_path"), F.lit(None).cast("double").alias("confidence"),
        ((i * 7919 % 1000) / 1000).alias("quality_score"), (i % 10 + 1).cast("int").alias("priority"), F.lit(None).cast("double").alias("strength"), F.lit(None).cast("int").alias("token_count"), F.lit(None).cast("timestamp").alias("updated_at"), F.lit(None).cast("string").alias("source_class"),
        F.when(i % 11 == 0, "retired_superseded").alias("trust_class"), F.when(i % 13 == 0, "quarantined").when(i % 5 == 0, "validated").otherwise("active").alias("governance_status"), F.get(F.array(*map(F.lit, ("policy", "procedural", "episodic", "semantic"))), (i % 4).cast("int")).alias("namespace"),
    )
    matches = t.documents.where("doc_id % 25 < 10 and doc_id % 3 = 0").select(text("doc_id").alias("memory_id"), (i % 25).cast("int").alias("n_nationkey"), (i % 7 / 8).alias("text_rank"))
    matches = matches.join(t.nation.select("n_nationkey", profiles.alias("profile")), "n_nationkey")
    return requests, memories, matches.select(F.concat_ws("-", text("n_nationkey"), "profile").alias("request_id"), "memory_id", "text_rank")


_TOKENS = r"CASE WHEN regexp_full_match({0}, '\s*') THEN 0 ELSE greatest(1, CAST(ceil(greatest(length({0}) / 4, len(regexp_split_to_array(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+')) * CAST(1.3 AS DOUBLE))) AS BIGINT)) END"


def _redacted(c: str) -> str:
    """SQL of the redactions; DuckDB has no look-behind but the same order of replacements."""
    for pattern, by in X.REDACTIONS:
        flags, p = ("gi", pattern[4:]) if pattern.startswith("(?i)") else ("g", pattern)
        quoted, said = p.replace("'", "''"), by.replace("$1", "\\1")
        c = f"regexp_replace({c}, '{quoted}', '{said}', '{flags}')"
    return c


_FIT = r"regexp_replace(substr({0}, 1, {1}), '\s+$', '')"
SNAPSHOT_SQL = rf"""
WITH RECURSIVE q AS (SELECT concat_ws('-', CAST(n_nationkey AS VARCHAR), p) AS request_id, n_nationkey AS n, n_name, p AS profile, CASE WHEN n_nationkey = 7 THEN 'off' ELSE 'shadow' END AS mode,
  CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey * 100 + 100 END AS asked, trim(regexp_replace(lower(n_name), '[^a-z0-9_-]+', '-', 'g'), '-') AS name FROM nation, (SELECT unnest(['compact', 'risk', 'deep', NULL]) AS p)),
r AS (SELECT *, CASE profile WHEN 'compact' THEN least(coalesce(asked, 1200), 1200) WHEN 'risk' THEN least(coalesce(asked, 3000), 3000) WHEN 'deep' THEN least(coalesce(asked, 5000), 5000) ELSE coalesce(asked, 3000) END AS budget FROM q),
rb AS (SELECT *, budget * CASE WHEN profile IS NULL THEN 1 ELSE 4 END AS rbudget FROM r),
m AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source AS title, {_redacted("coalesce(text, '')")} AS content, doc_id % 25 AS n, (doc_id * 7919 % 1000) / 1000 AS quality, doc_id % 10 + 1 AS priority, CASE WHEN doc_id % 5 = 0 THEN 'validated' ELSE 'active' END AS governance,
  ['policy', 'procedural', 'episodic', 'semantic'][doc_id % 4 + 1] AS ns FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0),
mt AS (SELECT *, {_TOKENS.format("content")} AS tokens, regexp_matches(lower(concat_ws(' ', title, content)), '\b(error|fail|failed|failure)\b') AS failing FROM m),
c1 AS (SELECT rb.*, mt.* EXCLUDE (n), doc_id % 7 / 8 AS text_rank, 'runtime-snapshot' AS reason FROM rb JOIN mt ON mt.n = rb.n WHERE doc_id % 25 < 10 AND doc_id % 3 = 0),
c2 AS (SELECT rb.*, mt.* EXCLUDE (n), CAST(0 AS DOUBLE) AS text_rank, 'runtime-snapshot-scope-fallback' AS reason FROM rb JOIN mt ON mt.n = rb.n),
c AS (SELECT *, row_number() OVER w AS place FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2) WINDOW w AS (PARTITION BY request_id, reason ORDER BY text_rank DESC, quality DESC, priority, id) QUALIFY place <= 20),
o AS (SELECT *, row_number() OVER (PARTITION BY request_id, reason ORDER BY text_rank + quality + CASE WHEN governance = 'validated' THEN 0.15 ELSE 0 END + (11 - priority) / 50 DESC, place) AS k FROM c),
f AS (SELECT request_id, reason, k, CASE WHEN tokens <= rbudget THEN rbudget - tokens ELSE 0 END AS rest, tokens > rbudget AS over, true AS taken FROM o WHERE k = 1
  UNION ALL SELECT o.request_id, o.reason, o.k, CASE WHEN NOT f.over AND f.rest > 0 AND tokens <= f.rest THEN f.rest - tokens ELSE f.rest END, f.over, NOT f.over AND f.rest > 0 AND tokens <= f.rest FROM f JOIN o ON o.request_id = f.request_id AND o.reason = f.reason AND o.k = f.k + 1),
p0 AS (SELECT o.* EXCLUDE (content, tokens), over, CASE WHEN over THEN {_FIT.format("content", "greatest(1, rbudget * 4)")} ELSE content END AS content, tokens AS t0 FROM o JOIN f USING (request_id, reason, k) WHERE taken),
p AS (SELECT *, CASE WHEN over THEN {_TOKENS.format("content")} ELSE t0 END AS tokens FROM p0),
sm AS (SELECT request_id, reason, count(*) AS results, count(*) FILTER (tokens <= rbudget AND mode <> 'off') AS items FROM p GROUP BY 1, 2),
use AS (SELECT request_id, CASE WHEN coalesce(items, 0) > 0 THEN 'runtime-snapshot' ELSE 'runtime-snapshot-scope-fallback' END AS reason FROM rb LEFT JOIN (SELECT * FROM sm WHERE reason = 'runtime-snapshot') USING (request_id)),
pk AS (SELECT p.* FROM p JOIN use USING (request_id, reason) WHERE tokens <= rbudget AND mode <> 'off'),
lim AS (SELECT * FROM (VALUES ('compact', 4, 220, 420, 2), ('risk', 5, 850, NULL, NULL), ('deep', 8, 1200, NULL, NULL)) v(profile, cards, body, gt, gc)),
s AS (SELECT pk.*, cards, body, gt, gc, CASE WHEN cards IS NULL THEN tokens ELSE least(tokens, body + 80) END AS cost, reason LIKE '%fallback%' AS generic,
  row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN cards IS NOT NULL AND regexp_matches(lower(concat_ws(' ', id, content)), '\b(github|gitea|public|security|secret|sanitize|merge|dependabot|migration|rollback|incident)\b') THEN -10 ELSE 0 END, k) AS j FROM pk LEFT JOIN lim USING (profile)),
g AS (SELECT request_id, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS nc, CAST(0 AS BIGINT) AS ng, CAST(0 AS BIGINT) AS tg, false AS taken FROM rb
  UNION ALL SELECT s.request_id, s.j, g.nc + x, g.ng + CASE WHEN x = 1 AND generic THEN 1 ELSE 0 END, g.tg + CASE WHEN x = 1 AND generic THEN cost ELSE 0 END, x = 1 FROM g JOIN s ON s.request_id = g.request_id AND s.j = g.j + 1,
  LATERAL (SELECT CASE WHEN cards IS NULL OR (g.nc < cards AND (NOT generic OR ((gc IS NULL OR g.ng < gc) AND (gt IS NULL OR g.tg + cost <= gt)))) THEN 1 ELSE 0 END AS x)),
cards AS (SELECT request_id, count(*) AS n_cards, string_agg(concat('### ', CASE WHEN ns = 'policy' THEN 'policy_and_user_corrected_memory' WHEN failing THEN 'failure_warnings' WHEN ns = 'procedural' THEN 'procedural_suggestions' WHEN ns = 'episodic' THEN 'episodic_context' ELSE 'validated_facts' END,
  chr(10), '- Memory ID: ', id, chr(10), '- Reason: ', reason, chr(10), '- Tokens: ', cost, chr(10), '- Governance: ', governance, chr(10), chr(10),
  CASE WHEN body IS NOT NULL AND {_TOKENS.format("content")} > body THEN concat({_FIT.format("content", "body * 4")}, chr(10), chr(10), '[Full narrative retained in memory.]') ELSE content END, chr(10)), chr(10) ORDER BY j) AS cards FROM s JOIN g USING (request_id, j) WHERE taken GROUP BY 1),
om AS (SELECT c.request_id, string_agg(concat('- ', c.id, ': ', CASE WHEN c.mode = 'off' THEN 'injection_mode_off' ELSE 'token_budget_or_low_rank' END), chr(10) ORDER BY c.place) AS omitted FROM c JOIN use USING (request_id, reason) ANTI JOIN pk ON pk.request_id = c.request_id AND pk.id = c.id GROUP BY 1),
x AS (SELECT rb.*, use.reason, coalesce(n_cards, 0) AS n_cards, concat('Use the following memory snapshot as supporting context only.', chr(10), 'If it conflicts with the live repo, runtime, or direct instructions, trust the live repo and direct instructions.', chr(10), chr(10), '# Memory Snapshot', chr(10), chr(10),
  'Context cwd: /srv/work/', lower(n_name), '/src', chr(10), 'Context git root: /srv/work/', lower(n_name), chr(10), 'Candidate domains: ', name, chr(10), 'Profile: ', coalesce(profile, 'legacy'), chr(10), 'Mode: ', mode, chr(10), 'Injected: no', chr(10),
  'Prompt-eligible memories: ', coalesce(n_cards, 0), chr(10), 'Retrieved memories: ', coalesce(results, 0), chr(10), chr(10),
  CASE WHEN n_cards > 0 THEN concat('## Memories', chr(10), chr(10), cards) ELSE concat('## No Prompt-Eligible Memories', chr(10), chr(10), 'No reviewed memories were returned for this snapshot. Imported assistant memories remain gated until explicitly approved.') END,
  CASE WHEN omitted IS NOT NULL THEN concat(chr(10), '## Omitted', chr(10), chr(10), omitted) ELSE '' END) AS whole
  FROM rb JOIN use USING (request_id) LEFT JOIN cards USING (request_id) LEFT JOIN om USING (request_id) LEFT JOIN sm ON sm.request_id = rb.request_id AND sm.reason = use.reason),
y AS (SELECT *, concat(regexp_replace(whole, '\s+$', ''), chr(10)) AS text, concat(chr(10), chr(10), '## Budget Notice', chr(10), chr(10), 'Snapshot truncated to respect the configured token budget.', chr(10)) AS notice FROM x),
z AS (SELECT *, greatest(1, budget - {_TOKENS.format("notice")}) * 4 AS room FROM y),
cut AS (SELECT request_id, i, concat({_FIT.format("text", "greatest(least(room, 16), room - i * 64)")}, notice) AS t FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((room - least(room, 16)) / 64)) AS BIGINT) + 1)) AS i FROM z WHERE {_TOKENS.format("text")} > budget)),
best AS (SELECT request_id, arg_min(t, i) FILTER (ok) AS t, arg_max(t, i) AS last FROM (SELECT cut.*, {_TOKENS.format("t")} <= budget AS ok FROM cut JOIN rb USING (request_id)) GROUP BY 1)
SELECT request_id, reason LIKE '%fallback' AS fallback, n_cards, coalesce(t, last, text) AS markdown, last IS NOT NULL AS truncated FROM z LEFT JOIN best USING (request_id)"""


@query(SNAPSHOT_SQL)
def r22_snapshots(t: Tables) -> DataFrame:
    requests, memories, matches = snapshot_inputs(t)
    d = snapshot.build(requests, memories, matches)
    return d.select("request_id", "fallback", F.size("cards").cast("long").alias("n_cards"), "markdown", "truncated")
