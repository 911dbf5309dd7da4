"""Queries that run the readers and the stateful intake over exports written from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import embedding, temporal, upkeep
from ..operators.written import folder as scratch
from ..sources import agent_exports, readers
from ..streaming import intake, streams
from .queries import Tables, query


PARTS = 5


def repeated_files(rows: DataFrame, order: str, by: str, path: str) -> None:
    """``rows`` in ``PARTS`` turns by ranges of ``order``; each turn repeats the one before, shuffled, in files by ``by``."""
    top = rows.agg(F.max(order)).first()[0]
    part = F.floor(F.col(order) * PARTS / F.lit((top or 0) + 1))
    for k in range(PARTS):
        turn = rows.where(part.between(k - 1, k))
        turn = turn.unionByName(turn.where(F.pmod(F.xxhash64(order), F.lit(3)) == 0))
        turn.repartition(2, by).sortWithinPartitions(F.xxhash64(order)).drop("_o", "_u").write.mode("append").format("text" if rows.columns[0] == "value" else "parquet").save(path)


@query("SELECT event_id, user_id, event_type, value FROM events")
def x11_once_per_source(t: Tables) -> DataFrame:
    """The events as a feed that repeats itself; with at most 64 ids remembered for a user, each event is taken once."""
    root = scratch(t.spark)
    repeated_files(t.events.select("event_id", "user_id", "event_type", "value"), "event_id", "user_id", f"{root}/in")
    stream = t.spark.readStream.schema("event_id long, user_id long, event_type string, value double").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    return streams.drain_to_parquet(intake.once_per_source(stream, ["user_id"], "event_id", keep=64), f"{root}/out", f"{root}/ckpt")


def update_lines(t: Tables) -> DataFrame:
    """(value, _o, _u): events as update lines; some are edits, some come from bots, some say nothing."""
    e, i = t.events, F.col("event_id")
    said = F.when(F.col("event_type") == "view", "ok").otherwise(F.concat(F.col("event_type"), F.lit(" reported by server-a and nginx, value "), F.col("value").cast("string")))
    person = F.struct(F.col("user_id").alias("id"), (F.col("user_id") % 10 == 0).alias("is_bot"), F.concat(F.lit("User "), "user_id").alias("first_name"), F.when(F.col("user_id") % 3 == 0, "Lee").alias("last_name"))
    message = F.struct(i.alias("message_id"), person.alias("from"), F.struct((F.col("user_id") % 7).alias("id"), F.lit("group").alias("type")).alias("chat"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("date"), said.alias("text"))
    update = F.struct(i.alias("update_id"), F.when(i % 5 != 0, message).alias("message"), F.when(i % 5 == 0, message).alias("edited_message"))
    return e.select(F.to_json(update).alias("value"), i.alias("_o"), F.col("user_id").alias("_u"))



@query("""WITH m AS (SELECT *, 'user_' || user_id || CASE WHEN user_id % 3 = 0 THEN '_lee' ELSE '' END AS who, event_type || ' reported by server-a and nginx, value ' || CAST(value AS VARCHAR) AS said FROM events WHERE user_id % 10 <> 0 AND event_type <> 'view')
SELECT 'messenger:' || (user_id % 7) || ':' || event_id AS source_key, who AS subject, predicate, CASE predicate WHEN 'stated' THEN said WHEN 'mentioned_device' THEN 'server-a' ELSE 'nginx' END AS value, CAST(CASE WHEN predicate = 'stated' THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence, CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts FROM m, (SELECT unnest(['stated', 'mentioned_device', 'mentioned_service']) AS predicate)""")
def s09_messenger(t: Tables) -> DataFrame:
    """Update files that repeat each other, read as a stream: history once per chat, facts of the messages with something to say."""
    root = scratch(t.spark)
    repeated_files(update_lines(t), "_o", "_u", f"{root}/in")
    lines = t.spark.readStream.option("maxFilesPerTrigger", 2).text(f"{root}/in")
    history = streams.drain_to_parquet(intake.once_per_source(intake.messenger_updates(lines), ["chat_id"], "message_id"), f"{root}/out", f"{root}/ckpt")
    d = intake.messages(history, ["server-a", "workstation"], ["nginx", "redis"]).withColumn("f", F.explode("facts"))
    return d.select("source_key", "f.subject", "f.predicate", "f.value", "f.confidence", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""WITH a AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'warning' WHEN event_type = 'error' THEN 'warning' ELSE 'info' END AS severity FROM events WHERE event_id % 2 = 0)
SELECT 'monitoring_alert:' || event_id AS source_key, CASE WHEN event_id % 3 = 0 THEN 'Rule ' || user_id ELSE 'Named ' || event_type END AS subject, predicate,
CASE predicate WHEN 'alert_fired' THEN CASE WHEN event_type = 'error' THEN 'alerting' ELSE 'ok' END WHEN 'severity' THEN severity ELSE 'svc-' || (user_id % 5) END AS value FROM a, (SELECT unnest(['alert_fired', 'severity', 'tagged_service']) AS predicate)""")
def s10_alert_annotations(t: Tables) -> DataFrame:
    """Annotation lines with labels in the text or in tags, read from files into alert facts."""
    i, root = F.col("event_id"), scratch(t.spark)
    service = F.concat(F.lit("service=svc-"), F.col("user_id") % 5)
    named = i % 3 != 0
    label = F.concat(F.lit("{alertname=Named "), "event_type", F.lit(", "), service, F.when(i % 4 == 0, ", Severity=Warning").otherwise(""), F.lit("}"))
    text = F.when(named, F.concat(F.lit("Rule "), "user_id", F.lit(" "), label, F.lit(" - A=1.0"))).otherwise(F.concat(F.lit("Rule "), "user_id"))
    tags = F.when(~named, F.array_compact(F.array(service, F.when(i % 4 == 0, "severity=warning"))))
    line = F.struct(i.alias("id"), F.lit("").alias("alertName"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), tags.alias("tags"), text.alias("text"), F.when(F.col("event_type") == "error", "alerting").otherwise("ok").alias("newState"))
    t.events.where(i % 2 == 0).select(F.to_json(line).alias("value")).write.text(f"{root}/in")
    d = readers.alerts(intake.annotations(t.spark.read.text(f"{root}/in"))).withColumn("f", F.explode("facts"))
    return d.select("source_key", "f.subject", "f.predicate", "f.value")


# ------------------------------------------------------------------ agent exports


def agent_files(t: Tables, root: str) -> None:
    """Conversations as exports: user turns in the prompt history; two thirds of the conversations also as logs, a file for each."""
    c, n, k = t.conversations, F.col("turn"), F.col("conv_id")
    name = F.concat(F.lit("session-"), k)
    users = c.where("role = 'user'")
    prompt = F.to_json(F.struct(name.alias("session_id"), (F.lit(1700000000) + k * 1000 + n).alias("ts"), F.coalesce("text", F.lit("")).alias("text")))
    history = users.select(k.alias("k"), (n * 2).alias("o"), prompt.alias("value")).unionByName(users.where(n == 0).select(k.alias("k"), F.lit(1).cast("long").alias("o"), F.lit("{not json").alias("value")))
    history.repartition(4, "k").sortWithinPartitions("k", "o").select("value").write.text(f"{root}/history")
    line = lambda kind, payload: F.to_json(F.struct(F.lit(kind).alias("type"), payload.alias("payload")))
    rows = c.where(k % 3 != 0)
    cwd = F.concat(F.lit("/srv/"), F.when(k % 2 == 0, "projects").otherwise("work"), F.lit("/p"), k % 7, F.lit("/src"))
    meta = rows.select(k.alias("k"), F.lit(-2).cast("long").alias("o"), line("session_meta", F.struct(F.when(k % 5 != 0, name).alias("id"), cwd.alias("cwd"), F.lit("1.2").alias("cli_version"))).alias("value")).distinct()
    turn = rows.select(k.alias("k"), F.lit(-1).cast("long").alias("o"), line("turn_context", F.struct(F.concat(F.lit("m"), k % 4).alias("model"), F.when(k % 2 == 0, "high").alias("effort"))).alias("value")).distinct()
    said = rows.where("role = 'user'").select(k.alias("k"), (n * 10).alias("o"), line("event_msg", F.struct(F.lit("user_message").alias("type"), F.col("text").alias("message"))).alias("value"))
    done = rows.where("role <> 'user'")
    shell = n % 3 != 0
    args = F.to_json(F.struct(F.concat(F.lit("cat /data/c"), k, F.lit("/f"), n % 4, F.lit(".txt > /tmp/o")).alias("command"), F.concat(F.lit("/w/"), k).alias("workdir")))
    call = F.struct(F.lit("function_call").alias("type"), F.when(shell, "shell_command").otherwise(F.concat(F.lit("tool"), n % 2)).alias("name"), args.alias("arguments"), F.lit("same").alias("call_id"))
    made = done.select(k.alias("k"), (n * 10 + 1).alias("o"), line("response_item", call).alias("value"))
    out = F.struct(F.lit("function_call_output").alias("type"), F.lit("same").alias("call_id"), F.concat(F.lit("wrote /out/r"), n, F.lit(".log and /x...")).alias("output"))
    got = done.select(k.alias("k"), (n * 10 + 2).alias("o"), line("response_item", out).alias("value"))
    broken = done.select(k.alias("k"), (n * 10 + 3).alias("o"), F.lit('{"type": "response_item", "payload"').alias("value"))
    log = meta.unionByName(turn).unionByName(said).unionByName(made).unionByName(got).unionByName(broken)
    log.repartition(4, "k").sortWithinPartitions("k", "o").select("value", F.concat(F.lit("log-"), "k").alias("f")).write.partitionBy("f").text(f"{root}/logs")


_CONV = """u AS (SELECT DISTINCT conv_id AS k FROM conversations), l AS (SELECT k, CASE WHEN k % 5 <> 0 THEN 'session-' || k END AS s, '/srv/' || CASE WHEN k % 2 = 0 THEN 'projects' ELSE 'work' END || '/p' || (k % 7) || '/src' AS cwd FROM u WHERE k % 3 <> 0),
d AS (SELECT *, turn AS n, s FROM conversations JOIN l ON k = conv_id WHERE s IS NOT NULL AND role <> 'user')"""


@query(f"""WITH {_CONV},
paths AS (SELECT s, '/data/c' || k || '/f' || (n % 4) || '.txt' AS value, n * 10 + 1 AS o, 0 AS i FROM d UNION ALL SELECT s, '/tmp/o', n * 10 + 1, 1 FROM d UNION ALL SELECT s, '/w/' || k, n * 10 + 1, 2 FROM d UNION ALL SELECT s, '/out/r' || n || '.log', n * 10 + 2, 0 FROM d),
cmd AS (SELECT s, 'cat /data/c' || k || '/f' || (n % 4) || '.txt > /tmp/o' AS value, n AS o FROM d WHERE n % 3 <> 0),
tool AS (SELECT s, 'tool' || (n % 2) AS value, n AS o FROM d WHERE n % 3 = 0)
SELECT s AS subject, 'codex_session_project' AS predicate, CASE WHEN k % 2 = 0 THEN 'p' || (k % 7) || '/src' ELSE 'src' END AS value, 'state' AS kind, CAST(1 AS DOUBLE) AS confidence FROM l WHERE s IS NOT NULL UNION ALL
SELECT s, 'codex_cwd', cwd, 'state', 1.0 FROM l WHERE s IS NOT NULL UNION ALL SELECT s, 'codex_cli_version', '1.2', 'state', 1.0 FROM l WHERE s IS NOT NULL UNION ALL
SELECT s, 'codex_model', 'm' || (k % 4) || ' (effort: ' || CASE WHEN k % 2 = 0 THEN 'high' ELSE 'default' END || ')', 'state', 1.0 FROM l WHERE s IS NOT NULL UNION ALL
SELECT s, 'ran_command', value, 'event', 1.0 FROM (SELECT s, value, min(o) AS o FROM cmd GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY o) <= 30 UNION ALL
SELECT s, 'used_tool', value, 'event', 1.0 FROM (SELECT s, value, min(o) AS o FROM tool GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY o) <= 20 UNION ALL
SELECT s, 'touched_file', value, 'event', 0.9 FROM (SELECT s, value, min([o, i]) AS o FROM paths GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY s ORDER BY o) <= 50 UNION ALL
SELECT 'session-' || conv_id, 'codex_prompt', substr(text, 1, 500), 'event', 1.0 FROM conversations WHERE role = 'user' AND (conv_id % 3 = 0 OR conv_id % 5 = 0) AND text <> ''""")
def s06_session_facts(t: Tables) -> DataFrame:
    """Facts of logs and prompts; a log without an id is named by its file, which the comparison leaves out."""
    root = scratch(t.spark)
    agent_files(t, root)
    facts, _ = agent_exports.sessions(agent_exports.lines(t.spark, f"{root}/logs"), agent_exports.prompt_history(agent_exports.lines(t.spark, f"{root}/history")))
    return facts.where(~F.col("subject").startswith("part-")).select("subject", "predicate", "value", "kind", "confidence")


@query(f"""WITH {_CONV}, p AS (SELECT s, string_agg('  > ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS prompts, count(*) AS n_user FROM conversations JOIN l ON k = conv_id WHERE role = 'user' AND text <> '' GROUP BY 1),
a AS (SELECT s, count(*) AS calls, count(*) FILTER (n % 3 <> 0) AS cmds, count(DISTINCT n % 4) + 2 + count(DISTINCT n) AS files FROM d GROUP BY 1), w AS (SELECT s, count(*) + 2 AS n_lines FROM (SELECT s, unnest(CASE WHEN role = 'user' THEN [1] ELSE [1, 2] END) FROM conversations JOIN l ON k = conv_id) GROUP BY 1)
SELECT s AS session, 'codex_session:' || substr(s, 1, 8) AS label, concat('CWD: ', cwd, chr(10), 'Model: m', k % 4, chr(10), 'Tool calls: ', coalesce(calls, 0), chr(10), 'Commands: ', coalesce(cmds, 0), chr(10), 'Files: ', coalesce(files, 0), chr(10), chr(10), 'User prompts:', CASE WHEN prompts IS NOT NULL THEN chr(10) || prompts ELSE '' END) AS content, n_lines AS line_end
FROM l LEFT JOIN p USING (s) LEFT JOIN a USING (s) JOIN w USING (s) WHERE s IS NOT NULL UNION ALL
SELECT 'session-' || conv_id, 'codex_history:' || substr('session-' || conv_id, 1, 8), string_agg('[' || strftime(make_timestamp((1700000000 + conv_id * 1000 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') || '] ' || text, chr(10) ORDER BY turn), count(*) FROM conversations WHERE role = 'user' AND (conv_id % 3 = 0 OR conv_id % 5 = 0) GROUP BY conv_id""")
def s06_session_segments(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    agent_files(t, root)
    _, segments = agent_exports.sessions(agent_exports.lines(t.spark, f"{root}/logs"), agent_exports.prompt_history(agent_exports.lines(t.spark, f"{root}/history")))
    return segments.where(~F.col("session").startswith("part-"))


REL_PATHS = ("notes/{}.md", "./notes//x/../{}.md", "../notes/{}.md", "/notes/{}.md", "notes/../../secret/{}.md", "", "notes/missing-{}.md", "notes/../notes/{}.md")


def shared_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as documents with friendly and hostile paths, files for all of them, suppliers as instances."""
    k = F.col("p_partkey")
    path = F.get(F.array(*[F.concat(F.lit(p.split("{}")[0]), k, F.lit(p.split("{}")[1])) if "{}" in p else F.lit(p) for p in REL_PATHS]), (k % len(REL_PATHS)).cast("int"))
    kinds = F.get(F.array(*map(F.lit, ("decision", "workflow", "gotcha", "other"))), (k % 4).cast("int"))
    documents = t.part.select(
        F.concat(F.lit("doc-"), k).alias("id"), F.concat(F.lit("d"), k % 3).alias("domain"), kinds.alias("kind"), F.col("p_name").alias("title"), F.when(k % 3 != 0, F.concat(F.lit("summary of "), "p_name")).alias("summary"),
        F.array(F.lit("indexed"), F.col("p_brand")).alias("tags"), F.array(F.concat(F.lit("/opt/"), k), F.lit("relative")).alias("paths"), F.array(F.col("p_brand")).alias("entities"), F.lit(None).cast("string").alias("updated_at"), path.alias("rel_path"), F.when(k % 2 == 0, 0.5).alias("confidence"),
    )
    head = F.concat(F.lit("---\nsummary: front "), k, F.lit("\nconfidence: 0.75\ntags: [One, 'Two']\nentities:\n  - Alpha\n  - Server-A\nsource_session_id: inst-"), k % 50, F.lit("\n---\n\nBody "), k, F.lit("\n"))
    files = t.part.where(k % 8 != 6).select(F.concat(F.lit("notes/"), k, F.lit(".md")).alias("path"), F.when(k % 8 == 7, F.concat(F.lit("  plain "), k)).otherwise(head).alias("text"))
    s = F.col("s_suppkey")
    instances = t.supplier.select(F.concat(F.lit("inst-"), s).alias("session_id"), F.concat(F.lit("/home/u/"), s).alias("cwd"), F.when(s % 2 == 0, F.concat(F.lit("/srv/tools/kit"), s, F.lit("/lib"))).alias("git_root"), F.array(F.concat(F.lit("d"), s % 3)).alias("domain_snapshot"))
    return documents, files, instances


_SHARED = """d AS (SELECT p_partkey AS k, 'doc-' || p_partkey AS id, p_partkey % 8 IN (0, 1) AS full_, p_partkey % 8 = 7 AS plain, p_name, p_brand, ['decision', 'workflow', 'gotcha', 'other'][p_partkey % 4 + 1] AS kind FROM part),
i AS (SELECT 'inst-' || s_suppkey AS s, '/home/u/' || s_suppkey AS cwd, CASE WHEN s_suppkey % 2 = 0 THEN '/srv/tools/kit' || s_suppkey || '/lib' END AS root, s_suppkey AS n FROM supplier)"""


@query(f"""WITH {_SHARED}
SELECT id AS subject, 'references_entity' AS predicate, unnest(CASE WHEN full_ THEN ['alpha', 'server-a'] ELSE [lower(p_brand)] END) AS value, 'state' AS kind, 'deterministic' AS assertion, CAST(0.95 AS DOUBLE) AS confidence FROM d UNION ALL
SELECT id, 'references_path', '/opt/' || k, 'state', 'deterministic', 1.0 FROM d UNION ALL SELECT id, 'codex_memory_kind', kind, 'state', 'deterministic', 1.0 FROM d UNION ALL SELECT id, 'codex_domain', 'd' || (k % 3), 'state', 'deterministic', 1.0 FROM d UNION ALL
SELECT id, 'codex_' || kind, CASE WHEN k % 3 <> 0 THEN 'summary of ' || p_name WHEN full_ THEN 'front ' || k ELSE p_name END, CASE kind WHEN 'decision' THEN 'decision' WHEN 'gotcha' THEN 'lesson' ELSE 'state' END, 'human_curated', CASE WHEN k % 2 = 0 THEN 0.5 WHEN full_ THEN 0.75 ELSE 0.9 END FROM d UNION ALL
SELECT id, 'source_session', 'inst-' || (k % 50), 'state', 'deterministic', 1.0 FROM d WHERE full_ UNION ALL
SELECT id, 'source_project', CASE WHEN root IS NULL THEN CAST(n AS VARCHAR) ELSE 'kit' || n || '/lib' END, 'state', 'deterministic', 1.0 FROM d JOIN i ON s = 'inst-' || (k % 50) WHERE full_ UNION ALL
SELECT id, 'tagged', unnest(CASE WHEN full_ THEN ['One', 'Two'] ELSE ['indexed', p_brand] END), 'state', 'deterministic', 1.0 FROM d UNION ALL
SELECT s, 'codex_instance_cwd', cwd, 'state', 'deterministic', 1.0 FROM i UNION ALL SELECT s, 'codex_instance_git_root', root, 'state', 'deterministic', 1.0 FROM i WHERE root IS NOT NULL UNION ALL SELECT s, 'codex_instance_domain', 'd' || (n % 3), 'state', 'deterministic', 1.0 FROM i""")
def s07_shared_memory(t: Tables) -> DataFrame:
    return agent_exports.shared_memory(*shared_tables(t))[0]


@query(f"""WITH {_SHARED} SELECT id, ['../notes/' || k || '.md', '/notes/' || k || '.md', 'notes/../../secret/' || k || '.md', '', 'notes/missing-' || k || '.md'][k % 8 - 1] AS rel_path, ['outside the folder', 'absolute path', 'outside the folder', 'empty path', 'missing file'][k % 8 - 1] AS reason FROM d WHERE k % 8 BETWEEN 2 AND 6""")
def s07_rejected_paths(t: Tables) -> DataFrame:
    return agent_exports.shared_memory(*shared_tables(t))[2]


@query(f"""WITH {_SHARED} SELECT id, p_name AS label, concat('Kind: ', kind, chr(10), 'Domain: d', k % 3, chr(10), 'Title: ', p_name, chr(10), 'Summary: ', CASE WHEN k % 3 <> 0 THEN 'summary of ' || p_name ELSE 'N/A' END, chr(10), 'Confidence: ', CASE WHEN k % 2 = 0 THEN '0.5' ELSE '' END, chr(10), chr(10),
CASE WHEN full_ THEN 'Body ' || k WHEN plain THEN 'plain ' || k ELSE concat('[Index-only: ', CASE WHEN k % 3 <> 0 THEN 'summary of ' || p_name ELSE '' END, ']') END) AS content FROM d""")
def s07_segments(t: Tables) -> DataFrame:
    return agent_exports.shared_memory(*shared_tables(t))[1]


# ------------------------------------------------------------------ memories written by an assistant


def auto_files(t: Tables) -> DataFrame:
    """Documents as memory files, most of them with front matter, and an index file."""
    i = F.col("doc_id")
    name = F.concat(F.get(F.array(*map(F.lit, ("feedback_", "playbook_", "misc "))), (i % 3).cast("int")), i, F.when(i % 10 == 9, ".txt").otherwise(".md"))
    head = F.concat(F.lit("---\nname: Name "), i, F.when(i % 2 == 0, F.lit("\ntype: project")).otherwise(""), F.lit("\ndescription: about "), i, F.lit("\noriginSessionId: s"), i % 7, F.lit("\ntags: [a, b]\n---\n"))
    body = F.concat(F.lit("body of "), i)
    return t.documents.select(F.concat(F.lit("memory/"), name).alias("path"), F.when(i % 4 == 3, body).otherwise(F.concat(head, body)).alias("text")).unionByName(t.region.limit(1).select(F.lit("memory/MEMORY.md").alias("path"), F.lit("index").alias("text")))


@query("""WITH d AS (SELECT doc_id AS i, 'pai_auto_memory:' || ['feedback_', 'playbook_', 'misc_'][doc_id % 3 + 1] || doc_id AS k, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 3 THEN 'project' ELSE ['feedback', 'playbook', 'auto'][doc_id % 3 + 1] END AS t, doc_id % 4 <> 3 AS h FROM documents WHERE doc_id % 10 <> 9)
SELECT k AS subject, 'pai_auto_memory_type' AS predicate, t AS value, 'state' AS kind, CAST(1.0 AS DOUBLE) AS confidence FROM d UNION ALL SELECT k, 'pai_auto_memory_content', 'body of ' || i, CASE t WHEN 'feedback' THEN 'constraint' WHEN 'playbook' THEN 'remediation' ELSE 'state' END, 0.9 FROM d UNION ALL
SELECT k, 'description', 'about ' || i, 'state', 0.9 FROM d WHERE h UNION ALL SELECT k, 'origin_session', 's' || (i % 7), 'state', 1.0 FROM d WHERE h UNION ALL SELECT k, 'tagged', unnest(['a', 'b']), 'state', 1.0 FROM d WHERE h""")
def s15_auto_memories(t: Tables) -> DataFrame:
    return agent_exports.auto_memories(auto_files(t))[0].select("subject", "predicate", "value", "kind", "confidence")


# ------------------------------------------------------------------ embedding


_WORD = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, md5(unnest({_WORD})) AS h FROM documents), b AS (SELECT doc_id, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 384 AS b, sum(CASE WHEN CAST('0x' || substr(h, 5, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2),
s AS (SELECT doc_id, count(*) FILTER (v <> 0) AS used, max(v) / sqrt(sum(v * v)) AS top FROM b GROUP BY 1) SELECT doc_id, coalesce(used, 0) AS used, round(greatest(coalesce(top, 0), 0), 5) AS top FROM documents LEFT JOIN s USING (doc_id)""")
def s19_hash_vectors(t: Tables) -> DataFrame:
    """Every document embedded in batches by the encoder without a model: places in use and the greatest value of its vector."""
    d = embedding.embed(t.documents.select("doc_id", "text"), "text", embedding.hash_encoder(), element=T.DoubleType())
    return d.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used"), F.round(F.greatest(F.array_max("embedding"), F.lit(0.0)).cast("double"), 5).alias("top"))


def embedding_tables(t: Tables) -> dict[str, DataFrame]:
    """Documents as segments, orders and their lines as facts and evidence, parts as procedures, pages as media, customers as regions; some have vectors."""
    tenant, text_ = F.lit("default").alias("tenant"), lambda c: F.col(c).cast("string")
    none, made = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    ids = {c: F.lit(None).cast("string").alias(c) for c in ("segment_id", "fact_id", "procedure_id", "media_id", "region_id")}
    has = lambda d, role, key, c: d.select(F.lit(role).alias("role"), *[text_(key).alias(c) if k == c else v for k, v in ids.items()])
    index = has(t.documents.where("doc_id % 2 = 0"), "text", "doc_id", "segment_id").unionByName(has(t.orders.where("o_orderkey % 5 <> 0"), "evidence", "o_orderkey", "fact_id")).unionByName(has(t.customer.where("c_custkey % 3 = 0"), "visual_ocr", "c_custkey", "region_id"))
    return {
        "segment": t.documents.select(tenant, text_("doc_id").alias("segment_id"), F.substring("text", 1, 9000).alias("content"), made.alias("created_at")),
        "fact": t.orders.select(tenant, text_("o_orderkey").alias("fact_id"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object_value")),
        "fact_evidence": t.lineitem.where("l_linenumber <= 2").select(text_("l_orderkey").alias("fact_id"), F.when(F.col("l_linenumber") == 1, F.concat(F.lit("password="), "l_partkey", F.lit("-longsecret"))).alias("excerpt"), made.alias("created_at")),
        "procedure": t.part.select(tenant, text_("p_partkey").alias("procedure_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("summary"), F.when(F.col("p_partkey") % 4 == 0, "retired").alias("lifecycle_state"), made.alias("updated_at")),
        "media_artifact": t.pages.select(tenant, text_("page_id").alias("media_id"), none.alias("caption"), F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("title"), F.col("url"), F.lit("alt_text"), F.lit("alt"))).alias("media_meta"), made.alias("created_at")),
        "visual_region": t.customer.select(tenant, text_("c_custkey").alias("region_id"), text_("c_nationkey").alias("media_id"), F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name")).alias("label"), none.alias("ocr_text"), F.create_map(F.lit("text"), F.col("c_mktsegment")).alias("region_meta"), made.alias("created_at")),
        "embedding_index": index,
    }


@query("""SELECT 'text' AS role, CAST(doc_id AS VARCHAR) AS target_id, count(*) AS n, CAST(NULL AS VARCHAR) AS text FROM documents WHERE doc_id % 2 <> 0 AND trim(text) <> '' GROUP BY 1, 2 UNION ALL
SELECT 'evidence', CAST(l_orderkey AS VARCHAR), count(*), max(CASE WHEN l_linenumber = 1 THEN '[REDACTED:password]' ELSE o_orderpriority || ' ' || o_orderstatus END) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <= 2 AND l_orderkey % 5 = 0 GROUP BY 1, 2 UNION ALL
SELECT 'procedure', CAST(p_partkey AS VARCHAR), 1, trim(p_name || CASE WHEN p_size > 10 THEN ' ' || p_type ELSE '' END) FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'media_caption', CAST(page_id AS VARCHAR), 1, url FROM pages WHERE page_id % 2 = 0 UNION ALL
SELECT 'visual_ocr', CAST(c_custkey AS VARCHAR), 1, c_mktsegment FROM customer JOIN pages ON page_id = c_nationkey WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'visual_caption', CAST(c_custkey AS VARCHAR), 1, c_name FROM customer JOIN pages ON page_id = c_nationkey WHERE c_custkey % 7 <> 0""")
def s21_role_candidates(t: Tables) -> DataFrame:
    """What is still to be embedded, for six roles; texts of segments are left to the tests."""
    d = embedding.candidates(embedding_tables(t)).withColumn("text", F.when(F.col("role") != "text", F.col("text")))
    return d.groupBy("role", "target_id").agg(F.count("*").alias("n"), F.max("text").alias("text"))


@query(r"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'use [REDACTED:password] now' WHEN 1 THEN '[REDACTED:bearer_token]' WHEN 2 THEN 'at [REDACTED:connection_string] end' WHEN 3 THEN '[REDACTED:vendor_key]!' WHEN 4 THEN 'key [REDACTED:aws_access_key].' ELSE event_type || ' ' || CAST(event_id AS VARCHAR) END AS text FROM events""")
def t12_redacted_secrets(t: Tables) -> DataFrame:
    """Events as texts with secrets of five kinds, or none."""
    i = F.col("event_id")
    number = F.lpad(i.cast("string"), 12, "0")
    kinds = [F.concat(F.lit("use password: pw"), number, F.lit(" now")), F.concat(F.lit("Authorization: Bearer abcdefghijklmnop"), number), F.concat(F.lit("at redis://h/"), number, F.lit(" end")), F.concat(F.lit("ghp_abcdef"), number, F.lit("!")), F.concat(F.lit("key AKIA0000"), number, F.lit("."))]
    text = F.concat_ws(" ", "event_type", i.cast("string"))
    for k, x in enumerate(kinds):
        text = F.when(i % 6 == k, x).otherwise(text)
    return t.events.select("event_id", X.redact_secrets(text).alias("text"))


# ------------------------------------------------------------------ what is there


@query("""WITH m AS (SELECT doc_id, doc_id % 2 = 0 AS published, TIMESTAMP '2024-01-20' - to_days(CAST(doc_id % 400 AS INTEGER)) AS seen FROM documents) SELECT 'rows:memory' AS name, count(*) AS n FROM m UNION ALL SELECT 'rows:fact', count(*) FROM orders UNION ALL
SELECT 'rows:segment', count(*) FROM conversations UNION ALL SELECT 'stale memories', count(*) FROM m WHERE published AND seen < TIMESTAMP '2024-01-20' - INTERVAL 6 MONTH UNION ALL SELECT 'milestones', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def a13_status(t: Tables) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp")
    memory = t.documents.select(F.when(F.col("doc_id") % 2 == 0, "published").otherwise("draft").alias("lifecycle_state"), (now - F.make_dt_interval(days=(F.col("doc_id") % 400).cast("int"))).alias("last_supported_at"))
    return upkeep.status({"memory": memory, "fact": t.orders.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")), "segment": t.conversations}, now)


@query("""WITH f AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate ELSE o_orderdate END AS a, CASE WHEN l_linenumber % 3 = 0 AND o_orderstatus <> 'P' THEN 1 END AS b FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) SELECT count(a) AS with_start, count(b) AS with_end, count(*) AS facts FROM f""")
def a29_time_coverage(t: Tables) -> DataFrame:
    """How many facts have times after a backfill in which no value is superseded."""
    n = F.col("l_linenumber")
    facts = t.lineitem.select(F.col("l_orderkey").alias("episode_id"), F.concat_ws("-", "l_orderkey", n, "l_partkey").alias("subject_entity_id"), F.lit("p").alias("predicate"), F.when(n % 3 == 0, "cause").otherwise("state").alias("fact_kind"), F.lit("v").alias("object_value"), F.when(n % 2 == 0, F.col("l_shipdate")).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit("active").alias("current_status"))
    episodes = t.orders.select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").alias("start_at"), F.col("o_orderdate").alias("end_at"), F.when(F.col("o_orderstatus") == "P", "open").otherwise("closed").alias("outcome"))
    return upkeep.time_coverage(temporal.backfill(facts, episodes))


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderkey % 10 = 0 AS broken FROM orders WHERE o_orderkey % 2 = 0), g AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1)
SELECT id AS artifact_id, CASE WHEN broken THEN 'failed' WHEN n > 0 AND n = bad THEN 'rejected' ELSE 'extracted' END AS state, CASE WHEN broken THEN 'no such file' WHEN n > 0 AND n = bad THEN 'flag R' END AS reason FROM a LEFT JOIN g USING (id)""")
def s24_extraction_outcomes(t: Tables) -> DataFrame:
    """Orders as artifacts, lines as their facts: artifacts that failed or were rejected stand beside the others."""
    extracted = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("artifact_id"), F.when(F.col("o_orderkey") % 10 == 0, "no such file").alias("error"))
    gated = t.lineitem.select(F.col("l_orderkey").alias("artifact_id"), F.when(F.col("l_returnflag") == "R", "flag R").alias("reject_reason"))
    return upkeep.outcomes(extracted, gated)
