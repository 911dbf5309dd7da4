"""Readers of source exports into extraction records.

Each reader gives rows (source_type, source_key, title, body, facts array<struct<subject,predicate,value,kind,confidence>>, ts).
Parsing is regular expressions and array functions inside the JVM; files are read by Spark, so any store works.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "struct<subject:string,predicate:string,value:string,kind:string,confidence:double>"
FACTS = f"array<{FACT}>"


def fact(subject: Column, predicate: str | Column, value: Column, kind: str = "state", confidence: float = 1.0) -> Column:
    p = F.lit(predicate) if isinstance(predicate, str) else predicate
    return F.when(value.isNotNull() & (value.cast("string") != ""), F.struct(subject.cast("string").alias("subject"), p.alias("predicate"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")))


def facts(*items: Column) -> Column:
    return F.array_compact(F.array(*items)).cast(FACTS)


def record(df: DataFrame, source_type: str, key: Column, title: Column, body: Column, found: Column, ts: Column | None = None) -> DataFrame:
    return df.select(F.lit(source_type).alias("source_type"), F.concat(F.lit(source_type + ":"), key.cast("string")).alias("source_key"), title.cast("string").alias("title"), body.cast("string").alias("body"), found.alias("facts"), (ts if ts is not None else F.lit(None)).cast("timestamp").alias("ts"))


def read_json_items(spark: SparkSession, path: str, schema: str, wrappers: Sequence[str] = ("data", "tasks", "commits", "items")) -> DataFrame:
    """JSON documents or lines: wrapped lists are unwrapped, single objects (on any number of lines) are one row.

    A line that is no JSON fails with its file and number.
    """
    row = T._parse_datatype_string(schema)
    many = T.ArrayType(row)
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    lists = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{w}"), many) for w in wrappers], F.when(F.trim("value").startswith("["), F.from_json("value", many)))
    numbered = F.transform(F.split("value", r"\r?\n"), lambda x, i: F.struct((i + 1).alias("n"), F.trim(x).alias("x")))
    bad = lambda l: F.raise_error(F.concat("file", F.lit(": line "), l["n"].cast("string"), F.lit(" is no JSON"))).cast(row)
    lines = F.transform(F.filter(numbered, lambda l: l["x"] != ""), lambda l: F.when(F.try_parse_json(l["x"]).isNull(), bad(l)).otherwise(F.from_json(l["x"], row)))
    # an object on several lines: its first line is no JSON by itself
    single = F.try_parse_json(F.substring_index(F.ltrim("value"), "\n", 1)).isNull() & F.try_parse_json("value").isNotNull()
    whole = text.withColumn("items", F.when(lists.isNotNull(), lists).when(single, F.array(F.from_json("value", row))).otherwise(lines))
    return whole.select("file", F.posexplode("items").alias("line", "item")).select("file", F.col("line") + 1, "item.*")


def front_matter(text: Column) -> Column:
    """Key -> value of the leading ``---`` block; list values stay as written."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), r"^[\"']|[\"']$", ""))))


def inline_metadata(text: Column) -> Column:
    """``**Key:** value`` pairs of a note, keys in lower snake case; the first of a key counts."""
    keys = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*]?\s*\*\*([^*:]+):?\*\*:?\s*(.+)$"), F.lit(1)), lambda k: F.regexp_replace(F.lower(F.trim(k)), r"[^a-z0-9]+", "_"))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*]?\s*\*\*([^*:]+):?\*\*:?\s*(.+)$"), F.lit(2)), lambda v: F.trim(v))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1)
    return F.map_from_entries(first)


STATUSES = {"open": "open", "investigating": "open", "resolved": "resolved", "fixed": "resolved", "done": "resolved", "closed": "closed", "monitoring": "monitoring"}


def incidents(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Incident notes: front matter before inline metadata; status, root cause, fix, tags and involved devices as facts."""
    t = F.col(text)
    d = notes.withColumns({"_front": front_matter(t), "_inline": inline_metadata(t)})
    get = lambda k: F.coalesce(F.try_element_at(F.col("_front"), F.lit(k)), F.try_element_at(F.col("_inline"), F.lit(k)))
    name = F.regexp_extract(F.col(path), r"([^/]+)/[^/]*$", 1)
    status = F.coalesce(*[F.when(F.lower(get("status")) == k, F.lit(v)) for k, v in STATUSES.items()], F.lower(get("status")))
    items = lambda k: F.transform(F.split(F.regexp_replace(F.coalesce(get(k), F.lit("")), r"[\[\]\"']", ""), r"\s*,\s*"), lambda x: fact(name, k, F.trim(x), "relation"))
    found = F.concat(facts(fact(name, "status", status), fact(name, "severity", F.lower(get("severity"))), fact(name, "root_cause", get("root_cause"), "cause"), fact(name, "fix_summary", get("fix_summary"), "remediation")), F.array_compact(items("tags")).cast(FACTS), F.array_compact(items("devices")).cast(FACTS))
    title = F.coalesce(F.nullif(F.regexp_extract(t, r"(?m)^#\s+(.+)$", 1), F.lit("")), name)
    return record(d, "incident_note", name, title, t, found, F.try_to_timestamp(get("opened")))


def chat_digest(summaries: DataFrame, channels: DataFrame, since: Column | None = None) -> DataFrame:
    """Digest rows with their channel; items ``**[TAG] Title** - detail`` become facts, else the summary is one."""
    d = summaries.join(channels.select(F.col("id").alias("channelId"), F.col("name").alias("channel")), "channelId")
    if since is not None:
        d = d.where(F.col("createdAt") > since)
    pattern = r"\*\*\[([A-Z_ ]+)\]\s*([^*]+)\*\*\s*(?:[—–-]\s*)?([^\n]*)"
    part = lambda i: F.regexp_extract_all("summary", F.lit(pattern), F.lit(i))
    subject = F.concat(F.lit("chat:"), "channel")
    tagged = F.transform(F.arrays_zip(part(1).alias("t"), part(2).alias("h"), part(3).alias("d")), lambda x: F.struct(subject.alias("subject"), F.lower(F.trim(x["t"])).alias("predicate"), F.concat_ws(": ", F.trim(x["h"]), F.trim(x["d"])).alias("value"), F.lit("event").alias("kind"), F.lit(0.8).alias("confidence")))
    found = F.when(F.size(tagged) > 0, tagged.cast(FACTS)).otherwise(facts(fact(subject, "summary", F.col("summary"), "event", 0.6)))
    return record(d, "chat_digest", F.col("id"), F.concat_ws(" ", F.col("channel"), F.col("windowStart").cast("string")), F.col("summary"), found, F.timestamp_millis("windowStart"))


def label_map(text: Column | str) -> Column:
    """``{a="x", b=y}`` or ``a=x, b=y`` as a map with lower-case keys."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^[^{]*\{|\}[^}]*$", ""), "[\"']", "")
    pairs = F.filter(F.split(inner, r"\s*,\s*"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))), F.trim(F.regexp_replace(x, r"^[^=]*=", ""))))))


def alerts(rows: DataFrame) -> DataFrame:
    """Alert annotations (id, name, time in ms, text, new_state, labels map): fired state, severity, service."""
    labels = F.col("labels")
    service = F.coalesce(F.try_element_at(labels, F.lit("service")), F.try_element_at(labels, F.lit("job")), F.try_element_at(labels, F.lit("instance")))
    severity = F.coalesce(F.lower(F.try_element_at(labels, F.lit("severity"))), F.when(F.lower("new_state").isin("alerting", "firing"), "warning").otherwise("info"))
    found = facts(fact(F.col("name"), "alert_fired", F.col("new_state"), "event"), fact(F.col("name"), "severity", severity), fact(F.col("name"), "tagged_service", service, "relation"))
    return record(rows, "monitoring_alert", F.col("id"), F.col("name"), F.col("text"), found, F.timestamp_millis("time"))


def tasks(rows: DataFrame) -> DataFrame:
    """Task export rows (gid, name, notes, completed, assignee, projects array, tags array, due_on)."""
    s = F.concat(F.lit("task:"), F.col("gid"))
    many = lambda c, p: F.coalesce(F.array_compact(F.transform(F.col(c), lambda x: fact(s, p, x, "relation"))).cast(FACTS), F.array().cast(FACTS))
    found = F.concat(facts(fact(s, "title", F.col("name")), fact(s, "completed", F.col("completed").cast("string")), fact(s, "notes", F.col("notes")), fact(s, "assignee", F.col("assignee"), "relation"), fact(s, "due_on", F.col("due_on"))), many("projects", "project"), many("tags", "tag"))
    return record(rows, "task_export", F.col("gid"), F.col("name"), F.col("notes"), found)


def commits_log(spark: SparkSession, path: str) -> DataFrame:
    """A commit log with 0x1e between commits and 0x1f between sha, author, date, subject, body; bad shas are dropped."""
    parts = F.split("value", "\x1f")
    d = spark.read.option("lineSep", "\x1e").text(path).select(*[F.trim(F.get(parts, F.lit(i))).alias(c) for i, c in enumerate(("sha", "author", "date", "subject", "message"))])
    return d.where(F.col("sha").rlike("(?i)^[0-9a-f]{7,64}$"))


def commits(rows: DataFrame, repo: str) -> DataFrame:
    s = F.concat(F.lit(f"commit:{repo}:"), F.lower("sha"))
    found = facts(fact(s, "repository", F.lit(repo), "relation"), fact(s, "subject", F.col("subject")), fact(s, "author", F.col("author"), "relation"), fact(s, "message", F.col("message")))
    return record(rows, "commit", F.concat(F.lit(f"{repo}:"), F.lower("sha")), F.col("subject"), F.col("message"), found, F.try_to_timestamp("date"))


def personal_notes(notes: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Personal memory notes: type from the file name's prefix, ``- **key**: value`` lines as facts, #tags."""
    t = F.col(text)
    name = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.md)?$", 1)
    keys, values = (F.regexp_extract_all(t, F.lit(r"(?m)^\s*[-*]\s+\*\*([^*]+)\*\*:?\s*(.+)$"), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: F.struct(name.alias("subject"), F.regexp_replace(F.lower(F.trim(F.rtrim(F.regexp_replace(p["k"], ":$", "")))), r"[^a-z0-9]+", "_").alias("predicate"), F.trim(p["v"]).alias("value"), F.lit("state").alias("kind"), F.lit(1.0).alias("confidence"))).cast(FACTS)
    tags = F.transform(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?:^|\s)#([A-Za-z][\w-]*)"), F.lit(1))), lambda x: fact(name, "tag", F.lower(x), "relation")).cast(FACTS)
    kind = F.regexp_extract(name, r"^([a-z]+)[_-]", 1)
    return record(notes, "personal_note", name, F.coalesce(F.nullif(F.regexp_extract(t, r"(?m)^#\s+(.+)$", 1), F.lit("")), name), t, F.concat(facts(fact(name, "note_type", kind)), pairs, tags))


def session_lines(lines: DataFrame) -> DataFrame:
    """Agent session lines (session_id, n, role, content, tool_name, tool_input): files, commands and errors per session."""
    cmd = F.when(F.col("tool_name").isin("Bash", "shell"), F.get_json_object("tool_input", "$.command"))
    file = F.get_json_object("tool_input", "$.file_path")
    err = F.when(F.lower("content").rlike(r"\b(error|exception|failed)\b"), F.substring("content", 1, 300))
    keep = lambda c, n: F.slice(F.transform(F.array_sort(F.collect_set(F.struct("n", c.alias("v")))), lambda x: x["v"]), 1, n)
    once = lambda c: F.array_compact(F.array_distinct(c))
    return lines.groupBy("session_id").agg(
        F.count("*").alias("n_lines"),
        F.array_sort(F.array_compact(F.collect_set(file))).alias("files"),
        F.slice(once(F.transform(F.array_sort(F.collect_list(F.struct("n", cmd.alias("v")))), lambda x: x["v"])), 1, 20).alias("commands"),
        F.slice(once(F.transform(F.array_sort(F.collect_list(F.struct("n", err.alias("v")))), lambda x: x["v"])), 1, 10).alias("errors"),
    )


def assistant_memories(rows: DataFrame) -> DataFrame:
    """Assistant memory export (id, content, node_type, created_at, strength): content of up to 4000 characters as one fact."""
    kind = F.coalesce(*[F.when(F.col("node_type") == k, F.lit(v)) for k, v in {"decision": "decision", "fact": "state", "event": "event", "pattern": "lesson", "concept": "state"}.items()], F.lit("state"))
    s = F.concat(F.lit("memory:"), F.col("id"))
    found = F.array_compact(F.array(F.struct(s.alias("subject"), F.lit("content").alias("predicate"), F.substring("content", 1, 4000).alias("value"), kind.alias("kind"), F.lit(0.7).alias("confidence")), fact(s, "strength", F.col("strength").cast("string")))).cast(FACTS)
    return record(rows, "assistant_memory", F.col("id"), F.substring("content", 1, 80), F.col("content"), found, F.try_to_timestamp("created_at"))


def project_docs(manifest: DataFrame, segments: DataFrame) -> DataFrame:
    """Facts of a document manifest with their segment: the first whose label contains the wanted one (doc_id, predicate, value, segment_label) x (doc_id, ordinal, label)."""
    f = manifest.withColumn("_id", F.sha2(F.concat_ws("|", *manifest.columns), 256))
    met = f.join(segments, "doc_id").where(F.contains(F.lower("label"), F.lower(F.coalesce("segment_label", F.lit("")))))
    first = met.groupBy("_id").agg(F.min("ordinal").alias("segment_ordinal"))
    return f.join(first, "_id", "left").drop("_id")


def media_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, regions) of a manifest with boxes as [x0, y0, x1, y1]; boxes that are not ordered are marked."""
    media = rows.select("artifact_id", "media_type", "sha256", "caption")
    r = rows.select("artifact_id", F.posexplode("regions").alias("ordinal", "r")).select("artifact_id", "ordinal", "r.region_type", "r.label", *[F.get("r.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max"))])
    ok = (F.col("x_min") >= 0) & (F.col("y_min") >= 0) & (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min"))
    return media, r.withColumn("valid_box", F.coalesce(ok, F.lit(False)))


def gates() -> dict[str, dict[str, Column]]:
    """What each kind of source must bring for its facts to be accepted."""
    return {
        "incident_note": {"episode": F.col("episode_id").isNotNull(), "segment": F.size("segment_ids") > 0},
        "agent_session": {"source_key": F.col("source_key").isNotNull()},
        "personal_note": {"scope": F.col("scope_path").isNotNull()},
        "chat_digest": {"channel": F.col("subject").startswith("chat:") | F.col("meta")["channel"].isNotNull()},
        "monitoring_alert": {"service": F.col("meta")["service"].isNotNull(), "severity": F.col("meta")["severity"].isNotNull()},
        "messenger": {"message_id": F.col("meta")["message_id"].isNotNull()},
        "task_export": {"source_key": F.col("source_key").rlike(r"^task_export:[^:\s]+$")},
        "commit": {"source_key": F.col("source_key").rlike(r"(?i)^commit:[^:\s]+:[a-f0-9]{7,64}$")},
        "assistant_memory": {"source_key": F.col("source_key").rlike(r"^assistant_memory:[^:\s]+$"), "segment": F.size("segment_ids") > 0},
        "project_doc": {"source_key": F.col("source_key").rlike(r"^project_doc:[^\s]+$"), "scope": F.col("scope_path").startswith("project:"), "segment": F.size("segment_ids") > 0},
    }


def gate(facts_: DataFrame) -> DataFrame:
    """Facts with ``reject_reason`` (null if accepted): universal checks, then those of the source type."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    reason = F.when(blank("subject"), "blank subject").when(blank("predicate"), "blank predicate").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range")
    for kind, checks in gates().items():
        for name, ok in checks.items():
            reason = reason.when((F.col("source_type") == kind) & ~F.coalesce(ok, F.lit(False)), f"missing {name}")
    return facts_.withColumn("reject_reason", reason)
