"""Exports of a command-line agent: prompt history, session logs and a shared memory folder.

Lines are read by a splittable reader, so one large log is many tasks; ``line_order`` tells their order within a file.
JSON of unknown shape is read as a variant, so a broken line or an argument of another type is a null and no failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import front_matter

#: Caps on the distinct values of a session and on characters, as the export format defines them. Fixed values.
COMMANDS, TOOLS, FILES, PATHS = 30, 20, 50, 20
COMMAND_CHARS, PROMPT_CHARS, CONTENT_CHARS, LABEL_CHARS = 300, 500, 2000, 100
PREFIX = "codex_"
KINDS = {"decision": "decision", "workflow": "state", "mapping": "state", "environment": "state", "preference": "constraint", "gotcha": "lesson"}
PATH = r"""(?:^|\s|["'`])(/[A-Za-z0-9_./-]+(?:\.[A-Za-z0-9_]{1,10})?)"""
FACT_COLUMNS = ["subject", "predicate", "value", "kind", "assertion", "confidence"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_order, value) of the text files below a folder. A block of a file is read by one task from front to back."""
    d = spark.read.option("recursiveFileLookup", "true").text(path)
    return d.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("line_order"), "value")


def _get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def session_log(raw: DataFrame) -> DataFrame:
    """(session, file, line_order, type, p): the lines of session logs; a session is named by its first meta line or by its file."""
    d = raw.withColumn("v", F.try_parse_json("value")).where("v is not null")
    d = d.select("file", "line_order", _get("v", "$.type").alias("type"), _get("v", "$.payload.type").alias("kind"), _get("v", "$.payload", "variant").alias("p"), _get("v", "$.timestamp").alias("at"))
    meta = d.where("type = 'session_meta' and p is not null").groupBy("file").agg(F.min_by("p", "line_order").alias("meta"))
    d = d.join(meta, "file", "left")
    name = F.regexp_extract("file", r"([^/]+?)(?:\.jsonl)?$", 1)
    return d.withColumn("session", F.coalesce(_get("meta", "$.id"), name))


def project(cwd: Column, marks: tuple[str, ...] = ("tools", "projects")) -> Column:
    """What follows the last of the marked folders; from ``vault`` on; else the last folder."""
    parts = F.array_remove(F.split(cwd, "/"), "")
    last = F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), parts), -1), F.lit("unknown"))
    at = F.greatest(*[F.array_position(parts, m) for m in marks], F.lit(0))
    vault = F.array_position(parts, "vault")
    rest = lambda start: F.array_join(F.slice(parts, start.cast("int"), F.greatest(F.size(parts), F.lit(1))), "/")
    return F.when(at > 0, F.coalesce(F.nullif(rest(at + 1), F.lit("")), last)).when(vault > 0, rest(F.greatest(vault, F.lit(1)))).otherwise(last)


def calls(log: DataFrame) -> DataFrame:
    """Calls with their results: the n-th call of an id in a file goes with the n-th result of that id."""
    by_id = Window.partitionBy("file", "call_id").orderBy("line_order")
    c = log.where("type = 'response_item' and kind = 'function_call'").select(
        "session", "file", "line_order", F.coalesce(_get("p", "$.call_id"), F.lit("")).alias("call_id"), F.coalesce(F.nullif(_get("p", "$.name"), F.lit("")), F.lit("unknown")).alias("name"), F.try_parse_json(F.coalesce(_get("p", "$.arguments"), F.lit("{}"))).alias("args"))
    r = log.where("kind = 'function_call_output'").select("file", "line_order", F.coalesce(_get("p", "$.call_id"), F.lit("")).alias("call_id"), _get("p", "$.output").alias("output"))
    c = c.withColumn("n", F.row_number().over(by_id))
    r = r.withColumn("n", F.row_number().over(by_id)).drop("line_order")
    return c.join(r, ["file", "call_id", "n"], "left").drop("n")


def _facts(d: DataFrame, subject: Column, predicate: str | Column, value: Column, kind: str | Column = "state", assertion: str = "deterministic", confidence: float | Column = 1.0) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = d.select(subject.alias("subject"), lit(predicate).alias("predicate"), value.cast("string").alias("value"), lit(kind).alias("kind"), F.lit(assertion).alias("assertion"), lit(confidence).cast("double").alias("confidence"))
    return out.where("value is not null and value <> ''")


def _first_values(d: DataFrame, n: int) -> DataFrame:
    """(session, value): the ``n`` values of a session that come first; (session, value, line_order, i) in."""
    once = d.where("value is not null").groupBy("session", "value").agg(F.min(F.struct("line_order", "i")).alias("o"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy("o", "value"))).where(F.col("r") <= n)


def sessions(raw: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, segments) of the session logs, and of the prompts of sessions that have no log.

    ``history`` are lines (session_id, ts in seconds, text) of the prompt history. Facts of a session: project, folder,
    version, model, the first commands, tools and files; file names come from commands, folders and results.
    """
    log = session_log(raw)
    per = log.groupBy("session").agg(
        F.min_by("meta", F.struct("file", "line_order")).alias("meta"), F.count("*").alias("n_lines"),
        F.min(F.when((F.col("type") == "turn_context") & (_get("p", "$.model") != ""), F.struct("line_order", _get("p", "$.model").alias("model"), F.coalesce(F.nullif(_get("p", "$.effort"), F.lit("")), F.lit("default")).alias("effort")))).alias("turn"),
    )
    per = per.withColumns({"cwd": F.coalesce(F.nullif(_get("meta", "$.cwd"), F.lit("")), F.lit("/unknown")), "version": _get("meta", "$.cli_version")})
    s = F.col("session")
    called = calls(log)
    command = _get("args", "$.command")
    shell = called.where("name = 'shell_command'").select("session", "line_order", F.substring(command, 1, COMMAND_CHARS).alias("value"), F.lit(0).alias("i")).where("value <> ''")
    tools = called.where("name not in ('shell_command', 'update_plan')").select("session", "line_order", F.col("name").alias("value"), F.lit(0).alias("i"))
    matched = lambda text: F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATH), F.lit(1)), lambda x: F.length(x) > 3)
    of_calls = called.select("session", "line_order", F.posexplode(F.concat(matched(command), F.array_compact(F.array(F.nullif(_get("args", "$.workdir"), F.lit("")))))).alias("i", "value"))
    results = log.where("kind = 'function_call_output'")
    of_results = results.select("session", "line_order", F.posexplode(F.filter(matched(_get("p", "$.output")), lambda x: ~F.contains(x, F.lit("...")))).alias("i", "value"))
    files = of_calls.select("session", "line_order", "i", "value").unionByName(of_results)
    first_files = _first_values(files, FILES)
    facts = (
        _facts(per, s, PREFIX + "session_project", project(F.col("cwd")))
        .unionByName(_facts(per, s, PREFIX + "cwd", F.col("cwd")))
        .unionByName(_facts(per, s, PREFIX + "cli_version", F.col("version")))
        .unionByName(_facts(per, s, PREFIX + "model", F.concat("turn.model", F.lit(" (effort: "), "turn.effort", F.lit(")"))))
        .unionByName(_facts(_first_values(shell, COMMANDS), s, "ran_command", F.col("value"), "event"))
        .unionByName(_facts(_first_values(tools, TOOLS), s, "used_tool", F.col("value"), "event"))
        .unionByName(_facts(first_files, s, "touched_file", F.col("value"), "event", confidence=0.9))
    )
    counts = called.groupBy("session").agg(F.count("*").alias("n_calls"), F.count(F.when((F.col("name") == "shell_command") & (command != ""), 1)).alias("n_commands"))
    n_files = files.groupBy("session").agg(F.countDistinct("value").alias("n_files"))
    said = log.where("type = 'event_msg' and kind = 'user_message'").select("session", "line_order", F.substring(_get("p", "$.message"), 1, PROMPT_CHARS).alias("m")).where("m <> ''")
    prompts = said.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_order", "m"))), lambda x: F.concat(F.lit("  > "), x["m"])).alias("prompts"))
    d = per.join(counts, "session", "left").join(n_files, "session", "left").join(prompts, "session", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    head = [F.concat(F.lit("CWD: "), "cwd"), F.concat(F.lit("Model: "), F.coalesce("turn.model", F.lit("unknown"))), F.concat(F.lit("Tool calls: "), count("n_calls")), F.concat(F.lit("Commands: "), count("n_commands")), F.concat(F.lit("Files: "), count("n_files")), F.lit(""), F.lit("User prompts:")]
    body = F.array_join(F.concat(F.array(*head), F.coalesce("prompts", F.array().cast("array<string>"))), "\n")
    segments = d.select("session", F.concat(F.lit("codex_session:"), F.substring("session", 1, 8)).alias("label"), body.alias("content"), F.col("n_lines").alias("line_end"))

    rest = history.join(per.select(F.col("session").alias("session_id")).distinct(), "session_id", "left_anti").where("session_id <> '' and ts is not null and text is not null")
    facts = facts.unionByName(_facts(rest, F.col("session_id"), PREFIX + "prompt", F.substring("text", 1, PROMPT_CHARS), "event"))
    iso = F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    told = rest.groupBy(F.col("session_id").alias("session")).agg(F.array_sort(F.collect_list(F.struct("line_order", F.concat(F.lit("["), iso, F.lit("] "), "text").alias("t")))).alias("l"))
    told = told.select("session", F.concat(F.lit("codex_history:"), F.substring("session", 1, 8)).alias("label"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("content"), F.size("l").cast("long").alias("line_end"))
    return facts, segments.unionByName(told)


def prompt_history(raw: DataFrame) -> DataFrame:
    """(session_id, ts, text, line_order) of the prompt history; lines that are no JSON, or lack one of the three, go."""
    d = raw.withColumn("v", F.try_parse_json("value"))
    return d.select(_get("v", "$.session_id").alias("session_id"), _get("v", "$.ts", "double").alias("ts"), _get("v", "$.text").alias("text"), F.struct("file", "line_order").alias("line_order")).where("session_id <> '' and ts is not null and text is not null")


# ------------------------------------------------------------------ shared memory folder


def safe_path(path: Column | str) -> Column:
    """struct (path, reason): the path without ``.`` and ``..``, or null and why it may not be followed.

    Links are not followed by the readers used here, so a path that stays inside as text stays inside.
    """
    c = F.col(path) if isinstance(path, str) else path
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        empty = F.size(acc["stack"]) == 0
        up = F.when(empty, acc["stack"]).otherwise(F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0))))
        return F.struct(F.when(x.isin("", "."), acc["stack"]).when(x == "..", up).otherwise(F.concat(acc["stack"], F.array(x))).alias("stack"), (acc["out"] | ((x == "..") & empty)).alias("out"))

    walked = F.aggregate(F.split(F.coalesce(c, F.lit("")), "/"), start, step)
    reason = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "empty path").when(c.startswith("/"), "absolute path").when(walked["out"], "outside the folder").when(F.size(walked["stack"]) == 0, "the folder itself")
    return F.struct(F.when(reason.isNull(), F.array_join(walked["stack"], "/")).alias("path"), reason.alias("reason"))


def front_list(text: Column, key: str) -> Column:
    """A list of the front matter, written as ``[a, b]`` or as lines ``- a``; null if there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}\s*:\s*\[([^\]]*)\]", 1)
    listed = F.regexp_extract(block, rf"(?m)^{key}\s*:\s*\r?\n((?:\s*-\s+.*(?:\r?\n|\z))+)", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")
    some = lambda a: F.filter(F.transform(a, clean), lambda x: x != "")
    return F.when(inline != "", some(F.split(inline, ","))).when(listed != "", some(F.transform(F.split(listed, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*-\s+", ""))))


DOCUMENT = "id string, domain string, kind string, title string, summary string, tags array<string>, paths array<string>, entities array<string>, updated_at string, rel_path string, confidence double"
INSTANCE = "session_id string, cwd string, git_root string, domain_snapshot array<string>"


def shared_memory(documents: DataFrame, files: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, segments, rejected) of a shared memory: its index (DOCUMENT), the files (path below the folder, text), and the instances (INSTANCE).

    A document whose path is rejected, or whose file is missing, is known by its index entry only; ``rejected`` says why.
    """
    d = documents.withColumn("_p", safe_path("rel_path")).withColumn("path", F.col("_p.path"))
    d = d.join(files.select("path", F.col("text").alias("_text")), "path", "left")
    rejected = d.select("id", "rel_path", F.coalesce("_p.reason", F.when(F.col("_text").isNull(), "missing file")).alias("reason")).where("reason is not null")
    t = F.coalesce("_text", F.lit(""))
    d = d.withColumns({"_front": front_matter(t), "_body": F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)\A---\r?\n.*?\r?\n---", ""), r"^\s+|\s+$", ""))})
    front = lambda k: F.nullif(F.try_element_at("_front", F.lit(k)), F.lit(""))
    d = d.withColumns({f"_{k}": F.coalesce(front_list(t, k), k, F.array().cast("array<string>")) for k in ("entities", "paths", "tags")})
    i, none = F.col("id"), F.lit("")
    of = lambda c: d.select("id", F.explode(c).alias("x")).where("x <> ''")
    paths = F.filter(F.slice("_paths", 1, PATHS), lambda x: x.startswith("/"))
    summary = F.coalesce(F.nullif(F.col("summary"), none), front("summary"), "title")
    kind = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in KINDS.items()], F.lit("state"))
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.try_to_number(front("confidence"), F.lit("9.9999")).cast("double"), F.lit(0.9))
    linked = d.select("id", front("source_session_id").alias("session_id")).where("session_id is not null")
    inst = instances.where("session_id <> ''").dropDuplicates(["session_id"])
    where = F.coalesce(F.nullif(F.col("git_root"), none), F.col("cwd"))
    s = F.col("session_id")
    facts = (
        _facts(of("_entities"), i, "references_entity", F.lower("x"), confidence=0.95)
        .unionByName(_facts(of(paths), i, "references_path", F.col("x")))
        .unionByName(_facts(d, i, PREFIX + "memory_kind", F.col("kind")))
        .unionByName(_facts(d, i, PREFIX + "domain", F.col("domain")))
        .unionByName(_facts(d, i, F.concat(F.lit(PREFIX), "kind"), summary, kind, "human_curated", sure))
        .unionByName(_facts(linked, i, "source_session", s))
        .unionByName(_facts(linked.join(inst, "session_id"), i, "source_project", project(where, ("tools",))))
        .unionByName(_facts(of("_tags"), i, "tagged", F.col("x")))
        .unionByName(_facts(inst, s, PREFIX + "instance_cwd", F.col("cwd")))
        .unionByName(_facts(inst, s, PREFIX + "instance_git_root", F.col("git_root")))
        .unionByName(_facts(inst.select("session_id", F.explode("domain_snapshot").alias("x")), s, PREFIX + "instance_domain", F.col("x")))
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    body = F.when(F.col("_body") != "", F.substring("_body", 1, CONTENT_CHARS)).otherwise(F.concat(F.lit("[Index-only: "), F.coalesce("summary", none), F.lit("]")))
    content = F.array_join(F.array(line("Kind", F.col("kind")), line("Domain", F.col("domain")), line("Title", F.col("title")), line("Summary", F.coalesce(F.nullif(F.col("summary"), none), F.lit("N/A"))), line("Confidence", F.coalesce(F.col("confidence").cast("string"), none)), none, body), "\n")
    segments = d.select("id", F.substring("title", 1, LABEL_CHARS).alias("label"), content.alias("content"))
    return facts, segments, rejected


# ------------------------------------------------------------------ memories that an assistant writes by itself

#: Types told by a file's name, and the kinds of fact that types are. Fixed values.
AUTO_TYPES = ("feedback", "project", "playbook", "reference")
AUTO_KINDS = {"feedback": "constraint", "playbook": "remediation"}
AUTO, AUTO_BODY, AUTO_SEGMENT = "pai_auto_memory", 4000, 8000


def auto_memories(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, segments) of memory files (path, text); the index file ``MEMORY.md`` and other files than Markdown are left out.

    Two files whose names give one key are an error, as facts of one would be taken for those of the other.
    """
    d = files.where(F.col("path").endswith(".md") & (F.element_at(F.split("path", "/"), -1) != "MEMORY.md"))
    t, none = F.coalesce("text", F.lit("")), F.lit("")
    slug = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    d = d.select("path", slug.alias("slug"), t.alias("text"), front_matter(t).alias("front"), front_list(t, "tags").alias("tags"), F.regexp_replace(F.regexp_replace(t, r"(?s)\A---\r?\n.*?\r?\n---", ""), r"^\s+|\s+$", "").alias("body"))
    get = lambda k: F.nullif(F.try_element_at("front", F.lit(k)), none)
    guessed = F.coalesce(*[F.when(F.col("slug").startswith(k + "_"), k) for k in AUTO_TYPES], F.lit("auto"))
    key = F.concat(F.lit(AUTO + ":"), F.regexp_replace(F.regexp_replace(F.trim("slug"), r"\s+", "_"), r"[^A-Za-z0-9_.:-]", "_"))
    same = Window.partitionBy("key")
    d = d.withColumns({"key": key, "type": F.coalesce(get("type"), guessed), "tags": F.coalesce("tags", F.array().cast("array<string>"))}).withColumn("_n", F.count("*").over(same))
    d = d.withColumn("key", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two files have the key "), "key")).cast("string")).otherwise(F.col("key")))
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in AUTO_KINDS.items()], F.lit("state"))
    k = F.col("key")
    facts = (
        _facts(d, k, AUTO + "_type", F.col("type"))
        .unionByName(_facts(d, k, AUTO + "_content", F.substring("body", 1, AUTO_BODY), kind, "human_curated", 0.9))
        .unionByName(_facts(d, k, "description", get("description"), "state", "human_curated", 0.9))
        .unionByName(_facts(d, k, "origin_session", get("originsessionid")))
        .unionByName(_facts(d.select("key", F.explode("tags").alias("x")), k, "tagged", F.col("x")))
    )
    said = lambda name, value, other="none": F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(value, none), F.lit(other) if isinstance(other, str) else other))
    content = F.array_join(F.array(F.concat(F.lit("Slug: "), "slug"), said("Name", get("name"), F.col("slug")), said("Type", F.col("type")), said("Description", get("description")), said("Origin session", get("originsessionid")), said("Tags", F.array_join("tags", ", ")), none, F.col("body")), "\n")
    segments = d.select("key", F.substring(F.coalesce(get("name"), "slug"), 1, LABEL_CHARS).alias("label"), F.substring(content, 1, AUTO_SEGMENT).alias("content"), F.concat(F.lit("assistant:pai/auto/"), "type").alias("scope_path"), F.size(F.split("text", r"\r?\n")).alias("line_end"))
    return facts, segments
