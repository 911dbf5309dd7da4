"""Feeds that repeat, agent exports and shared memory folders, with broken and hostile input."""

import json
import os
import random

from pyspark.sql import functions as F

from lodestone.operators.written import folder
from lodestone.sources import agent_exports
from lodestone.streaming import intake, streams


def lines(spark, rows, path):
    spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r,) for r in rows], "value string").coalesce(1).write.mode("append").text(path)


def test_nothing_is_taken_twice_with_a_small_memory(spark):
    root, r = folder(spark), random.Random(2)
    taken = []
    for turn in range(4):
        ids = [(s, i) for s in ("a", "b") for i in range(turn * 20, turn * 20 + 40)]
        r.shuffle(ids)
        spark.createDataFrame([*ids, ids[0], ("a", None)], "source string, id long").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema("source string, id long").parquet(f"{root}/in")
        taken = streams.drain_to_parquet(intake.once_per_source(stream, ["source"], "id", keep=25, shards=2), f"{root}/out", f"{root}/ckpt").collect()
    assert sorted((x.source, x.id) for x in taken) == [(s, i) for s in ("a", "b") for i in range(100)]
    late = spark.createDataFrame([("a", 3), ("a", 200), ("c", 1)], "source string, id long")
    late.coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema("source string, id long").parquet(f"{root}/in")
    d = streams.drain_to_parquet(intake.once_per_source(stream, ["source"], "id", keep=25, shards=2), f"{root}/out", f"{root}/ckpt")
    assert d.count() == 202 and {(x.source, x.next_offset) for x in intake.offsets(d, ["source"], "id").collect()} == {("a", 201), ("b", 100), ("c", 2)}


def test_messages_and_annotations(spark):
    root = folder(spark)
    message = lambda i, text, **who: {"update_id": i, "message": {"message_id": i, "from": {"id": 1, **who}, "chat": {"id": 9, "type": "group"}, "date": 0, "text": text}}
    lines(spark, [message(1, "the server-a is down again", first_name="Ann", last_name="Lee"), message(2, "ok", first_name="Ann"), message(3, "a bot says a lot of things", is_bot=True), message(4, None), {"update_id": 5}, "{broken", "", {"update_id": 6, "edited_message": {"message_id": 6, "chat": {"id": 9}, "date": 1, "text": "nobody said this to nginx"}}], root)
    history = intake.messenger_updates(spark.read.text(root))
    assert sorted(r.message_id for r in history.collect()) == [1, 2, 3, 4, 6]
    got = {r.source_key: r for r in intake.messages(history, ["server-a", "serv"], ["nginx"]).collect()}
    assert set(got) == {"messenger:9:1", "messenger:9:6"} and got["messenger:9:1"].title == "Ann Lee @ 1970-01-01T00:00:00.000Z"
    assert [(f.subject, f.predicate, f.value) for f in got["messenger:9:1"].facts] == [("ann_lee", "stated", "the server-a is down again"), ("ann_lee", "mentioned_device", "server-a")]
    assert got["messenger:9:6"].facts[0].subject == "unknown"
    other = folder(spark)
    lines(spark, [{"id": 1, "text": "Rule A {alertname=X, Severity=high} - A=1", "tags": ["severity=low", "job=j"]}, {"id": 2, "text": "Rule B"}, {"id": 3}, "no"], other)
    a = {r.id: r for r in intake.annotations(spark.read.text(other)).collect()}
    assert set(a) == {1, 2, 3} and (a[1].name, a[2].name, a[3].name) == ("X", "Rule B", "alert:3") and a[1].labels == {"alertname": "X", "severity": "high", "job": "j"}


def test_session_logs(spark):
    root = folder(spark)
    call = lambda cid, name, args: {"type": "response_item", "payload": {"type": "function_call", "call_id": cid, "name": name, "arguments": args}}
    out = lambda cid, text: {"type": "response_item", "payload": {"type": "function_call_output", "call_id": cid, "output": text}}
    lines(spark, [
        {"type": "session_meta", "payload": {"id": "S1", "cwd": "/a/tools/kit/lib", "cli_version": 3}}, "{broken", {"type": "turn_context", "payload": {"model": "m"}}, call("c", "shell_command", '{"command": "cat /etc/hosts /x"}'), call("c", "shell_command", "not json"),
        out("c", "first /var/log/a.log /b..."), out("c", "second"), out("d", "stray"), call("e", "", '{"workdir": "/w"}'), call("f", "update_plan", "{}"), {"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": 7}}, [1], None,
    ], f"{root}/logs/x/one")
    lines(spark, ["", "{broken"], f"{root}/logs/y")
    lines(spark, [{"session_id": "S1", "ts": 1, "text": "known"}, {"session_id": "S2", "ts": 1.5, "text": "t" * 600}, {"session_id": "S2", "ts": 0, "text": "second"}, {"session_id": "S3", "text": "no time"}, "nope"], f"{root}/history")
    log = agent_exports.lines(spark, f"{root}/logs")
    called = agent_exports.calls(agent_exports.session_log(log)).orderBy("line_order").collect()
    assert [(c.call_id, c.name, c.output) for c in called] == [("c", "shell_command", "first /var/log/a.log /b..."), ("c", "shell_command", "second"), ("e", "unknown", None), ("f", "update_plan", None)]
    facts, segments = agent_exports.sessions(log, agent_exports.prompt_history(agent_exports.lines(spark, f"{root}/history")))
    got = {(f.subject, f.predicate, f.value) for f in facts.collect()}
    assert got == {
        ("S1", "codex_session_project", "kit/lib"), ("S1", "codex_cwd", "/a/tools/kit/lib"), ("S1", "codex_cli_version", "3"), ("S1", "codex_model", "m (effort: default)"), ("S1", "ran_command", "cat /etc/hosts /x"), ("S1", "used_tool", "unknown"),
        ("S1", "touched_file", "/etc/hosts"), ("S1", "touched_file", "/w"), ("S1", "touched_file", "/var/log/a.log"), ("S2", "codex_prompt", "t" * 500), ("S2", "codex_prompt", "second"),
    }
    s = {r.session: r for r in segments.collect()}
    assert set(s) == {"S1", "S2"} and s["S1"].content.startswith("CWD: /a/tools/kit/lib\nModel: m\nTool calls: 4\nCommands: 1\nFiles: 3\n\nUser prompts:\n  > hi") and s["S2"].content.endswith("\n[1970-01-01T00:00:00.000Z] second")


def test_projects_and_paths(spark):
    cwd = [("/a/tools/x/y", "x/y"), ("/a/projects", "projects"), ("/q/vault/n", "vault/n"), ("/only/last", "last"), ("/", "unknown"), ("/tools/a/projects/b", "b")]
    d = spark.createDataFrame(cwd, "c string, want string").withColumn("got", agent_exports.project(F.col("c")))
    assert [r.got for r in d.collect()] == [r[1] for r in cwd]
    paths = {"a/b.md": "a/b.md", "./a//b/../c": "a/c", "..": "outside the folder", "a/../..": "outside the folder", "a/../../a": "outside the folder", "/etc": "absolute path", "": "empty path", "  ": "empty path", ".": "the folder itself", "a/..": "the folder itself", "a/..b": "a/..b", "..\\x": "..\\x"}
    d = spark.createDataFrame([(p,) for p in [*paths, None]], "p string").select("p", agent_exports.safe_path("p").alias("s")).select("p", "s.*")
    for r in d.collect():
        assert (r.path or r.reason) == paths.get(r.p, "empty path") and (r.path is None) != (r.reason is None)
        if r.path:
            assert not os.path.relpath(os.path.normpath(os.path.join("/base", r.path)), "/base").startswith("../")


def test_shared_memory_reads_lists_of_both_kinds(spark):
    text = "---\r\ntags: [a, 'b c']\r\nentities:\r\n  - X\r\n  - \"Y\"\r\nsource_session_id: none\r\n---\r\n\r\nBody"
    documents = spark.createDataFrame([("d1", "dom", "gotcha", "T" * 120, None, None, None, ["z"], None, "f.md", None), ("d2", "dom", None, "T", "", ["t", ""], ["/p"] * 25 + ["/q"], None, None, None, 0.0)], agent_exports.DOCUMENT)
    files = spark.createDataFrame([("f.md", text)], "path string, text string")
    facts, segments, rejected = agent_exports.shared_memory(documents, files, spark.createDataFrame([], agent_exports.INSTANCE))
    got = {(f.subject, f.predicate, f.value, f.kind, f.confidence) for f in facts.collect()}
    assert {x[1:3] for x in got if x[0] == "d1"} >= {("tagged", "a"), ("tagged", "b c"), ("references_entity", "x"), ("references_entity", "y"), ("source_session", "none")}
    assert ("d1", "codex_gotcha", "T" * 120, "lesson", 0.9) in got and ("d2", "tagged", "t", "state", 1.0) in got and ("d2", "references_path", "/q", "state", 1.0) not in got
    assert {(s.id, len(s.label)) for s in segments.collect()} == {("d1", 100), ("d2", 1)} and [tuple(r) for r in rejected.collect()] == [("d2", None, "empty path")]
