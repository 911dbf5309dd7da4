"""The engine over a small corpus, catalog versions, sources, streams and merges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone import catalog as cat
from lodestone.operators import evaluation, folds, merge
from lodestone.plans.engine import Engine, plan
from lodestone.sources import readers
from lodestone.streaming import streams

T0 = dt.datetime(2024, 1, 1)
now = lambda: F.lit("2024-06-01 00:00:00").cast("timestamp")


def table(spark, name, rows):
    schema = cat.schema(name)
    return spark.createDataFrame([tuple({"tenant": "default", **r}.get(f) for f in schema.names) for r in rows], schema)


@pytest.fixture(scope="module")
def engine(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    fact = lambda i, s, p, v, **k: dict(fact_id=i, subject_entity_id=s, predicate=p, object_value=v, fact_kind="cause", confidence=0.8, assertion_class="deterministic", current_status="active", priority=5, scope_path="infra/a", **k)
    tables = {
        "entity": [dict(entity_id="e1", entity_type="device", canonical_name="gateway", aliases=["gw-1"]), dict(entity_id="e2", entity_type="service", canonical_name="billing", aliases=[])],
        "fact": [
            fact("f1", "e1", "root_cause", "firmware regression on gateway", episode_id="p1", valid_from=day(0), valid_to=day(10)),
            fact("f2", "e1", "fix_summary", "rolled back firmware", episode_id="p1"),
            fact("f3", "e2", "impact", "billing requests failed", episode_id="p2"),
            fact("f4", "e2", "impact", "hidden by a quarantined memory", episode_id="p3"),
        ],
        "episode": [dict(episode_id="p1", title="Gateway outage", summary="firmware regression", scope_path="infra/a", start_at=day(0), outcome="resolved"), dict(episode_id="p2", title="Billing errors", summary="requests failed", scope_path="infra/b", start_at=day(2), outcome="unresolved")],
        "memory": [
            dict(memory_id="m1", title="Firmware playbook", narrative="Roll back firmware when the gateway regresses", lifecycle_state="published", scope_path="infra/a", priority=1, governance_status="validated", quality_score=0.9, namespace="procedural", token_count=40, fingerprint="x1"),
            dict(memory_id="m2", title="Bad firmware memory", narrative="firmware is always fine", lifecycle_state="published", governance_status="quarantined", scope_path="infra/a", fingerprint="x2"),
            dict(memory_id="m3", title="Firmware playbook", narrative="Never roll back firmware", lifecycle_state="published", scope_path="infra/a", governance_status="active", token_count=2000, fingerprint="x3"),
        ],
        "memory_support": [dict(memory_id="m1", fact_id="f1", support_type="supporting"), dict(memory_id="m2", fact_id="f4", support_type="counter"), dict(memory_id="m3", fact_id="f1", support_type="counter")],
        "fact_evidence": [dict(fact_id="f1", segment_id="s1", excerpt="firmware 2.1 regressed", weight=1.0)],
        "memory_edge": [dict(edge_id="g1", source_type="fact", source_id="f1", target_type="episode", target_id="p2", edge_type="affects", confidence=0.9, assertion_class="deterministic")],
        "event_frame": [dict(event_frame_id=f"v{i}", episode_id="p1" if i < 4 else "p2", event_type=k, actor_entity_id="e1" if i < 4 else "e2", time_start=day(i), created_at=day(i)) for i, k in enumerate(["cause", "impact", "note", "remediation", "impact", "decision"])],
        "procedure": [dict(procedure_id="r1", title="Firmware rollback", summary="roll back after failed update", scope_path="infra/a", episode_id="p2")],
        "procedure_step": [dict(procedure_id="r1", step_id=f"t{i}", step_index=i, action=f"step {i}") for i in (1, 2, 3)],
        "media_artifact": [dict(media_id="a1", caption="firmware screen", scope_path="infra/a")],
        "visual_region": [dict(region_id="w1", media_id="a1", label="firmware version", confidence=0.7, x_min=0.0, y_min=0.0, x_max=1.0, y_max=1.0)],
    }
    return Engine(cat.Catalog(spark, tables={n: table(spark, n, r) for n, r in tables.items()}))


def test_search(engine):
    found = engine.search("firmware", limit=10).collect()
    ids = [r.object_id for r in found]
    assert {"f1", "f2", "m1", "m3", "p1"} <= set(ids) and "m2" not in ids and "f4" not in ids
    assert ids[0] == "m1"  # priority 1 doubles its score
    assert [e.excerpt for r in found if r.object_id == "f1" for e in r.evidence] == ["firmware 2.1 regressed"]
    assert "p2" not in ids and "p2" in [r.object_id for r in engine.search("firmware", with_graph=True).collect()]
    assert {r.object_id for r in engine.search("firmware", scope="infra/b").collect()} == set()
    late = engine.search("firmware", at=F.lit("2024-02-01").cast("timestamp"), kinds=("fact",)).collect()
    assert "f1" not in {r.object_id for r in late if "fts" in r.scores}
    assert engine.search("firmware", rerank=True, limit=3).count() == 3
    assert engine.search("gateway", kinds=("fact",)).where("object_id = 'f1'").count() == 1
    assert engine.search("the").count() == 0
    assert plan("What caused the gateway outage on 2024-01-02?").answer == "timeline" and "cause" in plan("why").predicates


def test_time_and_procedures(engine):
    assert [r.event_frame_id for r in engine.timeline(subject="gateway").collect()] == ["v0", "v1", "v2", "v3"]
    sides = engine.before_after(F.lit("2024-01-03").cast("timestamp"), 2).collect()
    assert [(r.side, r.event_frame_id) for r in sides] == [("before", "v0"), ("before", "v1"), ("after", "v2"), ("after", "v3")]
    chain = {r.episode_id: [s.event_type for s in r.steps] for r in engine.causal_chains().collect()}
    assert chain == {"p1": ["cause", "impact", "remediation"], "p2": ["impact", "decision"]}
    assert {r.fact_id for r in engine.state_at("gateway", F.lit("2024-01-05").cast("timestamp")).collect()} == {"f1", "f2"}
    assert {r.id for r in engine.explain("m1").collect()} == {"f1", "s1"}
    assert engine.next_step("firmware", 1).first().next_step.step_index == 2
    assert engine.failed_remediations("firmware").count() == 3
    assert [r.kind for r in engine.visuals("firmware").collect()] == ["region", "media"]


def test_recall_and_consolidation(engine):
    package = engine.recall("firmware", budget=100).first()
    assert [i.memory_id for i in package["items"]] == ["m1"] and package.used == 40
    assert [(r.a, r.b, r.same_title) for r in engine.memory_conflicts().collect()] == [("m1", "m3", 1)]
    assert sorted((r.source_id, r.edge_type) for r in engine.link_candidates().collect()) == [("f1", "caused_by"), ("f1", "contradicts")]  # f4 has no evidence
    assert [(r.predicate, r.support) for r in engine.pattern_candidates().collect()] == [("impact", 2)]
    merged, support = engine.reconcile_patterns()
    assert merged.where("not inserted").count() == 3
    new = merged.where("inserted").collect()
    assert [(r.title, r.support_count, r.lifecycle_state, r.memory_type) for r in new] == [("billing impact (cause)", 2, "published", "pattern")]
    assert {(r.memory_id, r.fact_id, r.episode_id, r.notes) for r in support.collect()} == {(new[0].memory_id, f, e, n) for f, e, n in (("f3", None, "impact"), ("f4", None, "impact"), (None, "p2", "billing"), (None, "p3", "billing"))}


def test_catalog(spark, tmp_path):
    c = cat.Catalog(spark, str(tmp_path))
    assert c.read("fact").count() == 0 and len(cat.DDL) >= 50
    c.replace("entity", table(spark, "entity", [dict(entity_id="1", canonical_name="a"), dict(entity_id="2", canonical_name="b", tenant="other")]))
    assert c.read("entity", "default").count() == 1
    c.replace("entity", c.read("entity").where("entity_id = '1'"))
    assert c.read("entity").count() == 1
    held = c.read("entity")  # a version that is held stays readable
    c.append("entity", table(spark, "entity", [dict(entity_id="3", canonical_name="c")]))
    assert sorted(r.entity_id for r in c.read("entity").collect()) == ["1", "3"] and held.count() == 1
    number, folders = c.version("entity")
    assert (number, len(folders)) == (3, 2)
    (tmp_path / "entity" / "_log" / f"{4:020d}").write_text('["half-writ')  # a writer at work
    assert c.read("entity").count() == 2
    with pytest.raises(RuntimeError):
        c.replace("entity", c.read("entity"))
    c.append("lifecycle_audit_log", table(spark, "lifecycle_audit_log", [dict(audit_id="1")]))
    with pytest.raises(ValueError):
        c.replace("lifecycle_audit_log", c.read("lifecycle_audit_log"))
    bad = cat.Catalog(spark, tables={"memory_edge": table(spark, "memory_edge", [dict(edge_id="1", source_type="a", source_id="x", target_type="a", target_id="x", confidence=2.0)])})
    assert bad.check("memory_edge").first().broken == ["confidence", "no_loop"]


def test_merge_and_folds(spark):
    old = spark.createDataFrame([(1, 5, {"a": "1", "b": "2"}), (2, 7, None)], "k int, v int, m map<string,string>")
    new = spark.createDataFrame([(1, 3, {"b": "9"}), (3, None, {"c": "1"})], "k int, v int, m map<string,string>")
    got = {r.k: (r.v, r.m, r.inserted) for r in merge.upsert(old, new, ["k"], {"v": "greatest", "m": "merge"}).collect()}
    assert got == {1: (5, {"a": "1", "b": "9"}, False), 2: (7, None, False), 3: (None, {"c": "1"}, True)}
    items = spark.createDataFrame([("q", i, n) for i, n in enumerate([50, 60, 30, 10, 20])], "q string, i int, n int")
    assert folds.pack(items, ["q"], [F.asc("i")], "n", "i", 100).first()["items"] == [0, 2, 3]
    assert folds.pack(items, ["q"], [F.asc("i")], "n", "i", 40, True).first()["items"] == [0]
    deltas = spark.createDataFrame([("a", 1, 0.9), ("a", 2, -0.3), ("a", 3, 0.1)], "k string, n int, d double")
    assert abs(folds.clamped_sum(deltas, ["k"], ["n"], "d").first().score - 0.8) < 1e-9
    x = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), (["c", "a"], ["a", "c"])], "x array<string>, y array<string>")
    assert [r[0] for r in x.select(folds.contains_in_order(F.col("x"), F.col("y"))).collect()] == [True, False]
    res = spark.createDataFrame([("q1", 1, "fact", "Gateway outage"), ("q2", 11, "fact", "x")], "query_id string, rank int, object_type string, title string")
    exp = spark.createDataFrame([("q1", "fact", "gateway"), ("q2", "fact", "x")], "query_id string, object_type string, title_contains string")
    assert evaluation.relevance(res, exp).first().relevance == 0.5


def test_sources(spark, tmp_path):
    note = "---\nstatus: fixed\ntags: [net, fw]\n---\n# Outage\n**Root cause:** bad firmware\n**Status:** open\n## Steps\nx"
    d = readers.incidents(spark.createDataFrame([("v/INC-1/notes.md", note)], "path string, text string")).first()
    facts = {(f.predicate, f.value) for f in d.facts}
    assert d.title == "Outage" and {("status", "resolved"), ("root_cause", "bad firmware"), ("tags", "net"), ("tags", "fw")} <= facts
    (tmp_path / "a.json").write_text('{"tasks": [{"gid": "1", "name": "A"}, {"gid": "2", "name": "B"}]}')
    (tmp_path / "b.jsonl").write_text('{"gid": "3", "name": "C"}\n{"gid": "4", "name": "D"}\n')
    (tmp_path / "c.json").write_text('{\n  "gid": "5",\n  "name": "E"\n}\n')
    assert sorted(r.gid for r in readers.read_json_items(spark, f"{tmp_path}/*", "gid string, name string").collect()) == ["1", "2", "3", "4", "5"]
    (tmp_path / "d.jsonl").write_text('{"gid": "6"}\n\n{"gid": \n')
    with pytest.raises(Exception, match="d.jsonl: line 3 is no JSON"):
        readers.read_json_items(spark, f"{tmp_path}/d.jsonl", "gid string, name string").collect()
    (tmp_path / "d.jsonl").unlink()
    assert spark.range(1).select(readers.label_map(F.lit('alert{Severity="high", job=api}'))).first()[0] == {"severity": "high", "job": "api"}
    (tmp_path / "log").write_bytes(b"abcdef1\x1fA\x1f2024-01-01\x1fFix\x1fbody\x1enot a sha\x1fB\x1f\x1f\x1f\x1e")
    assert [r.sha for r in readers.commits_log(spark, f"{tmp_path}/log").collect()] == ["abcdef1"]
    digest = readers.chat_digest(spark.createDataFrame([(1, 9, 0, "**[DECISION] Use X** - because\nmore", 5)], "id int, channelId int, windowStart long, summary string, createdAt int"), spark.createDataFrame([(9, "ops")], "id int, name string")).first()
    assert [(f.predicate, f.value) for f in digest.facts] == [("decision", "Use X: because")]
    rows = [("commit", "commit:r:abcdef1", "s", "p", 0.5, {}, None, None, []), ("commit", "commit:r:zz", "s", "p", 0.5, {}, None, None, []), ("messenger", "k", "s", "p", 0.5, {"message_id": "1"}, None, None, []), ("commit", "commit:r:abcdef1", " ", "p", 0.5, {}, None, None, [])]
    g = readers.gate(spark.createDataFrame(rows, "source_type string, source_key string, subject string, predicate string, confidence double, meta map<string,string>, episode_id string, scope_path string, segment_ids array<string>"))
    assert [r.reject_reason for r in g.collect()] == [None, "missing source_key", None, "blank subject"]


def test_streams(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=i * 7), i % 3, "error" if i % 4 else "view", 1.0, "{}") for i in range(60)]
    batch = spark.createDataFrame([*rows, rows[5]], streams.EVENTS)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    s = streams.once_only(streams.event_stream(spark, str(tmp_path / "in")), ["event_id"])
    assert streams.drain_to_parquet(s, str(tmp_path / "out"), str(tmp_path / "c1")).count() == 60
    got = []
    streams.drain(streams.tumbling(streams.event_stream(spark, str(tmp_path / "in")), "1 hour", ["event_type"]), lambda d, n: got.extend(d.collect()), str(tmp_path / "c2"), "update")
    last = {(r.window_start, r.event_type): r.n for r in got}
    assert sum(last.values()) == 61
    out = spark.createDataFrame([("default", f"k{i}", f"o{i}", "pending", i, None, None, T0 + dt.timedelta(seconds=i)) for i in range(4)], "tenant string, idempotency_key string, outbox_id string, status string, attempt_count int, claimed_at timestamp, next_retry_at timestamp, received_at timestamp")
    c = streams.claim(out, now(), 3)
    assert [r.outbox_id for r in c.collect()] == ["o0", "o1", "o2"]
    done = streams.settle(c, spark.createDataFrame([("o0", True)], "outbox_id string, ok boolean"), now(), max_attempts=3).collect()
    assert {r.outbox_id: r.status for r in done} == {"o0": "completed", "o1": "failed", "o2": "dead_letter"}
    assert streams.enqueue(out, out.limit(2)).count() == 0
    assert streams.outbox_stats(out).first().pending == 4
