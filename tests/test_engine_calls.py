"""Snapshots, revisions, contradictions and backfilled times through the engine; vocabularies and the evidence boundary."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone import catalog as cat
from lodestone.functions import vocabulary as V
from lodestone.plans.engine import Engine

NOW = "2024-06-01"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def engine(spark):
    def table(name, rows):
        schema = cat.schema(name)
        return spark.createDataFrame([tuple({"tenant": "default", **r}.get(f) for f in schema.names) for r in rows], schema)

    return Engine(cat.Catalog(spark, tables={
        "memory": table("memory", [
            {"memory_id": "m1", "title": "Backup rules", "narrative": "Run the backups nightly", "scope_path": "project:app", "lifecycle_state": "draft", "support_count": 3, "memory_type": "playbook", "created_at": day(0)},
            {"memory_id": "m2", "title": "backup rules", "narrative": "Run them weekly", "scope_path": "project:app", "lifecycle_state": "published", "support_count": 1, "contradiction_count": 2, "created_at": day(0)},
            {"memory_id": "m3", "title": "Secret", "narrative": "backups nightly", "scope_path": "project:app", "governance_status": "suppressed"},
            {"memory_id": "m4", "title": "Other", "narrative": "Backups run nightly elsewhere", "scope_path": "project:web"},
        ]),
        "memory_support": table("memory_support", [{"memory_id": "m1", "fact_id": "f1", "support_type": "supporting", "created_at": day(3)}, {"memory_id": "m1", "fact_id": "f2", "support_type": "supporting", "created_at": day(1)}, {"memory_id": "m2", "fact_id": "f2", "support_type": "supporting"}]),
        "fact": table("fact", [
            {"fact_id": "f1", "subject_entity_id": "e", "predicate": "p", "fact_kind": "state", "object_value": "a", "current_status": "active", "episode_id": "x"},
            {"fact_id": "f2", "subject_entity_id": "e", "predicate": "p", "fact_kind": "state", "object_value": "b", "current_status": "active", "valid_from": day(9), "priority": 1},
            {"fact_id": "f3", "subject_entity_id": "e", "predicate": "q", "fact_kind": "cause", "object_value": "b", "current_status": "active", "episode_id": "x"},
        ]),
        "episode": table("episode", [{"episode_id": "x", "start_at": day(1), "end_at": day(5), "outcome": "resolved"}]),
    }))


def test_snapshots_search_for_themselves(spark, engine):
    requests = spark.createDataFrame([("a", "/srv/app", None, "nightly backups", None, None, None), ("b", "/srv/web", None, "nothing like this", "deep", None, None)], "request_id string, cwd string, git_root string, prompt string, profile string, max_tokens long, mode string")
    got = {r.request_id: r for r in engine.snapshots(requests).collect()}
    assert [c.memory_id for c in got["a"].cards] == ["m1"] and not got["a"].fallback
    assert [c.memory_id for c in got["b"].cards] == ["m4"] and got["b"].fallback and "scope-fallback" in got["b"].markdown


def test_revisions_and_edges(engine):
    got = {(r.memory_id, r.revision_type): r for r in engine.revisions(F.lit(NOW).cast("timestamp")).collect()}
    assert set(got) == {("m1", "created"), ("m1", "enriched"), ("m2", "merged"), ("m2", "retired")}  # m2 rests on a fact of priority 1
    assert got["m1", "created"].fact_id == "f2" and got["m1", "created"].derived_class == "rule" and got["m2", "merged"].keeper == "m1"
    assert [r.revision_type for r in engine.revisions(F.lit(NOW).cast("timestamp"), "project:app", 2).collect()] == ["created", "enriched"] and engine.revisions(F.lit(NOW).cast("timestamp"), "project:web").isEmpty()
    edges, bumps = engine.contradiction_edges()
    assert [(r.source_id, r.target_id, r.edge_type) for r in edges.collect()] == [("m1", "m2", "contradicts")] and {r.memory_id for r in bumps.collect()} == {"m1", "m2"}


def test_backfilled(engine):
    got = {r.fact_id: (r.valid_from, r.valid_to, r.current_status, r.filled) for r in engine.backfilled().collect()}
    assert got == {"f1": (day(1), day(9), "superseded", ["start", "superseded"]), "f2": (day(9), None, "active", []), "f3": (day(1), day(5), "active", ["start", "end"])}


def test_vocabulary(spark):
    rows = [("fact_inserted", "fact", "1", '[{"segment_id": "s"}]'), ("fact_inserted", "fact", "1", '{"segment_id": "s"}'), ("tool_called", "fact", "1", '[{"segment_id": "s"}]'), ("tool_called", "memory", "1", None), ("tool_called", "working_memory", "1", None), ("odd", None, "1", "x")]
    d = spark.createDataFrame(rows, "e string, k string, t string, refs string")
    got = d.select(V.choice(F.col("e"), V.EVENT_TYPES, "event type").isNull().alias("known"), V.target_pair(F.col("k"), F.col("t")).isNull().alias("pair"), V.creation(F.col("e"), F.col("k"), F.col("refs")).alias("why"), V.or_default(F.col("k"), V.TARGET_KINDS, "fact").alias("k")).collect()
    assert [r.known for r in got] == [True] * 5 + [False] and [r.pair for r in got] == [True] * 5 + [False]
    assert [bool(r.why) for r in got] == [False, True, True, True, False, False] and got[5].k == "fact"
    assert d.select(V.native_change(F.lit(True)).alias("x"), V.native_change(F.lit(None).cast("boolean")).alias("y")).first().asDict() == {"x": "feedback may not change a target's own columns", "y": None}
    with pytest.raises(Exception, match="must be one of"):
        d.select(V.refused(V.choice(F.col("e"), V.EVENT_TYPES, "event type"), F.col("e"))).collect()
