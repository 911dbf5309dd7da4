"""Tenants, clones, model results, backfilled times, revisions, contradictions and manifests on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import coerce, mining, revisions, temporal, tenants
from lodestone.operators.written import folder
from lodestone.sources import manifest


def test_tenants_reach_a_fixed_point_on_circles(spark):
    nodes = spark.createDataFrame([("a", "1", "x"), ("b", "1", None), ("b", "2", None), ("c", "1", None), ("c", "9", None)], "kind string, id string, tenant string")
    refs = spark.createDataFrame([("a", "1", "b", "1"), ("b", "1", "b", "2"), ("b", "2", "b", "1"), ("b", "2", "c", "1"), ("b", None, "c", "9")], "from_kind string, from_id string, kind string, id string")
    assert sorted(map(tuple, tenants.infer(nodes, refs).collect())) == [("a", "1", "x"), ("b", "1", "x"), ("b", "2", "x"), ("c", "1", "x")]
    assert [tuple(r) for r in tenants.ambiguous(nodes, tenants.infer(nodes, refs), ["b", "c"]).collect()] == [("c", "9", 0)]
    with pytest.raises(tenants.AmbiguousTenant, match="c 9"):
        tenants.assign(nodes, refs, ["c"])
    assert tenants.assign(nodes, refs, ["b"]).count() == 2


def test_split_uses_rows_that_are_there_and_is_repeatable(spark):
    table = spark.createDataFrame([("1", "x", "P", None), ("2", "x", "Q", "q"), ("3", "y", "P", None), ("4", "x", "P", None)], "id string, tenant string, type string, name string")
    wanted = spark.createDataFrame([("1", "x"), ("1", "y"), ("2", "y"), ("2", "z"), ("4", "z"), ("1", "z")], "id string, tenant string")
    rows, ids = tenants.split(table, wanted, "id", ["type", "name"])
    got = {(r.old_id, r.tenant): r.new_id for r in ids.collect()}
    assert got["1", "x"] == "1" and got["1", "y"] == "3" and got["1", "z"] == got["4", "z"] and len(got["2", "y"]) == 36
    assert {(r.tenant, r.type, r.name) for r in rows.collect()} == {("y", "Q", "q"), ("z", "Q", "q"), ("z", "P", None)} and rows.count() == 3
    again, same = tenants.split(table.unionByName(rows), wanted, "id", ["type", "name"])
    assert again.isEmpty() and {(r.old_id, r.tenant): r.new_id for r in same.collect()} == got
    led = tenants.remap(spark.createDataFrame([("z", "2"), ("x", "2"), ("z", None)], "tenant string, ref string"), ids, ["ref"])
    assert sorted((r.tenant, r.ref or "") for r in led.collect()) == sorted([("z", got["2", "z"]), ("x", "2"), ("z", "")])


def test_model_results(spark):
    good = '{"facts": [{"subject": "a", "predicate": "p", "object_value": null, "fact_kind": "event", "confidence": 1, "segment_ids": ["s"], "status": "hypothesis"}], "lessons": [{"description": "d", "confidence": 0, "segment_ids": ["s"]}], "questions": [{"text": "?", "segment_ids": []}]}'
    raw = {
        1: good, 2: "```\n" + good + "\n```", 3: "", 4: None, 5: "[1]", 6: '{"facts": {}}', 7: '{"facts": [1, {"subject": 5, "predicate": "", "object_value": {"b": [1]}, "fact_kind": 3, "confidence": -1, "segment_ids": [2], "status": "x"}]}',
        8: '{"facts": [], "lessons": [{"description": "", "confidence": 2, "segment_ids": "s"}], "questions": 1}', 9: '{"facts": []}',
    }
    docs, facts = coerce.read(spark.createDataFrame(list(raw.items()), "result_id int, raw string"))
    got = {r.result_id: r for r in docs.collect()}
    assert {i: r.valid for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: True}
    assert got[3].errors == got[4].errors == ["JSON parse error"] and got[5].errors == ["facts: missing"] and got[6].errors == ["facts: no list"]
    assert got[7].errors == ["facts.0: no object", "facts.1.subject: no string", "facts.1.predicate: empty", "facts.1.fact_kind: no known kind", "facts.1.confidence: below 0", "facts.1.segment_ids: holds no strings", "facts.1.status: no known status"]
    assert set(got[8].errors) == {"questions: no list", "lessons.0.description: empty", "lessons.0.confidence: above 1", "lessons.0.segment_ids: no list"}
    f = {(r.result_id, r.i): r for r in facts.collect()}
    assert f[1, 0].value is None and f[1, 0].status == "hypothesis" and f[7, 1].value == '{"b":[1]}' and not f[7, 1].valid


def test_backfill_against_pairs(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), "p", r.choice(["state", "cause"]), r.choice("xyz") if r.random() < 0.9 else None, r.choice([None, *range(8)]), r.choice([None, None, 9, 5]), r.choice(["active", "active", "archived"]), r.randrange(6)) for i in range(160)]
    episodes = [(0, 1, 4, "resolved"), (1, None, 7, "closed"), (2, 2, 6, "open"), (3, 3, None, "closed"), (4, 0, 3, "resolved")]
    facts = spark.createDataFrame(rows, "fact_id int, subject_entity_id string, predicate string, fact_kind string, object_value string, valid_from int, valid_to int, current_status string, episode_id int")
    got = {x.fact_id: (x.valid_from, x.valid_to, x.current_status) for x in temporal.backfill(facts, spark.createDataFrame(episodes, "episode_id int, start_at int, end_at int, outcome string")).collect()}
    by = {e[0]: e for e in episodes}
    state = {}
    for i, s, p, k, v, a, b, c, e in rows:
        ep = by.get(e)
        a = ep[1] if a is None and ep else a
        b = ep[2] if b is None and ep and ep[3] in ("resolved", "closed") and k == "cause" else b
        state[i] = ((s, p, k), v or "", a, b, c)
    want = {}
    for i, (key, v, a, b, c) in state.items():
        later = [a2 for k2, v2, a2, _, c2 in state.values() if k2 == key and c == c2 == "active" and None not in (a, a2) and a < a2 and (b is None or b > a2) and v != v2]
        want[i] = (a, min(later), "superseded") if later else (a, b, c)
    assert got == want


def test_merges_end_at_one_memory(spark):
    merges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "y"), ("y", "z"), ("z", "x"), ("t", "x"), ("s", "s")], "memory_id string, keeper string")
    assert dict(map(tuple, revisions.final_keepers(merges).collect())) == {"b": "a", "c": "a", "d": "a", "e": "a", "y": "x", "z": "x", "t": "x"}
    memories = spark.createDataFrame([("a", 1, 1, "published"), ("b", 1, 2, "draft"), ("c", 1, None, "draft"), ("q", 4, 0, "draft")], "memory_id string, support_count int, contradiction_count int, lifecycle_state string")
    support = spark.createDataFrame([("a", "f1", None, "supporting"), ("b", "f1", None, "supporting"), ("c", "f2", None, "supporting"), ("c", "f3", None, "counter"), ("q", "f1", None, "supporting")], "memory_id string, fact_id string, episode_id string, support_type string")
    m, s = revisions.unite(memories, support, spark.createDataFrame([("b", "a"), ("c", "b")], "memory_id string, keeper string"))
    assert {tuple(r) for r in m.collect()} == {("a", 2, 3, "published"), ("b", 0, 2, "retired"), ("c", 0, None, "retired"), ("q", 4, 0, "draft")}
    assert sorted((r.memory_id, r.fact_id) for r in s.collect()) == [("a", "f1"), ("a", "f2"), ("a", "f3"), ("q", "f1")]


def test_revisions_are_inserted_once(spark):
    found = spark.createDataFrame([("m", "created", "r", "n", "n", "f", None)], "memory_id string, revision_type string, change_reason string, old_narrative string, new_narrative string, fact_id string, episode_id string")
    empty = spark.createDataFrame([], "memory_id string, tenant string, revision_type string, change_reason string, prompt_version string")
    new, support = revisions.insert(empty, found, "t")
    assert new.count() == support.count() == 1 and new.first().revision_id == support.first().revision_id
    assert revisions.insert(new, found, "t")[0].isEmpty()


def test_conflict_edges_reach_every_conflict_and_stay_linear(spark):
    rows = [(f"m{i:03}", "t", "s", "Same" if i % 2 else "SAME", f"n{i % 3}") for i in range(300)] + [("x1", "t", None, "A", "1"), ("x2", "t", "", "a", "1"), ("x3", "t", "other", "a", "2"), ("y1", "t", "q", None, "1"), ("y2", "t", "q", "b", None)]
    memories = spark.createDataFrame(rows, "memory_id string, tenant string, scope_path string, title string, narrative string")
    cues = spark.createDataFrame([("y1", "c"), ("y2", "c"), ("y2", "c"), ("x3", "c")], "memory_id string, cue_hash string")
    known = spark.createDataFrame([], "tenant string, edge_fingerprint string")
    new, bumps = mining.conflict_edges(memories, cues, known, "t")
    edges = {(r.source_id, r.target_id) for r in new.collect()}
    held = {r[0]: r for r in rows}
    assert len(edges) <= len(rows) and all(a < b and held[a][4] != held[b][4] for a, b in edges)
    assert {r.memory_id for r in bumps.collect()} == {f"m{i:03}" for i in range(300)} | {"y1", "y2"} == set(itertools.chain(*edges))
    later, none = mining.conflict_edges(memories, cues, new.limit(300), "t")
    assert later.count() == len(edges) - 300 if len(edges) > 300 else later.isEmpty()
    assert mining.conflict_edges(memories, cues, new, "t")[1].isEmpty() and none.count() <= 2 * len(edges)


def test_manifest_finds_a_changed_byte(spark):
    root = folder(spark)
    spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, value string").repartition(3).write.partitionBy("k").text(root)
    files = manifest.files(spark, root, "part-*")
    assert files.count() == 3 and {r.size for r in files.collect()} == {2} and all(r.name.startswith("k=") for r in files.collect())
    one = manifest.digest(files).first()
    assert (one.files, one.bytes) == (3, 6) and manifest.digest(files.repartition(7)).first() == one
    other = files.withColumn("sha256", F.when(F.col("name").startswith("k=b"), F.sha2(F.lit("Y\n"), 256)).otherwise(F.col("sha256")))
    assert manifest.digest(other).first().digest != one.digest and [r.problem for r in manifest.verify(files, other).collect()] == ["changed"]
    with pytest.raises(Exception, match="two files are named"):
        manifest.digest(files.unionByName(files)).collect()
    assert manifest.digest(files.where("false")).first().files == 0
    gone = manifest.missing_artifacts(spark.createDataFrame([("1", "AA"), ("2", "bb"), ("3", "cc"), ("4", "d")], "artifact_id string, sha256 string"), spark.createDataFrame([("1", "p", "aa"), ("2", "q", "xx"), ("4", "r", None)], "artifact_id string, archive_path string, sha256 string"))
    assert {(r.artifact_id, r.reason) for r in gone.collect()} == {("2", "digest differs"), ("3", "not archived"), ("4", "no digest")}
