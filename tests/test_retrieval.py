"""Nearest vectors in blocks against numpy; roles, filters; snapshots: domains, budgets, fallback, cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.catalog import Catalog
from lodestone.operators import snapshot, vectors
from lodestone.plans.engine import Engine

MEMORY = "memory_id string, title string, narrative string, scope_path string, quality_score double, confidence double, priority int, strength double, token_count int, updated_at timestamp, source_class string, trust_class string, governance_status string, namespace string"
REQUEST = "request_id string, cwd string, git_root string, prompt string, profile string, max_tokens long, mode string"


def test_nearest_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = [(f"k{i % 150:03}", "ab"[i % 2], [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [("zero", "a", [0.0] * 5), ("short", "a", [1.0]), ("none", "a", None), ("tie1", "b", [1.0, 0.0, 0.0, 0.0, 0.0]), ("tie0", "b", [2.0, 0.0, 0.0, 0.0, 0.0])]
    asked = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(19)] + [(50, [1.0, 0.0, 0.0, 0.0, 0.0]), (51, [0.0] * 5), (52, None)]
    index = spark.createDataFrame(rows, "object_id string, part string, embedding array<float>").repartition(3)
    got = vectors.nearest(index, spark.createDataFrame(asked, "question_id int, vector array<float>"), 4)
    want = []
    for q, v in asked:
        for p in "ab":
            best = {}
            for k, part, e in rows:
                if part == p and e is not None and len(e) == 5 and any(e) and v is not None and any(v):
                    x, y = np.float32(e).astype(float), np.float32(v).astype(float)
                    best[k] = max(best.get(k, -2), round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6))
            want += [(q, p, k, s, n + 1) for n, (k, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert sorted((r.question_id, r.part, r.object_id, r.similarity, r["rank"]) for r in got.collect()) == sorted(want)
    assert vectors.nearest(index, spark.createDataFrame([], "question_id int, vector array<float>"), 4).isEmpty()
    with pytest.raises(ValueError, match="3 to 5"):
        vectors.nearest(index, spark.createDataFrame([(1, [1.0] * 3), (2, [1.0] * 5)], "question_id int, vector array<double>"), 4)


def test_roles_lead_to_filtered_owners(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    index = table([("evidence", "f1", None, None, [1.0, 0.0]), ("evidence", "f2", None, None, [1.0, 0.0]), ("text", None, "s1", None, [0.0, 1.0]), ("visual_ocr", None, None, "r1", [1.0, 1.0]), ("visual_caption", None, None, "r1", [1.0, 0.0]), ("unknown", "f1", None, None, [1.0, 0.0])], "role string, fact_id string, segment_id string, region_id string, embedding array<double>")
    catalog = Catalog(spark, tables={
        "embedding_index": index.withColumn("tenant", F.lit("default")),
        "fact": table([("default", "f1", "p", "v", "active", "a/x"), ("default", "f2", "p", "v", "superseded", "a/x"), ("other", "f1", "p", "v", "active", "a/x")], "tenant string, fact_id string, predicate string, object_value string, current_status string, scope_path string"),
        "segment": table([("default", "s1", "l", "c" * 600, "b")], "tenant string, segment_id string, section_label string, content string, scope_path string"),
        "media_artifact": table([("default", "m1", "image", "a")], "tenant string, media_id string, media_type string, scope_path string"),
        "visual_region": table([("default", "r1", "m1", None, "box", "read")], "tenant string, region_id string, media_id string, label string, region_type string, ocr_text string"),
    })
    asked = table([(1, [1.0, 0.0])], "question_id int, vector array<double>")
    got = Engine(catalog).by_role(asked, limit=5).orderBy("rank").collect()
    assert [(r.object_type, r.object_id, r.similarity) for r in got] == [("fact", "f1", 1.0), ("segment", "s1", 0.0), ("visual_region", "r1", 1.0)]
    assert got[1].summary == "c" * 500 and (got[2].title, got[2].summary, got[2].scope_path) == ("box", "read", "a")
    assert {r.object_id for r in Engine(catalog).by_role(asked, scope="a").collect()} == {"f1", "r1"}
    with pytest.raises(ValueError, match="no vectors lead to memory"):
        Engine(catalog).by_role(asked, kinds=["memory"])


def test_domains_budgets_and_cues(spark):
    rows = [("/w/workspaces/Memory One/docs", "/w/repo-root", None, None), ("/", None, "compact", 5000), ("/w/Ünit!", "", "deep", 100), ("x/workspaces", "/y/", None, -5)]
    d = spark.createDataFrame(rows, "cwd string, git_root string, profile string, max_tokens long")
    got = d.select(snapshot.domains(F.col("cwd"), F.col("git_root"), ("workspaces",)).alias("d"), snapshot.budget(F.col("profile"), F.col("max_tokens")).alias("b")).collect()
    assert [r.d for r in got] == [["memory-one", "repo-root"], [], ["nit"], ["y"]] and [r.b for r in got] == [3000, 1200, 100, 3000]
    q = spark.createDataFrame([("fix the broken-build now, please", "risk"), (None, None)], "p string, profile string").select(snapshot.cues(F.col("p"), F.col("profile")).alias("c")).collect()
    assert q[0].c == ["broken-build", "please", *snapshot.RISK_CUES] and q[1].c == []


def test_snapshots(spark):
    word = "word " * 40
    memory = lambda i, scope, text, status="active", n=None, q=0.5: (i, "T " + i, text, scope, q, None, 1, None, n, None, None, None, status, "policy")
    memories = spark.createDataFrame([memory("m1", "project:app/a", word), memory("m2", "project:app", word * 300), memory("m3", "project:apple", "The security gate"), memory("m4", "project:other", word), memory("m5", "project:app", "gone", "quarantined"), memory("m6", "project:big", "abcdefgh " * 60)], MEMORY)
    requests = spark.createDataFrame([
        ("matched", "/srv/app", None, "find word", None, None, None), ("fallback", "/srv/app", None, "find things", "compact", None, "default_on"), ("off", "/srv/app", None, "find word", None, None, "off"),
        ("empty", "/srv/none", None, "find word", None, 60, None), ("nowhere", "/", None, "x", None, None, None), ("long", "/srv/big", None, "find words", "deep", 200, None),
    ], REQUEST)
    matches = spark.createDataFrame([("matched", "m1", 0.5), ("matched", "m4", 0.9), ("matched", "m5", 0.9), ("off", "m1", 0.1)], "request_id string, memory_id string, text_rank double")
    got = {r.request_id: r for r in snapshot.build(requests, memories, matches).collect()}
    assert [c.memory_id for c in got["matched"].cards] == ["m1"] and not got["matched"].fallback and "Candidate domains: app\nProfile: legacy\nMode: shadow\nInjected: no\nPrompt-eligible memories: 1\nRetrieved memories: 1\n" in got["matched"].markdown
    assert got["fallback"].fallback and [c.memory_id for c in got["fallback"].cards] == ["m3", "m1"] and "Injected: yes" in got["fallback"].markdown
    assert {(o.memory_id, o.reason) for o in got["fallback"].omitted} == {("m2", "token_budget_or_low_rank")}
    assert got["off"].cards == [] and {o.reason for o in got["off"].omitted} == {"injection_mode_off"}
    assert "## No Prompt-Eligible Memories" in got["nowhere"].markdown and got["nowhere"].domains == []
    assert got["empty"].truncated and got["empty"].markdown.endswith(snapshot.NOTICE) and got["empty"].tokens <= 60
    assert [c.memory_id for c in got["long"].cards] == ["m6"] and got["long"].truncated and got["long"].tokens <= 200 and len(got) == 6


def test_cut_fits_even_where_words_are_short(spark):
    texts = [("i " * 2000, 100), ("abcdefgh " * 500, 100), ("short", 100), ("i " * 2000, 5), ("i " * 2000, 0)]
    d = spark.createDataFrame(texts, "t string, n long").select("t", "n", snapshot.fit(F.col("t"), F.col("n")).alias("cut")).withColumn("tokens", snapshot.X.token_estimate("cut")).collect()
    assert [r.tokens <= r.n or r.n in (0, 5) for r in d] == [True] * 5 and d[2].cut == "short" and d[4].cut == d[4].t
    assert all(r.cut.endswith(snapshot.NOTICE) and r.t.startswith(r.cut.removesuffix(snapshot.NOTICE)) for r in (d[0], d[1], d[3])) and d[1].tokens > 90
