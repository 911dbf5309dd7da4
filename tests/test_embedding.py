"""Embedding with encoders that fail, are busy or give nonsense; candidates in order; secrets; memories with one key."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import embedding
from lodestone.sources import agent_exports


def test_encoders_that_fail(spark):
    def encoder(texts):
        if any("broken" in t for t in texts):
            raise RuntimeError("no service")
        if any("short" in t for t in texts):
            return [[1.0]] * len(texts)
        if any("busy" in t for t in texts):
            raise embedding.Busy(0.0)
        return [[float(len(t)), 1.0] for t in texts]

    rows = [(1, "abc"), (2, "broken"), (3, "short"), (4, "busy"), (5, None), (6, " ")]
    d = spark.createDataFrame(rows, "id int, `a.text` string").coalesce(1)
    got = {r.id: (list(r.embedding), r.embedding_error) for r in embedding.embed(d, "a.text", encoder, dimension=2, batch=1, attempts=2).collect()}
    assert got == {1: ([3.0, 1.0], None), 2: ([0.0, 0.0], "RuntimeError: no service"), 3: ([0.0, 0.0], "wrong shape"), 4: ([0.0, 0.0], "busy after 2 attempts"), 5: ([0.0, 0.0], "no text"), 6: ([0.0, 0.0], "no text")}
    start = time.monotonic()
    embedding.embed(d.where("id < 5"), "a.text", lambda t: [[0.0, 0.0]] * len(t), dimension=2, batch=1, pause=0.3).collect()
    assert time.monotonic() - start > 0.8
    assert embedding.embed(d.where("false"), "a.text", encoder).collect() == []


def test_hash_vectors_are_near_for_near_texts():
    a, b, c = (np.array(v) for v in embedding.hash_encoder()(["the server is down again", "the server is down", "fresh bread and butter"]))
    assert abs(a @ a - 1) < 1e-9 and a @ b > 0.7 > a @ c


def test_candidates(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "segment": table([("default", f"s{i}", "x" * 9000 if i else " ", i) for i in range(5)], "tenant string, segment_id string, content string, created_at int"),
        "fact": table([("default", "f1", "p", None)], "tenant string, fact_id string, predicate string, object_value string"),
        "fact_evidence": table([("f1", None, 1), ("f1", "quote", 2)], "fact_id string, excerpt string, created_at int"),
        "procedure": table([("default", "p1", None, None, None, 1), ("default", "p2", "T", None, "retired", 1)], "tenant string, procedure_id string, title string, summary string, lifecycle_state string, updated_at int"),
        "media_artifact": table([("default", "m1", None, {"alt_text": "alt"}, 1)], "tenant string, media_id string, caption string, media_meta map<string,string>, created_at int"),
        "visual_region": table([("default", "r1", "m1", "label", None, None, 1), ("default", "r2", "gone", "label", "o", None, 1)], "tenant string, region_id string, media_id string, label string, ocr_text string, region_meta map<string,string>, created_at int"),
        "embedding_index": table([("text", "s4", None, None, None, None), ("evidence", None, "f9", None, None, None)], "role string, segment_id string, fact_id string, procedure_id string, media_id string, region_id string"),
    }
    got = sorted((r.role, r.target_id, len(r.text)) for r in embedding.candidates(tables, 2).collect())
    assert got == [("evidence", "f1", 2), ("evidence", "f1", 5), ("media_caption", "m1", 3), ("text", "s1", 23), ("text", "s2", 23), ("visual_caption", "r1", 5)]


def test_secrets(spark):
    said = {
        "token = abcdefghijklmnopqrstu rest": "[REDACTED:token] rest", "eyJhbGciOi.eyJzdWIi.c2ln": "[REDACTED:jwt]", "machine h login u password p1": "[REDACTED:netrc]", "npm_" + "a" * 36: "[REDACTED:npm_token]", "A" * 40: "[REDACTED:high_entropy]",
        "-----BEGIN RSA PRIVATE KEY-----\nx\ny\n-----END RSA PRIVATE KEY-----.": "[REDACTED:private_key].", "plain text": "plain text",
    }
    d = spark.createDataFrame([(k,) for k in said], "t string").select("t", X.redact_secrets("t").alias("r"))
    assert {r.t: r.r for r in d.collect()} == said and len(X.SECRETS) == 19


def test_auto_memories_of_one_key_are_an_error(spark):
    files = spark.createDataFrame([("a/feedback_x y.md", "---\nname: N\n---\nbody"), ("a/feedback_x_y.md", "b"), ("a/MEMORY.md", "index"), ("a/none.md", None)], "path string, text string")
    with pytest.raises(Exception, match="two files have the key pai_auto_memory:feedback_x_y"):
        agent_exports.auto_memories(files)[0].collect()
    facts, segments = agent_exports.auto_memories(files.where(F.col("path") != "a/feedback_x_y.md"))
    assert {(f.predicate, f.value, f.kind) for f in facts.collect()} == {("pai_auto_memory_type", "feedback", "state"), ("pai_auto_memory_content", "body", "constraint"), ("pai_auto_memory_type", "auto", "state")}
    assert {s.label: s.content.split("\n")[0] for s in segments.collect()} == {"N": "Slug: feedback_x y", "none": "Slug: none"}
