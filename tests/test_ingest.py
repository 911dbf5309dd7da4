"""Loading the same items again, changed items, rejected and repeated facts, oversized contents."""

from pyspark.sql import functions as F

from lodestone.catalog import schema
from lodestone.operators import ingest, review


def fact(subject, value, kind="cause", confidence=0.9, segments=(0,), predicate="is"):
    return (subject, predicate, value, kind, "deterministic", confidence, list(segments), "2024-03-02", "2024-03-01", None)


def item(key, facts, content="text", kind="note", entities=(("gw", "device"),)):
    return ("t", key, kind, "p", content, None, ("incident", key, "2024-03-01", None, "P1", "resolved", None), list(entities), [(0, "a", "x" * 700, 1, 9), (1, "b", "", 10, 10)], facts)


def load(spark, tables, items, **options):
    keep = lambda d: spark.createDataFrame(d.collect(), d.schema)
    out = ingest.load(tables, spark.createDataFrame(items, ingest.ITEM), F.lit("2024-05-01").cast("timestamp"), keep=keep, **options)
    return {k: keep(v) for k, v in out.items()}


def test_load(spark):
    empty = {name: spark.createDataFrame([], schema(name)) for name in ingest.TABLES}
    items = [item("a", [fact("gw", "down"), fact("gw", "down"), fact("gw", "down", "impact"), fact(" ", "x"), fact("node", "gw", segments=(0, 0, 1, 7)), fact("gw", None, confidence=2.0)]), item("b", [fact("gw", "down")], kind="pai_auto_memory"), item("c", None, None)]
    one = load(spark, empty, items)
    facts = {(r.predicate, r.object_value, r.fact_kind): r for r in one["fact"].collect()}
    assert len(facts) == one["fact"].count() == 3 and {r.reject_reason for r in one["rejected"].collect()} == {"blank subject", "confidence out of range"}
    r = facts["is", "gw", "cause"]
    assert r.valid_from < r.valid_to and r.priority == 2 and r.object_entity_id == facts["is", "down", "cause"].subject_entity_id
    assert {(x.entity_type, x.canonical_name) for x in one["entity"].collect()} == {("device", "gw"), ("config_item", "node")}
    proof = one["fact_evidence"].collect()
    assert len(proof) == 3 and all(len(x.excerpt) == 500 and x.excerpt_hash for x in proof)
    assert one["artifact"].count() == one["extraction_run"].count() == one["episode"].count() == 3 and one["segment"].count() == 6
    assert [x.reason for x in one["review_queue"].collect()] == ["assistant_memory_import_review"]
    # Loaded again, nothing changes but the facts' first source may not move.
    two = load(spark, {k: one[k] for k in ingest.TABLES}, items)
    assert {k: two[k].count() for k in ingest.TABLES} == {k: one[k].count() for k in ingest.TABLES}
    assert {x.fact_id for x in two["fact"].collect()} == {x.fact_id for x in one["fact"].collect()}
    # A changed item replaces what it brought; others stay. A fact that is there already is touched.
    support = spark.createDataFrame([("m", facts["is", "gw", "cause"].fact_id, None), ("m", None, "other")], "memory_id string, fact_id string, episode_id string")
    base = {**{k: one[k] for k in ingest.TABLES}, "memory_support": one["memory_support"].unionByName(support, allowMissingColumns=True)}
    three = load(spark, base, [item("a", [fact("gw", "up")]), item("d", [fact("gw", "up")])])
    assert {x.object_value for x in three["fact"].collect()} == {"up"} and three["fact"].count() == 1
    assert [x.episode_id for x in three["memory_support"].collect()] == ["other"] and three["artifact"].count() == 4
    # Too large: an artifact and a review, no facts.
    big = load(spark, empty, [item("a", [fact("gw", "down")], "y" * 50), item("b", [fact("gw", "down")])], max_bytes=20)
    assert {(x.source_key, x.preservation_state) for x in big["artifact"].collect()} == {("a", "pending_escalation"), ("b", "discovered")}
    assert big["fact"].count() == 1 and [x.reason for x in big["review_queue"].collect()] == [ingest.TOO_LARGE]


def test_review_edges(spark):
    d = spark.createDataFrame([("s", None, "Text ", 0.4, [(None, None)]), ("s", "x", "Text", float("nan"), [("F1", None), (None, "e")]), ("s", "X ", "text", 7.0, [(None, "E"), (" f1", "")])], "subject_id string, scope_path string, statement string, confidence double, evidence array<struct<fact_id:string,episode_id:string>>")
    rows = review.beliefs(d, "T").collect()
    assert len(rows) == 2 and rows[0].fingerprint == rows[1].fingerprint and sorted(r.confidence for r in rows) == [0.5, 1.0]
    m = spark.createDataFrame([("m/1", None, "\n\n first token=abcdefghijkl \nmore", "published"), ("m2", "A \"b\"", None, "draft")], "memory_id string, title string, narrative string, lifecycle_state string").withColumns({"scope_path": F.lit(None).cast("string"), "support_count": F.lit(None).cast("int"), "confidence": F.lit(0.25), "contradiction_count": F.lit(2)})
    none = spark.createDataFrame([], "memory_id string, note_path string, content_hash string")
    note = review.notes(m, none).collect()
    assert [n.file_name for n in note] == ["untitled_memory-m1.md"] and "abcdefghijkl" not in note[0].body and 'description: "first token=[REDACTED]"' in note[0].body
    done = spark.createDataFrame([("m/1", note[0].file_name, note[0].content_hash)], none.schema)
    assert review.notes(m, done).count() == 0
