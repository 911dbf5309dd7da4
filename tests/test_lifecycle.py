"""Feedback against a plain loop, folded in buckets; status changes, backfill, cues; conflicts by class against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.scores import OVERLAY_DELTAS
from lodestone.operators import lifecycle, mining

ROW = "tenant string, target_kind string, target_id string, lifecycle_status string, salience double, strength double, stability double, quality double, support_count int, contradiction_count int, lock_version int"


def test_feedback(spark):
    r = random.Random(1)
    signals = list(OVERLAY_DELTAS)
    events = [("t", "fact", r.choice("abc"), r.choice(signals), i) for i in range(300)] + [("t", "fact", "once", "user_corrected", 0)]
    known = spark.createDataFrame([("t", "fact", "a", "active", 0.9, 0.1, 0.0, 1.0, 3, 4, 7), ("t", "fact", "idle", "retired", 0.2, 0.2, 0.2, 0.2, 0, 0, 1)], ROW)
    want = {k: [0.5] * 4 for k in ("b", "c", "once")} | {"a": [0.9, 0.1, 0.0, 1.0], "idle": [0.2] * 4}
    for _, _, k, s, _ in events:
        want[k] = [min(1.0, max(0.0, x + d)) for x, d in zip(want[k], OVERLAY_DELTAS[s])]
    df = spark.createDataFrame(r.sample(events, len(events)), "tenant string, target_kind string, target_id string, signal string, n int")
    for bucket in (None, F.floor(F.col("n") / 9)):
        out, moved = lifecycle.feedback(known, df, ("n",), bucket)
        rows = {x.target_id: x for x in out.collect()}
        assert set(rows) == set(want) and moved.count() == 16
        for k, w in want.items():
            assert [rows[k][s] for s in lifecycle.SCORES] == pytest.approx(w)
        assert rows["a"].lock_version == 7 + sum(e[2] == "a" for e in events) and rows["idle"].lifecycle_status == "retired" and rows["once"].contradiction_count == 1 and rows["once"].lifecycle_status == "review_required"
    assert lifecycle.feedback(known, df.where("false"), ("n",))[0].count() == 2
    with pytest.raises(Exception, match="unknown signal"):
        lifecycle.feedback(known, df.withColumn("signal", F.lit("nope")), ("n",))[0].collect()


def test_cues_and_status(spark):
    e = spark.createDataFrame([("t", "fact", "a", [(" Disk ", None), ("disk", "goal"), ("", None), (None, None)] + [(f"c{i}", "tool") for i in range(40)]), ("t", "fact", "b", None)], "tenant string, target_kind string, target_id string, cues array<struct<text:string,type:string>>")
    none = spark.createDataFrame([], "tenant string, target_kind string, target_id string, cue_hash string, cue_text string, cue_type string, usefulness double")
    first = lifecycle.cues(e, none)
    rows = first.collect()
    assert len(rows) == 1 + 21 and lifecycle.cues(e, spark.createDataFrame(rows, none.schema).withColumn("usefulness", F.lit(0.9))).where("usefulness = 0.9").count() == 22
    known = spark.createDataFrame([("t", "fact", "a", "active", 0.5, 0.5, 0.5, 0.5, 0, 0, 0)], ROW)
    asked = spark.createDataFrame([("t", "fact", "a", "suppressed", 1), ("t", "fact", "a", "retired", 2), ("t", "fact", "z", "suppressed", 1)], "tenant string, target_kind string, target_id string, status string, asked_at int")
    out, audit = lifecycle.set_status(known, asked)
    assert {(x.target_id, x.lifecycle_status, x.lock_version) for x in out.collect()} == {("a", "retired", 2), ("z", "suppressed", 1)} and audit.count() == 2
    objects = spark.createDataFrame([("t", k) for k in "abcc"], "tenant string, fact_id string")
    assert [x.target_id for x in lifecycle.missing(known, "fact", objects, "fact_id", 1).collect()] == ["b"]


def test_conflict_counts(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "", "s"]), r.choice([None, "T", "t", "u"]), r.choice([None, "", "x", "y"])) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, scope string, title string, text string")
    norm = {i: ((s or ""), (a or "").lower(), (x or "")) for i, s, a, x in rows}
    got = {x.id: (x.class_id, x.n_conflicts) for x in mining.conflict_counts(d, "id", ["scope"], "title", "text").collect()}
    for i, (s, a, x) in norm.items():
        same = [j for j, n in norm.items() if n[:2] == (s, a)]
        assert got[i] == (min(j for j in same if norm[j][2] == x), sum(norm[j][2] != x for j in same))
