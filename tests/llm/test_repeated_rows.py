"""Repeated rows and rows without an id in the near-dedup stage: one row of each group stays, with its text."""

import random

import corpus_pipeline


def text(seed):
    r = random.Random(seed)
    return " ".join(r.choices([f"w{i}" for i in range(3000)], k=120))


def test_one_row_stays(spark):
    rows = [(1, text(1), "s", 1)] * 3 + [(2, text(2), "s", 1), (3, text(2), "s", 1)] + [(None, text(3), "s", 1)] * 2
    rows += [(4, text(4), "s", 1), (None, text(4), "s", 1), (None, text(4) + " end", "s", 1), (5, text(5), "s", 1)] + [(None, None, "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").repartition(4)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, "")
    want = [(1, text(1)), (2, text(2)), (4, text(4)), (5, text(5)), (None, None), (None, None), (None, text(3))]
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted(want, key=str)
    cut = corpus_pipeline.substring_stage(spark, kept, "").collect()
    assert sorted(((x.doc_id, x.text) for x in cut), key=str) == sorted(want, key=str)


def test_ids_over_the_whole_range(spark):
    rows = [((1 << 63) - 1, text(1), "s", 1), (-(1 << 63), text(2), "s", 1), (None, text(3), "s", 1), (None, text(3), "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    assert sorted(x.text for x in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(map(text, (1, 2, 3)))
