"""Null ids in archives, long contaminated texts, models in workers, exact terms of the audit."""

import time

from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, queries, warc
from lodestone.llm.common import work_dir


def test_null_id_is_no_string_null(spark):
    pages = spark.createDataFrame([(None, "u", "<p>a</p>"), ("null", "u", "<p>b</p>"), ("*", "u", "<p>b</p>"), ("%2A", "u", "<p>c</p>"), ("null", "v", "<p>c</p>")], "page_id string, url string, html string")
    path = work_dir(spark)
    got = warc.read_warc(warc.write_warc(pages, path), path, payload=False)
    ids = sorted(((r.null_id, "" if r.null_id else r.record_id), r.record_type, r.refers_to) for r in got.collect())
    assert ids == [((False, "%2A"), "response", None), ((False, "*"), "response", None), ((False, "null"), "revisit", "%2A"), ((False, "null"), "revisit", "*"), ((True, ""), "response", None)]


def test_remove_is_linear_in_the_text(spark):
    item = " ".join(f"q{i}" for i in range(10))
    text = ", ".join(f"{item} " + " ".join(f"w{i}x{j}" for j in range(10)) for i in range(4000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2"), (3, item + "!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    decontam.remove(docs.where("doc_id > 1"), items).collect()
    start = time.time()
    got = {r.doc_id: r.text for r in decontam.remove(docs, items).collect()}
    assert time.time() - start < 20 and set(got) == {1, 2}
    assert [w.strip(",") for w in got[1].split() if w.strip(",")] == [f"w{i}x{j}" for i in range(4000) for j in range(10)]


def test_model_is_sent_as_plain_values(spark):
    model = langid.fit([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)
    docs = spark.createDataFrame([(1, "the dog"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}[2] == "und"
    assert langid.identify(docs, None).where(F.col("lang_pred") != "und").isEmpty()


def test_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
