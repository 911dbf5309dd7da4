"""The registered queries over the smallest driver tables; columns with clashing names, ids of other types, long texts."""

import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, minhash, quality, queries, substring, suffix, warc
from lodestone.llm.common import work_dir

DIR = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
COLUMNS = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7_html_text": {"page_id", "url", "text", "n_chars"},
    "op8_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
}


@data
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    table, key = ("pages", "page_id") if name in ("op6_warc", "op7_html_text") else ("documents", "doc_id")
    source = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key, "html" if table == "pages" else "text").collect()}
    df = queries.QUERIES[name](spark, DIR)
    rows = df.collect()
    assert COLUMNS[name] <= set(df.columns) and sorted(r[key] for r in rows) == sorted(source)
    for r in rows:
        text = source[r[key]] or ""
        if name == "op1_language_id":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
            assert (r.lang_pred == "und") == (not any(map(str.isalpha, text)))
        elif name == "op3_decontamination":
            assert r.contaminated == (r.n_hit > 0) == (r.n_items > 0) and (r.n_items or r.items_sha256 == hashlib.sha256(b"").hexdigest())
        elif name == "op6_warc":
            assert r.payload_bytes == len(text.encode()) and (r.record_type == "revisit") == (r.refers_to is not None)
        elif name == "op8_bpe":
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        elif name == "op10_suffix_array_dedup":
            assert r.n_bytes == len(text.encode())


def prose(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n))


def test_clashing_names(spark):
    r = random.Random(1)
    names = ["tri", "pairs", "_w", "_lines", "_b", "_freq", "_host", "kept", "n_words", "h1", "h2", "spans", "found", "_k1", "_null", "_kept", "row", "t", "null"]
    rows = [(i, prose(r, 80) + "\n" + prose(r, 60), "s", *range(len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    items = spark.createDataFrame([("a", " ".join(rows[0][1].split()[:10]))], "item_id string, text string")
    want = sorted(tuple(x) for x in docs.drop("text").collect())
    for out in (quality.clean(docs), suffix.clean(docs), decontam.remove(docs, items), minhash.keep_one_row(docs)):
        assert out.columns == docs.columns
        assert sorted(tuple(x) for x in out.drop("text").collect()) == want
    assert "h1" in substring.dedup_substrings(docs).columns


def test_ids_of_other_types(spark):
    r = random.Random(2)
    base = prose(r, 200)
    rows = [("x1", base), ("x0", base + " end"), ("y", prose(r, 100)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {x.doc_id: (x.component_id, x.kept) for x in minhash.near_duplicates(docs).collect()}
    assert got == {"x1": ("x0", False), "x0": ("x0", True), "y": ("y", True), None: (None, True)}
    assert sorted(x.doc_id or "" for x in minhash.keep_one_row(docs).collect()) == ["", "x0", "y"]
    pages = spark.createDataFrame([("p 0>", "u", "a"), ("p1", "u", "a"), ("p1", "u", "a")], "page_id string, url string, html string")
    path = work_dir(spark)
    read = warc.read_warc(warc.write_warc(pages, path), path).collect()
    assert sorted((x.record_id, x.record_type, x.refers_to) for x in read) == [("p 0>", "response", None), ("p1", "revisit", "p 0>"), ("p1", "revisit", "p 0>")]


def test_group_of_near_copies(spark):
    """Copies with few to many changed words around one text, against all pairs."""
    r = random.Random(5)
    base = prose(r, 150).split()
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(r.randrange(0, 26)):
            w[r.randrange(150)] = prose(r, 1)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(148)} for t in texts]
    parent = list(range(160))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(160):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: top(i) for i in range(160)} and 20 < len(set(got.values())) < 160


def test_many_languages(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçøå"
    rows = []
    for lang in range(40):
        alphabet = r.sample(letters, 6)
        rows += [(len(rows) + i, " ".join("".join(r.choices(alphabet, k=5)) for _ in range(30)), f"l{lang}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_rows(docs, F.lit(True), per_lang=800, max_rows=480)
    assert len({g for _, g in sample}) == 40 and len(sample) <= 960
    model = langid.fit(sample)
    assert model.layer is not None and model.table.shape[1] == langid.DIM
    got = langid.identify(docs, model).where("lang_pred = lang").count()
    assert got > 0.9 * len(rows)
    assert langid.identify(docs.limit(0), model).count() == 0 and langid.training_rows(docs.limit(0), F.lit(True)) == []


def test_long_texts(spark):
    r = random.Random(4)
    passage = prose(r, 60)
    long = [prose(r, 20000) + " " + passage + " " + prose(r, 10) for _ in range(2)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(long)], "doc_id long, text string, source string")
    assert [x.n_removed for x in substring.dedup_substrings(docs).collect()] == [60, 60]
    assert all(x.n_removed >= len(passage) for x in suffix.dedup_bytes(docs).collect())
    assert quality.assess(docs).where("kept").count() == 2
    assert [x.n_hit for x in decontam.contamination(docs, spark.createDataFrame([("a", passage)], "item_id string, text string")).collect()] == [60, 60]
    assert minhash.near_duplicates(docs).where("kept").count() == 2
