"""Importance resampling against a plain computation."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import resample


def features(text, ngram=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, ngram=2, min_words=20, percent=25):
    found = [(i, *features(t, ngram)) for i, t in docs]
    s, t = Counter(x for _, _, f in found for x in f), Counter(x for y in target for x in features(y, ngram)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_t * 0 + all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000)))) for b in s}
    rows = []
    for i, w, f in found:
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= min_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(fit) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(fit[:drawn])}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def texts(seed, n):
    r = random.Random(seed)
    words = [r.choice(["Ab", "c", "É", "d1", "日"]) + str(k % 37) for k in range(60)]
    return [(i, " ".join(r.choices(words, k=r.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(n)]


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(*x, "k", 1) for x in docs], "doc_id long, text string, key string, b0 int").repartition(5)
    t = spark.createDataFrame([(str(i), x) for i, x in enumerate(target)], "item_id string, text string")
    return sorted((tuple(r) for r in resample.resample(d, t, **options).collect()), key=repr)


def test_against_plain_sums(spark):
    docs = texts(1, 300) + [(None, "one two"), (1000, None), (1001, ""), (1002, "--- ..."), (1003, "w " * 5000)]
    target = [t for _, t in texts(2, 20)] + [None, ""]
    assert run(spark, docs, target) == brute(docs, target)
    assert run(spark, docs, target, ngram=3, percent=60) == brute(docs, target, ngram=3, percent=60)
    assert run(spark, docs, []) == brute(docs, [])


def test_repeated_rows_and_ties(spark):
    text = " ".join("word%d" % i for i in range(25))
    docs = [(7, text)] * 8 + [(8, text)] * 4
    got = run(spark, docs, [text])
    assert [r[:4] for r in got] == [r[:4] for r in brute(docs, [text])]
    assert sorted(r[4] for r in got if r[4]) == [1, 2, 3]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(docs, docs).collect() == []


def test_ranks_over_partitions(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id").repartition(7)
    order = [F.desc("v"), F.asc("id")]
    got = [(r["rank"], r["id"]) for r in resample.ranked(rows, order).orderBy("rank").collect()]
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert got == list(enumerate(want, 1))
