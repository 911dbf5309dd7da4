"""run() on the smallest driver tables against brute force for each stage."""

import hashlib
import os
import re

import pytest
from tokenizers import Tokenizer

import public_tokenizers
from test_native import low, quality_brute
from test_substring import covered

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def near(rows):
    sets = []
    for _, t in rows:
        w = low(t).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(rows[i][0]), top(rows[j][0])))
                parent[y] = x
    return [r for r in rows if top(r[0]) == r[0]]


def cut(rows):
    data = [t.encode() for _, t in rows]
    flags = covered(data, 200)
    return [(d, bytes(x for x, f in zip(b, fs) if not f).decode("utf-8", "ignore")) for (d, _), b, fs in zip(rows, data, flags)]


def clean(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(low(t))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    out = []
    for d, t in rows:
        w = word.findall(low(t))
        hit = {j for i in range(len(w)) for n in sizes if tuple(w[i : i + n]) in windows and i + n <= len(w) for j in range(i, i + n)}
        if hit and len(hit) == len(w):
            continue
        parts, at = [], 0
        for i, m in enumerate(word.finditer(t)):
            parts.append(t[at : m.start()] + ("" if i in hit else m[0]))
            at = m.end()
        out.append((d, "".join(parts) + t[at:]))
    return out


def test_pipeline(spark):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rows = [(r[0], r[9]) for r in quality_brute(docs, 20, 0.01, 30) if r[8]]
    rows = clean(cut(near(rows)), items)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert len(got) == len(want) > 50
    assert [x for x in sorted(got) if x not in set(want)][:2] == []


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DIR).columns == docs.columns
