"""Substring dedup over words and bytes against brute force."""

import random

import pytest

from lodestone.llm.substring import dedup_substrings
from lodestone.llm.suffix import dedup_bytes


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß", "🙂"]
    passage = " ".join(r.choices(vocabulary, k=70))
    base = [" ".join(r.choices(vocabulary, k=r.randint(0, 150))) for _ in range(n)]
    texts = list(base)
    for _ in range(25):  # near copies
        w = r.choice(base).split()
        if w:
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(15):
        w = r.choice(base).split()
        p = passage.split()
        a, b = sorted(r.sample(range(71), 2))
        w[len(w) // 2 : len(w) // 2] = p[a:b]
        texts.append("  ".join(w))
    texts += [base[1]] * 5 + ["", None, "a " * 400, "x" * 900, "a " * 120 + "b", passage, passage + " end"]
    return [(i if i % 17 else None if i else 0, t, "other") for i, t in enumerate(texts)] + [(3, texts[3], "other")]


def covered(items, size):
    """For each list, a flag per item: is it in a window of ``size`` that also starts elsewhere?"""
    seen = {}
    for x in items:
        for i in range(len(x) - size + 1):
            k = tuple(x[i : i + size])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for x in items:
        f = [False] * len(x)
        for i in range(len(x) - size + 1):
            if seen[tuple(x[i : i + size])] > 1:
                f[i : i + size] = [True] * size
        out.append(f)
    return out


@pytest.mark.parametrize("window,seed", [(8, 1), (35, 2), (2, 3)])
def test_words(spark, window, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept) for r in dedup_substrings(docs, window).collect())
    words = [(t or "").encode().split() for _, t, _ in rows]
    flags = covered(words, window)
    want = sorted((d if d is not None else -1, len(w), sum(f), b" ".join(x for x, y in zip(w, f) if not y).decode()) for (d, _, _), w, f in zip(rows, words, flags))
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:2] == []


@pytest.mark.parametrize("length,seed,spread", [(40, 1, 256), (200, 2, 256), (64, 3, 1)])
def test_bytes(spark, length, seed, spread):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h1 string").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in dedup_bytes(docs, length, spread_over=spread).collect())
    data = [(t or "").encode() for _, t, _ in rows]
    flags = covered(data, length)
    want = sorted(
        (d if d is not None else -1, len(w), sum(f), sum(a and not b for a, b in zip(f, [False, *f])), bytes(x for x, y in zip(w, f) if not y), sum(f)) for (d, _, _), w, f in zip(rows, data, flags)
    )
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b][:2] == []


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(docs).count() == 0
    assert dedup_bytes(docs).count() == 0
