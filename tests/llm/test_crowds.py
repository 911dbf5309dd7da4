"""Groups that hold several editions of a text, each with many copies: the same components as all pairs, without making them."""

import itertools
import random

import pytest

from lodestone.llm import minhash


def editions(r, kinds, copies, words=300, share=0.67):
    """``kinds`` editions that differ in the same third of a text, each with ``copies`` copies of a few other words."""
    base = [f"b{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(kinds):
        text = base if k == 0 else base[: int(words * share)] + [f"e{k}x{i}" for i in range(words - int(words * share))]
        for _ in range(copies):
            t = list(text)
            for _ in range(r.randrange(1, 4)):
                t[r.randrange(len(t))] = f"n{r.randrange(10**9)}"
            out.append(" ".join(t))
    r.shuffle(out)
    return out


def brute(texts, size, percent):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize(("kinds", "copies"), [(2, 120), (5, 40)])
def test_pairs_grow_with_the_copies(spark, monkeypatch, kinds, copies):
    texts = editions(random.Random(kinds), kinds, copies)
    texts += ["one two three four five"] * 3 + ["", "lonely words that nobody shares at all"]
    made = []
    materialize = minhash.materialize

    def counted(df):
        out = materialize(df)
        if "x_id" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, size=3, percent=85).collect()}
    want = brute(texts, 3, 85)
    empty = texts.index("")
    assert got == want and got[empty] == empty
    assert len(set(got.values())) == kinds + 3 and sum(made) <= 4 * len(texts)


def test_a_chain_between_crowds_is_found(spark):
    r = random.Random(9)
    a = [f"a{i}" for i in range(200)]
    b = a[:170] + [f"b{i}" for i in range(30)]
    middle = a[:185] + [f"b{i}" for i in range(15)]
    texts = []
    for t in (a, b):
        for _ in range(30):
            c = list(t)
            c[r.randrange(150)] = f"n{r.randrange(10**9)}"
            texts.append(" ".join(c))
    texts.append(" ".join(middle))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(docs, size=3, percent=85).collect()} == brute(texts, 3, 85)
