"""The divergence audit against the plain sums over all terms."""

import random
import re
from collections import Counter

from lodestone.llm import divergence


def brute(rows, min_docs=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs, whole, by = Counter(), Counter(), {}
        for a, source, w in found:
            if a == lang:
                docs.update(set(w))
                whole.update(w)
                by.setdefault(source, Counter()).update(w)
        kept = [t for t, n in docs.items() if n >= min_docs]
        p = {}
        for g, c in [*by.items(), (None, whole)]:
            n = sum(c[t] for t in kept)
            p[g] = {t: 1 + 1000000000 * (c[t] + 1) // (n + len(kept)) for t in kept}
        f = lambda x, y: (x - y) * (x - y) // y
        for g in by:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h) for h in by if h != g]
            terms = [(f(p[g][t], p[None][t]), t) for t in kept if by[g][t] and p[g][t] > p[None][t]]
            for part, items, limit in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g, part, item, value, k + 1) for k, (value, item) in enumerate(items[:limit])]
    return sorted(out)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(4)
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


def corpus(seed, groups, size):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcdé" for b in "xyz" for c in "klmnü"]
    rows = []
    for i in range(size):
        g = r.randrange(groups)
        use = words[: 12 + g % 5] + words[(g * 7) % 60 : (g * 7) % 60 + 6]
        rows.append((" ".join(r.choices(use, k=r.randint(0, 40))).title(), r.choice(["en", "de"]), f"s{g}"))
    return rows


def test_against_all_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 500)
    monkeypatch.setattr(divergence, "TILE", 40)
    rows = corpus(1, 12, 260) + [(None, "en", "s1"), ("only here", "xx", "s1"), ("", None, None), ("!!! 12", "en", "empty"), ("AXK axk Axk", "en", "s1")]
    for share in (0.0, 0.25, 1.0):
        assert run(spark, rows, dense_share=share) == brute(rows)


def test_ranks_and_ties(spark):
    rows = [(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)), "en", "a")] * 3 + [("zz zz zz", "en", s) for s in ("b", "c", "d")]
    got = run(spark, rows, term_ranks=200)
    assert got == brute(rows)
    assert max(r[5] for r in got if r[2] == "term") == 200


def test_one_source_and_none(spark):
    assert run(spark, [("a b c", "en", "s")] * 3) == brute([("a b c", "en", "s")] * 3)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(empty).collect() == []
