"""Quality rules, decontamination and sharding against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, quality, sharding


def differ(got, want):
    """Whether two lists of rows differ, as a short text; pytest's own comparison of long values takes minutes."""
    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    return "".join(f"\n{side} {x[:400]}" for side, c in (("got", a - b), ("want", b - a)) for x in sorted(c.elements())[:3])


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def quality_rows():
    r = random.Random(4)
    words = [f"w{i}" for i in range(500)] + ["#é", "a|b", "x"]
    out = []
    for i in range(120):
        lines = [" ".join(r.choices(words, k=r.randint(3, 25))) for _ in range(r.randint(1, 9))]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines) + 1), f"Share  this page {i}!")
        if r.random() < 0.2:
            lines.append(lines[0])
        if r.random() < 0.2:
            lines += [" ".join(["spam ham eggs"] * 30)]
        out.append((i, "\n".join(lines), f"s{i % 2}" if i % 7 else None, 5))
    out += [(900 + i, "\n".join(["Share this page 7!"] + [f"hello w{i}"] + ["word " * 3 + str(i)]) + " u" * 60, "s0", 1) for i in range(5)]
    return out + [(1000, None, "s0", 0), (1001, "", None, 0), (None, " \t\n ", "s1", 4), (5, out[5][1], out[5][2], 5), (1002, "\x0b\r ".join(["many " * 40] * 3), "s1", 2)]


def quality_brute(rows, min_docs, share, min_left):
    norm = lambda l: re.sub(r"[ \t-\r]+", " ", re.sub("[0-9]+", "0", l.lower())).strip(" ")
    split = lambda t: [l for l in (t or "").split("\n") if re.search(r"[^ \t-\r]", l)]
    docs, marks = Counter(), defaultdict(set)
    for _, t, s, _ in rows:
        docs[s or ""] += 1
        ls = split(t)
        for l in ls:
            marks[s or "", norm(l)].add(t)
    often = {k for k, v in marks.items() if len(v) > min_docs and len(v) > share * docs[k[0]]}
    out = []
    for d, t, s, _ in rows:
        w = re.findall(r"[^ \t-\r]+", t or "")
        ls = split(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        c = Counter(tri)
        rep = {j for i, x in enumerate(tri) if c[x] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        gone = sum(len(re.findall(r"[^ \t-\r]+", l)) for l in ls if (s or "", norm(l)) in often)
        kept = not failed and 100 * (len(w) - gone) >= min_left * len(w)
        text = t if not gone else "\n".join(l for l in t.split("\n") if not (re.search(r"[^ \t-\r]", l) and (s or "", norm(l)) in often))
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(rep), failed, gone, kept, text))
    return out


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_quality(spark, broadcast_rows):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept int").repartition(4)
    want = quality_brute(rows, 8, 0.05, 30)
    got = quality.judge(docs.drop("kept"), min_docs=8, share=0.05, broadcast_rows=broadcast_rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept", "cleaned")
    assert differ(map(tuple, got.collect()), want) == ""
    assert any(w[7] for w in want) and any(w[8] for w in want)
    kept = quality.assess(docs, min_docs=8, share=0.05, broadcast_rows=broadcast_rows).where("kept").count()
    assert kept == quality.clean(docs, min_docs=8, share=0.05, broadcast_rows=broadcast_rows).count() == sum(w[8] for w in want)
    assert quality.assess(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_windows", [10_000, 0])
def test_decontam(spark, broadcast_windows):
    r = random.Random(8)
    vocabulary = ["the", "Of", "É", "ß9", "a1", "漢"] + [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 12, 15, 20])))) for i in range(12)] + [(12, None), (13, "--"), (None, "zz top zz"), (1, "Alpha beta!")]
    rows = []
    for i in range(80):
        w = r.choices(vocabulary, k=r.randint(0, 80))
        if r.random() < 0.5:
            x = (r.choice(items)[1] or "").split()
            a = r.randint(0, max(0, len(x) - 2))
            w[len(w) // 2 : len(w) // 2] = x[a:]
        rows.append((i, r.choice([" ", "\n", "-"]).join(w).replace("v1 ", "V1 ! "), 3))
    rows += [(100, None, 3), (101, "", 3), (None, "Zz TOP zz", 3), (7, rows[7][1], 3), (102, "ALPHA-Beta alpha", 3)]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for a in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[a : a + 10])].add("null" if i is None else str(i))
    want, left = [], []
    for d, t, _ in rows:
        w, hit, found = split(t), set(), set()
        for a in range(len(w)):
            for n in range(1, 11):
                if a + n <= len(w) and tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        want.append((d, len(w), len(hit), sorted(found)))
        if not hit or len(hit) < len(w):
            left.append((d, [x for i, x in enumerate(w) if i not in hit]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, broadcast_windows=broadcast_windows).collect()
    assert differ(((x.doc_id, x.n_words, x.n_hit, x.found) for x in got), want) == ""
    out = decontam.remove(docs.drop("found"), bench, broadcast_windows=broadcast_windows).collect()
    assert differ(((x.doc_id, split(x.text)) for x in out), left) == ""
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_sharding(spark):
    r = random.Random(2)
    texts = [f"t{i} é" for i in range(900)] + ["big"] * 700 + [f"g{i % 60}" for i in range(500)] + [None] * 30 + [""] * 3
    r.shuffle(texts)
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)] + [(1, texts[1], 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(4)
    got = sharding.shard(docs).collect()
    assert differ(((x.doc_id, x.size, x.text_crc32) for x in got), ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)) == ""
    sizes = Counter(x.shard for x in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(x.slot for x in got if x.shard == s) == list(range(n))
    places = defaultdict(set)
    for x in got:
        places[x.text_crc32].add(x.shard)
    groups = [zlib.crc32(f"g{i}".encode()) for i in range(60)]
    assert sum(len(places[g]) == 1 for g in groups) >= 58
    assert {(x.law, x.grown_shard) for x in got} == {("rows", None)}
    assert sharding.shard(docs.limit(0)).count() == 0
    assert sorted(x.slot for x in sharding.shard(docs.limit(3)).collect()) == [0, 0, 0]
