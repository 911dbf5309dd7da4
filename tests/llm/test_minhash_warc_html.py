import base64
import gzip
import hashlib
import random
import re

import pytest

from lodestone.llm import html_text, minhash, warc
from lodestone.llm.common import connected_components, work_dir


def short(got, want):
    diff = [(a, b) for a, b in zip(sorted(map(repr, got)), sorted(map(repr, want)), strict=True) if a != b]
    return str(diff[:3])[:600] if diff else ""


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5), (-3, 60)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def dup_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)] + ["É"]
    base = [r.choices(vocabulary, k=r.randint(1, 90)) for _ in range(40)]
    rows = list(base)
    for _ in range(150):
        w = list(r.choice(base[:8]))
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append(w)
    texts = ["\n ".join(w) for w in rows] + [None, "", " ", "solo", "Solo", "two words", "two", base[3] and " ".join(base[3]).upper().replace("É", "É")]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3 + 1, texts[j], 1) for i, j in enumerate(order)] + [(None, texts[0], 1), (None, None, 1), (4, texts[order[1]], 1)]


@pytest.mark.parametrize("size,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_near_duplicates(spark, size, percent, seed):
    rows = dup_rows(seed)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t, _ in rows]
    ids = [d for d, _, _ in rows]
    parent = {d: d for d in ids if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(ids[i]), top(ids[j])))
                parent[y] = x
    want = [(d, len(s), None if d is None else top(d), d is None or d == top(d)) for d, s in zip(ids, sets)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(4)
    got = minhash.near_duplicates(docs, size, percent).collect()
    assert short([(x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got], want) == ""
    kept = minhash.keep_one(docs, size, percent)
    assert kept.columns == docs.columns and kept.count() == sum(w[3] for w in want)
    if seed == 1:
        assert minhash.near_duplicates(docs.limit(0)).count() == 0


def page_rows():
    r = random.Random(6)
    body = ["<p>é ß</p>" * n for n in (1, 40, 3000)] + ["".join(chr(r.randrange(32, 2000)) for _ in range(9000)), "\x1f\x8b\x08 WARC/1.0\r\n\r\n", "", None]
    rows = [(i * 7 % 101, f"http://x/{i} y", r.choice(body), 9) for i in range(101)]
    return rows + [(None, None, "only null", 9), (None, "u", body[0], 9), (3, "again", next(h for i, _, h, _ in rows if i == 3), 9)]


@pytest.mark.parametrize("split", [500, 64 << 20])
def test_warc(spark, split):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path int").repartition(3)
    path = work_dir(spark)
    manifest = warc.write_warc(pages, path)
    least = {}
    for i, _, h, _ in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want, responses = [], set()
    for i, _, h, _ in rows:
        p = (h or "").encode()
        first = least.get(h or "")
        again = i != first and first is not None or (i, h or "") in responses  # of repeated rows one is the response
        responses.add((i, h or ""))
        want.append((str(i) if i is not None else "null", len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", str(first) if again else None, None if again else p))
    got = warc.read_warc(manifest, path, split).collect()
    assert short([(x.record_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.payload and bytes(x.payload) if x.record_type == "revisit" else bytes(x.payload)) for x in got], want) == ""
    assert all(x.intact for x in got)
    listed = warc.list_archives(spark, path)
    assert warc.read_warc(listed, path, 10_000, payload=False).count() == len(rows)
    for m in manifest.collect():
        assert gzip.open(m.path).read().count(b"WARC/1.1\r\nWARC-Type") == m.records
    assert warc.read_warc(warc.write_warc(pages.limit(0), work_dir(spark)), path).count() == 0


def test_html():
    nav = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and more news here</a></li></ul></nav>'
    long = "Lorem &amp; ipsum &eacute;t dolor sit amet consectetur adipiscing elit sed do eiusmod. "
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{nav}
    <div class="ad">Buy this now, a long advert text that goes on and on and on for a while.</div><!-- x --><article><h1>Title
    here</h1><p><b>{long}<br><p>{long * 2}</p><p>a &lt;b&gt; <a href="x">link</a>  end</article><footer>&copy; site</footer></body></html>"""
    text = "Lorem & ipsum ét dolor sit amet consectetur adipiscing elit sed do eiusmod."
    assert html_text.extract(page) == f"Title here\n{text}\n{text} {text}\na <b> link end"
    plain = f'<body><div id="header">Site name</div><div class="wrap"><div class="content"><p>{long}</p><p>{long}</p><div class="share-buttons">Share</div></div><div class="sidebar"><a href=1>One</a><a href=2>Two</a></div></div><div id="comments"><p>{long * 3}</p></div></body>'
    assert html_text.extract(plain) == f"{text}\n{text}"
    assert html_text.extract(None) == html_text.extract("") == ""
    assert html_text.extract("just text < 5 & more") == "just text < 5 & more"
    for odd in ("<", "<p", "</p>", "<!--", "<script>", "<a href='", "<p>" * 3000, "<div>" * 3000 + "x", "</div></div>x<table><tr><td>y"):
        html_text.extract(odd)
    assert html_text.extract("<div>" * 3000 + "x") == "x"


def test_html_pages(spark):
    rows = [(1, "u", "<body><p>Some text here</p></body>", 3), (1, "u", "<body><p>Some text here</p></body>", 3), (None, None, None, 4)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert short([tuple(x) for x in got], [(1, "u", "Some text here", 14)] * 2 + [(None, None, "", 0)]) == ""
