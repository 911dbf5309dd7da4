"""Densities against a naive computation over the standard library's parser; pages of known text; hostile pages."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from lodestone.llm import html_text


class Naive(HTMLParser):
    def __init__(self):
        super().__init__()
        self.top = {"tag": "root", "parts": []}
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "parts": []}
        self.open[-1]["parts"].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1]["parts"].append(data)


def walk(node):
    yield node
    for p in node["parts"]:
        if not isinstance(p, str):
            yield from walk(p)


def text(node):
    return "".join(p if isinstance(p, str) else text(p) for p in node["parts"])


def counts(node):
    below = list(walk(node))[1:]
    links = [n for n in below if n["tag"] == "a"] if node["tag"] != "a" else [node]
    c = len(text(node).replace(" ", ""))
    return c, max(1, len(below)), sum(len(text(n).replace(" ", "")) for n in links), len(links) if node["tag"] != "a" else 0


def naive_density(node, body):
    c, t, lc, lt = counts(node)
    if not c:
        return 0.0
    bc, _, blc, _ = counts(body)
    base = math.log(c / max(1, c - lc) * max(1, lc) + blc / bc * c + math.e)
    return c / t * math.log(c / max(1, lc) * t / max(1, lt), base)


def random_page(r, depth=0):
    if depth > 3 or r.random() < 0.3:
        words = " ".join(r.choices(["word", "é", "density", "of", "text"], k=r.randint(1, 40)))
        return f"<p>{words} <a>link {r.randint(1, 99)}</a></p>" if r.random() < 0.4 else f"<p>{words}</p>"
    tag = r.choice(["div", "section", "div"])
    return f"<{tag}>" + "".join(random_page(r, depth + 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(30))
def test_densities(seed):
    page = "<body>" + "".join(random_page(random.Random(seed * 7 + i)) for i in range(3)) + "</body>"
    naive = Naive()
    naive.feed(page)
    body = naive.top["parts"][0]
    nodes = list(walk(body))
    root = html_text.parse(page)
    html_text.settle_marks(root)
    html_text.measure(root)
    mine = [n for n in html_text._nodes(root) if n is not root]
    assert [n.tag for n in mine] == [n["tag"] for n in nodes]
    score = [naive_density(n, body) for n in nodes]
    assert [n.score for n in mine] == pytest.approx(score)
    number = {id(n): i for i, n in enumerate(nodes)}
    total = [sum(score[number[id(p)]] for p in n["parts"] if not isinstance(p, str)) for n in nodes]
    assert [n.total for n in mine] == pytest.approx(total)


def test_state_classes_and_wrappers():
    line = " ".join(["The text of the article has enough words to be dense."] * 4)
    inner = "".join(f"<p>{line} {i}</p>" for i in range(4))
    want = "\n".join(f"{line} {i}" for i in range(4))
    for start, end in (('<div class="content has-sidebar">', "</div>"), ('<div class="no-ads layout">', "</div>"), ("<form>", "</form>"), ('<div class="post share-enabled">', "</div>"), ('<div id="ads">', "</div>")):
        assert html_text.extract(f"<body>stray{start}{inner}{end}</body>") == want, start
    side = f'<div class="sidebar"><p>{line}</p></div>'
    assert html_text.extract(f'<body><div class="sidebar-layout">{inner}{side}</div></body>') == want
    assert html_text.extract(f"<body>{inner}<div id='comments'>{inner * 2}</div></body>") == want


def test_every_article():
    line = " ".join(["The text of the article has enough words to be dense."] * 4)
    part = f"<article><p>{line}</p><p>Short.</p><p>{line}</p></article>"
    assert html_text.extract(f"<body>{part}<div>Buy now</div>{part}</body>") == "\n".join([line, "Short.", line] * 2)


@pytest.mark.parametrize("page", ['<a "' * 16000, '<a ="' * 13000, '<a =">' * 13000, "<a =\"'>" * 10000, "<div>" * 5000 + "</b>" * 5000, "<b><table><tr><td>" + "<div>" * 5000 + "</b>" * 5000, "<span>" * 5000 + "<li></li>" * 5000, "<!" * 30000, "<" * 60000, "<![CDATA[" * 8000, "<div class=ad>x" * 5000, "&" * 64000])
def test_hostile_pages_take_linear_time(page):
    start = time.process_time()
    html_text.extract(page)
    assert time.process_time() - start < 1


def test_long_page_and_empty_table(spark):
    lines = [f"Paragraph {i} of a very long page with text." for i in range(20000)]
    page = "<body><article>" + "".join(f"<p>{x}</p>" for x in lines) + "</article></body>"
    assert html_text.extract(page) == "\n".join(lines)
    empty = spark.createDataFrame([], "page_id long, url string, html string, text int, extra int")
    got = html_text.extract_pages(empty)
    assert got.columns == ["page_id", "url", "extra", "text", "n_chars"] and got.count() == 0
