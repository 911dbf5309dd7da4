"""Pages without article or main whose text lies in several blocks."""

from lodestone.llm import html_text

LINKS = '<div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">About us</a></div>'
TEXT = "Part {} has paragraph {} with quite some words in it, enough of them that it is dense text for a page."


def page(tag, sizes, wrapper=True):
    parts = [[TEXT.format(i, j) for j in range(n)] for i, n in enumerate(sizes)]
    body = "".join(f"<{tag}>" + "".join(f"<p>{t}</p>" for t in p) + f"</{tag}>" for p in parts)
    body = f"<div>{body}</div>" if wrapper else body
    return f"<html><body>{LINKS}{body}{LINKS}</body></html>", "\n".join(t for p in parts for t in p)


def test_all_sections():
    for tag in ("div", "section"):
        for sizes in ([4, 4], [5, 2, 3], [6, 1], [2, 3, 4, 5, 6, 7]):
            for wrapper in (True, False):
                html, text = page(tag, sizes, wrapper)
                assert html_text.extract(html) == text, (tag, sizes, wrapper)


def test_paragraphs_beside_sections():
    lead, end = TEXT.format("lead", 0), TEXT.format("end", 0)
    html, text = page("section", [3, 4], False)
    html = html.replace("<section>", f"<p>{lead}</p><section>", 1).replace("</section><div>", f"</section><p>{end}</p><div>")
    assert html_text.extract(html) == f"{lead}\n{text}\n{end}"


def test_inline_elements_bring_their_paragraph():
    html, text = page("div", [3, 3])
    html = html.replace("<p>Part 1 has paragraph 1", "<p>Part 1 <b>has <i>paragraph</i></b> 1")
    assert html_text.extract(html) == text
