"""Wrappers: every sample is a word of the expression, and the expression decides what is main text."""

import json
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lamella.llm import html_wrap


def word(nodes):
    return "".join("#" if isinstance(x, tuple) else f"<{x[0]}>{word(x[1])}</{x[0]}>" for x in nodes)


def some_tree(rng, depth=0):
    return [("t", 0) if depth == 3 or rng.random() < 0.4 else [rng.choice("abc"), some_tree(rng, depth + 1)] for _ in range(rng.randint(0, 5))]


@pytest.mark.parametrize("most", [4, 64])
def test_samples_are_words_of_the_expression(monkeypatch, most):
    monkeypatch.setattr(html_wrap, "MOST", most)
    rng = random.Random(3)
    for _ in range(300):
        pages = [some_tree(rng) for _ in range(rng.randint(1, 5))]
        shown = html_wrap.expression(html_wrap.infer([html_wrap.concrete(p) for p in pages]))
        assert "|" not in shown
        assert all(re.fullmatch(shown, word(p)) for p in pages)


def learned(pages):
    samples = [json.loads(json.dumps(html_wrap.concrete(html_wrap.tree(p)))) for p in pages]
    return html_wrap.Wrapper(html_wrap.infer(samples), len(samples))


def test_repeated_and_optional_groups():
    pages = ["<ul><li>a</li></ul><p>x</p>", "<ul><li>a</li><li>b</li><li>c</li></ul><p>y</p><hr><table><tr><td>1</td></tr></table>"]
    assert html_wrap.expression(learned(pages).items) == "<ul>(<li>#</li>)+</ul><p>#</p>(<table><tr><td>#</td></tr></table>)?"
    pages = ["<dl><dt>a</dt><dd>b</dd></dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"]
    assert html_wrap.expression(learned(pages).items) == "<dl>(<dt>#</dt><dd>#</dd>)+</dl>"


def nameless(k):
    """A page without any telling name: links, an article of a few paragraphs, a fixed line."""
    links = "".join(f"<li><a href='/{j}'>Topic {j} of {k}</a></li>" for j in range(6))
    body = "".join(f"<p>Paragraph {j} of page {k} says something that no other page of the host says.</p>" for j in range(2 + k % 3))
    return f"<div><ul>{links}</ul></div><div><h2>Title {k}</h2>{body}<div>All rights reserved.</div></div><div>You are here</div>"


def test_host_without_names():
    pages = [nameless(k) for k in range(6)]
    wrapper = learned(pages)
    for k, page in enumerate(pages):
        found = html_wrap.extract(page, wrapper).split("\n\n")
        assert found == [f"Title {k}", *(f"Paragraph {j} of page {k} says something that no other page of the host says." for j in range(2 + k % 3))]
        assert html_wrap.extract(page, None).split("\n\n") != found  # one page alone doesn't tell its template


def test_template_in_an_article_goes_and_equal_paragraphs_stay():
    pages = [f"<article><h1>T {k}</h1><div>Sign our list today</div><p>Same words</p><p>Own words {k}</p>{'<p>More</p>' * (k % 3)}</article>" for k in range(6)]
    wrapper = learned(pages)
    assert html_wrap.extract(pages[0], wrapper) == "T 0\n\nSame words\n\nOwn words 0"
    # Another text in the template's place is kept, however alike its checksum may be.
    assert "Changed" in html_wrap.extract(pages[0].replace("Sign our list today", "Changed"), wrapper)


def test_marks_are_overruled_by_the_text():
    page = "<div class='content-header'><p>" + "Long text of the page. " * 20 + "</p></div><div class='ad'>Buy</div>"
    assert html_wrap.extract(page, learned([page])) == ("Long text of the page. " * 20).strip()


def test_unknown_pages_and_parts():
    wrapper = learned([f"<article><p>Text {k} of this page</p></article><footer>f</footer>" for k in range(5)])
    assert html_wrap.extract("<article><p>one</p><table><tr><td>cell</td></tr></table><nav>x</nav><p>two</p></article>", wrapper) == "one\n\ncell\n\ntwo"
    assert html_wrap.extract("<div><p>a page of another kind</p></div>", wrapper) == "a page of another kind"
    assert html_wrap.extract("<nav>menu</nav>", wrapper) == ""


def test_very_long_and_deep_pages():
    began = time.time()
    many = "<article>" + "".join(f"<{t}>text {k} and more of it</{t}>" for k in range(100_000) for t in ("p", "h2", "div")[: 1 + k % 3]) + "</article>"
    wrapper = learned([many, many.replace("text 5", "text x")])
    assert html_wrap.extract(many, wrapper).count("\n\n") + 1 == many.count("</")  - 1
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    assert html_wrap.extract(deep, learned([deep])) == "deep text"
    assert time.time() - began < 60


def test_every_page_of_a_host_counts(spark):
    """A line that is the same on the pages of the smallest checksums, and on no other, is no template."""
    def page(k, line):
        return f"<article><h1>T {k}</h1><div>{line}</div><p>Own words {k}</p></article>"

    def place(p):
        return zlib.crc32(p.encode()) << 31 | zlib.adler32(p.encode()) >> 1

    pages = [page(k, "Read this") for k in range(400)]
    first = set(sorted(pages, key=place)[:30])
    pages = [p if p in first else page(k, f"Read that {k}") for k, p in enumerate(pages)]
    rows = [(k, "http://a.example/", p) for k, p in enumerate(pages)] + [(1000 + k, "http://a.example/", p) for k, p in enumerate(pages[:50])]
    found = []
    for n in (1, 7):
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        found.append({r["page_id"]: r["text"] for r in html_wrap.main_text(frame).collect()})
        learned = html_wrap.wrappers(frame.withColumn("host", F.lit("a.example"))).collect()
        assert [r["samples"] for r in learned] == [len(set(pages))]
    assert found[0] == found[1]
    assert all(found[0][k].split("\n\n") == [f"T {k}", "Read this" if p in first else f"Read that {k}", f"Own words {k}"] for k, p in enumerate(pages))
