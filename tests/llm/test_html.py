"""Operator 9: held-out pages, hidden text, and pages of malformed tags."""

import html
import re
import time

import pytest
from pyspark.sql import functions as F

from skycat.llm import dom, html_text

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def held_out(spark):
    """Trees fitted on 40 pages, and the pages that they have not seen."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").where("length(html) > 0")
    seen = pages.orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(40)
    return html_text.fitted(pages, sample=40), pages.join(seen.select("page_id"), "page_id", "left_anti").collect()


def article(page):
    a = page[page.index("<article>") : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in re.split(r"</?h1>|</?p>", a)]
    return "\n".join(p for p in parts if p)


def test_held_out_pages(held_out):
    trees, pages = held_out
    assert len(pages) > 100
    right = sum(html_text.extract(r.html, trees) == article(r.html) for r in pages)
    assert right >= 0.98 * len(pages)


def test_hidden_text_in_the_article_stays(held_out):
    trees, pages = held_out
    page = pages[0].html
    for mark in ("hidden", 'style="display:none"', 'aria-hidden="true"'):
        more = page.replace("</article>", f"<p {mark}>These words of the article are not shown at first, and they are read all the same.</p></article>", 1)
        assert html_text.extract(more, trees) == article(page) + "\nThese words of the article are not shown at first, and they are read all the same."
    more = page.replace("</article>", "<noscript><p>These words stand where no script runs, and they belong to the article.</p></noscript></article>", 1)
    assert html_text.extract(more, trees).endswith("they belong to the article.")


@pytest.mark.parametrize("piece", ["<a ", '<a href="x', "<a href='x\"", "<a x='><b y=\"", "<i></u>", "<" + "a" * 300 + '"', "<p title='>", "<!--<", "<![CDATA["])
@pytest.mark.parametrize("end", ["", ">"])
def test_malformed_pages_are_read_in_linear_time(piece, end):
    start = time.perf_counter()
    dom.parse(piece * (2_000_000 // len(piece)) + end)
    assert time.perf_counter() - start < 30  # the square of these lengths would take hours


def test_long_tags_and_open_quotes():
    """Tags beyond the near pattern end where short ones do."""
    shape = lambda n: (n.tag, n.attributes, [shape(c) if isinstance(c, dom.Node) else c for c in n.children])
    for long in ("x", "x" * 1000):
        assert shape(dom.parse(f'<p a="{long}>" b>t</p>u')) == ("#root", "", [("p", f' a="{long}>" b', ["t"]), "u"])
        assert shape(dom.parse(f"<p a='{long}>t</p>u")) == ("#root", "", [("p", f" a='{long}", ["t"]), "u"])  # the quote never closes
        assert shape(dom.parse(f'<p a="{long}')) == ("#root", "", ["<", f'p a="{long}'])
