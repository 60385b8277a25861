"""Operator 9: main text of pages by gradient-boosted trees over DOM nodes.

Every block node has features: subtree density (text, share of link text, text per
tag), attribute tokens by kind (its own and inherited), depth, sibling statistics and
tag.  Boosted trees give the probability that a node belongs to the article.

Decoding is over the whole tree: a node is either dropped with all it holds, or open,
and then each child is decided alone.  The choice with the largest likelihood is found
from the leaves up, so a kept node never lies in a dropped one.

Training: the classifier is fitted on a bounded sample (``SAMPLE`` pages, those with the
smallest hash of page_id) whose nodes are labelled by their markup (elements and
attribute tokens that name navigation, headers, footers, sidebars, notices, adverts,
forms or comments, and what they hold, against the rest).  Each sampled page is used
again with such parts built from other pages' words put around and into the article,
and with elements and attributes stripped from navigation, so that density and place
also count.

Extraction is one pass over the rows without a shuffle.  Defined cases: null or empty
html (empty text), text without tags, unclosed or nested wrongly, very long and deep
pages, repeated rows (a result row each), null page_id or url (kept), empty tables,
extra columns (ignored).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.session import ship_package

from . import dom
from .common import table

SAMPLE = 120
ROUNDS = 40
DEPTH = 4
RATE = 0.25
BINS = 24


@dataclass
class Boosted:
    """Complete trees of equal depth: feature and limit of each inner node, value of each leaf."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.feature):
            return np.full(len(x), self.start)
        trees, rows = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
        inner = self.feature.shape[1]
        at = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
        return self.start + self.value[trees, at - inner].sum(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Gradient boosting of log loss with Newton leaves over binned features."""
    n, d = x.shape
    limits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(limits[j], x[:, j], "left") for j in range(d)], 1)
    inner = 2**depth - 1
    feature, limit, value = (np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, inner + 1)))
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    score = np.full(n, start)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        first, width = 0, 1
        for _ in range(depth):
            best = np.full(width, 1e-6)
            slot = at - first
            for j in range(d):
                if not len(limits[j]):
                    continue
                cell = slot * BINS + binned[:, j]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1)
                k = gain[:, : len(limits[j])].argmax(1)
                top = gain[np.arange(width), k]
                for s in np.flatnonzero(top > best):
                    best[s] = top[s]
                    feature[r, first + s], limit[r, first + s] = j, limits[j][k[s]]
            at = 2 * at + 1 + (x[np.arange(n), feature[r, at]] > limit[r, at])
            first, width = 2 * first + 1, 2 * width
        leaf = at - inner
        value[r] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        score += value[r, leaf]
    return Boosted(feature, limit, value, start)


def decoded(nodes: list[dom.Node], log_odds: np.ndarray) -> np.ndarray:
    """True for kept nodes; the likeliest choice in which all that a dropped node holds is dropped."""
    keep, drop = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    place = {id(n): i for i, n in enumerate(nodes)}
    above = np.full(len(nodes), -1)
    for i, n in enumerate(nodes):
        p = n.parent
        while p is not None and id(p) not in place:
            p = p.parent
        above[i] = place[id(p)] if p is not None else -1
    all_dropped, opened = drop.copy(), keep.copy()
    is_open = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):  # page order: what a node holds comes after it
        is_open[i] = opened[i] > all_dropped[i]
        if above[i] >= 0:
            all_dropped[above[i]] += all_dropped[i]
            opened[above[i]] += max(opened[i], all_dropped[i])
    for i in range(len(nodes)):
        if above[i] >= 0 and not is_open[above[i]]:
            is_open[i] = False
    return is_open


#: Elements and kinds of attribute tokens that name what is not the article.
OTHER_TAGS = frozenset("nav header footer aside form menu dialog".split())
OTHER_KINDS = frozenset(k for k in dom.KINDS if k != "main")


def labels(nodes: list[dom.Node]) -> np.ndarray:
    """1 for nodes of the article by their markup, 0 for the others."""
    other: dict[int, bool] = {}
    out = np.ones(len(nodes))
    kind_of = {t: k for k, words in dom.KINDS.items() if k in OTHER_KINDS for t in words.split()}
    for i, n in enumerate(nodes):
        p = n.parent
        while p is not None and id(p) not in other:
            p = p.parent
        own = n.tag in OTHER_TAGS or "data-x" in n.attributes
        own = own or n.tag not in ("body", "html", "main", "article") and any(t in kind_of for t in n.attribute_tokens())
        other[id(n)] = own or (p is not None and other[id(p)])
        out[i] = not other[id(n)]
    return out


def _variant(page: str, words: list[str], rng: random.Random) -> str:
    """The page with parts that are not the article around and inside it; ``data-x`` marks those without a telling name."""
    some = lambda a, b: " ".join(rng.choices(words, k=rng.randint(a, b)))
    links = lambda n: "".join(f'<li><a href="/{i}">{some(1, 3)}</a></li>' for i in range(n))
    paragraphs = lambda n: "".join(f"<p>{some(8, 40)}</p>" for _ in range(n))
    pick = lambda k: rng.choice(dom.KINDS[k].split())

    def box(kind: str, inner: str) -> str:
        tag = rng.choice(["div", "section"])
        return f'<{tag} {rng.choice(["class", "id"])}="{pick(kind)}{rng.choice(["", "-box", " wide", "-1"])}">{inner}</{tag}>'

    front = [
        f"<header><h1>{some(1, 4)}</h1><p>{some(2, 8)}</p></header>",
        box("head", f"<p>{some(2, 9)}</p>"),
        box("notice", f"<p>{some(6, 30)}</p><button>{some(1, 2)}</button>"),
        f"<div data-x><ul>{links(rng.randint(3, 9))}</ul></div>",
        box("nav", f"<ul>{links(rng.randint(3, 9))}</ul>"),
        box("ad", some(4, 20)),
    ]
    back = [
        f"<aside><h3>{some(1, 3)}</h3>{paragraphs(rng.randint(1, 3))}<ul>{links(4)}</ul></aside>",
        box("side", f"<h4>{some(1, 3)}</h4>{paragraphs(1)}<ul>{links(5)}</ul>"),
        box("comment", "".join(f'<div class="{pick("comment")}"><b>{some(1, 2)}</b>{paragraphs(1)}</div>' for _ in range(rng.randint(1, 5)))),
        f"<section id=comments><h2>{some(1, 3)}</h2><ol>" + "".join(f"<li><p>{some(5, 30)}</p></li>" for _ in range(3)) + "</ol></section>",
        f"<form action=/s><label>{some(1, 3)}</label><input name=q><p>{some(3, 12)}</p></form>",
        box("share", f"<ul>{links(4)}</ul>"),
        box("foot", f"<p>{some(4, 15)}</p>"),
        f"<footer><p>{some(3, 20)}</p><ul>{links(5)}</ul></footer>",
        box("notice", f"<p>{some(6, 30)}</p>"),
        box("ad", f"<p>{some(4, 25)}</p>"),
    ]
    inside = [box("ad", some(4, 20)), f"<aside>{paragraphs(1)}</aside>", box("share", f"<ul>{links(3)}</ul>"), f"<ul>{''.join(f'<li>{some(4, 20)}</li>' for _ in range(3))}</ul>", f"<blockquote><p>{some(5, 25)}</p></blockquote>", f"<h2>{some(2, 6)}</h2>", f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>"]
    page = page.replace("<body>", "<body>" + "".join(rng.sample(front, rng.randint(1, 4))), 1)
    if rng.random() < 0.3:  # a short article
        a, z = page.find("<article"), page.rfind("</article>")
        if 0 <= a < z:
            page = page[:a] + "<article>" + f"<h1>{some(1, 4)}</h1>" + "".join(f"<p>{some(1, 9)}</p>" for _ in range(rng.randint(0, 4))) + page[z:]
    cut = page.rfind("</article>")
    if cut >= 0:
        after = "".join(rng.sample(back, rng.randint(1, 5)))
        page = page[:cut] + (rng.choice(back) if rng.random() < 0.3 else "") + page[cut:].replace("</article>", "</article>" + after, 1)
        middle = page.find("</p>", page.find("<article"))
        if middle >= 0 and rng.random() < 0.7:
            page = page[: middle + 4] + rng.choice(inside) + page[middle + 4 :]
    if rng.random() < 0.6:  # the article without its telling element
        name = rng.choice(["div", "section", "main", f'div class="{pick("main")}"', "div id=main"])
        page = page.replace("<article>", f"<{name}>").replace("</article>", f"</{name.split()[0]}>")
    if rng.random() < 0.4:
        page = page.replace("<nav>", "<div data-x>").replace("</nav>", "</div>")
    return page


def fitted(pages: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Trees fitted on at most ``sample`` pages and variants of them."""
    some = pages.where(F.length("html") > 0).select("html").orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(sample).collect()
    rng = random.Random(13)
    words = [w for r in some for w in islice((w for t in dom.strings(dom.parse(r.html)) for w in t.split()), 400)] or ["word"]
    x, y = [], []
    for r in some:
        for page in (r.html, _variant(r.html, words, rng), _variant(r.html, words, rng), _variant(r.html, words, rng)):
            nodes = dom.candidates(dom.parse(page))
            x.append(dom.features(nodes))
            y.append(labels(nodes))
    if not x:
        return Boosted(np.zeros((0, 1), np.int64), np.zeros((0, 1), np.float32), np.zeros((0, 2)), 1.0)
    return fit(np.concatenate(x), np.concatenate(y))


def extract(source: str | None, model: Boosted) -> str:
    if not source:
        return ""
    root = dom.parse(source)
    nodes = dom.candidates(root)
    return dom.blocks(root, nodes, decoded(nodes, model.log_odds(dom.features(nodes))))


def extracted(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model or fitted(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), shared.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
