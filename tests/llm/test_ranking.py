"""Operator 13 against a plain reading of its contract."""

import math
import random
import re
from collections import Counter

import pytest

from skycat.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs):
    """[(item_id, rank, doc_id, score)] of rows (item_id, text) and (doc_id, text)."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), n in zip(counts, sizes):
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // n_terms)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def random_rows(seed, n):
    """Words of very different frequencies; copies, one very common word, empty and null texts."""
    rng = random.Random(seed)
    words = [f"{c}{i}" for i in range(300) for c in ("w", "Ñ", "Z")]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda k: " ".join(rng.choices(words, weights, k=k)) + rng.choice(["", ". The-the", "\x00the", "　"])
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(n // 3)] + [(None, docs[3][1]), (None, None), (5, ""), (7, docs[9][1]), (n + 900, "the " * 5000)]
    items = [(i, text(rng.choice([1, 8, 30]))) for i in range(12)]
    items += [(100, docs[4][1]), (101, None), (102, "?!"), (103, "unheard of"), (104, "the THE The"), (None, docs[9][1]), (100, docs[4][1])]
    return items, docs


@pytest.mark.parametrize("owners, block, bundle", [(ranking.OWNERS, 4096, 256), ((0.01, 0.05, 0.3), 7, 4)])
def test_random_rows(spark, monkeypatch, owners, block, bundle):
    monkeypatch.setattr(ranking, "OWNERS", owners)
    monkeypatch.setattr(ranking, "BUNDLE", bundle)
    monkeypatch.setattr(ranking, "postings", lambda docs, maybe, own=ranking.postings: own(docs, maybe, block))
    items, docs = random_rows(len(owners) + block, 150)
    d = spark.createDataFrame([(*r, "z", "z", 1) for r in docs], "doc_id long, text string, block string, item string, n int").repartition(3)
    i = spark.createDataFrame([(*r, "z", 1) for r in items], "item_id long, text string, doc_id string, score int")
    assert result(ranking.ranked(i, d)) == brute(items, docs)


def test_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert ranking.ranked(items, docs.limit(0)).count() == 0
    assert ranking.ranked(items.limit(0), docs).count() == 0
    assert ranking.ranked(items, docs.where("doc_id = 2")).count() == 0


def test_bounds_drop_documents(spark, monkeypatch):
    """The accumulators that go from stage to stage are fewer than all that match, and nothing is lost."""
    carried = []
    written = ranking.written

    def kept(df, name):
        out = written(df, name)
        if name.startswith("carried"):
            carried.append(sum(len(r.docs) for r in out.collect()))
        return out

    monkeypatch.setattr(ranking, "written", kept)
    sf = "/root/testdata/sf0.01"
    items, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "documents"))
    plain_items, plain_docs = [(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()]
    assert result(ranking.ranked(items, docs)) == brute(plain_items, plain_docs)
    sets = [set(terms(t)) for _, t in plain_docs]
    matches = sum(bool(s & set(terms(t))) for _, t in plain_items for s in sets)
    assert max(carried) < matches / 2, (carried, matches)
