"""Operator 12 against the tokenizers library, exhaustive packing of small cases, and the bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from skycat.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts, end=packing.END_ID):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def fewest(sizes, room):
    """The fewest sequences, by trying every place of every piece."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(i, used):
        if len(used) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(used)
            return
        for k in {u: k for k, u in enumerate(used)}.values():
            if used[k] + sizes[i] <= room:
                used[k] += sizes[i]
                go(i + 1, used)
                used[k] -= sizes[i]
        go(i + 1, [*used, sizes[i]])

    go(0, [])
    return best[0]


def holds(counts, packing_):
    used = np.zeros_like(counts)
    for content, n in packing_.fillings:
        assert 0 < sum(content) < len(counts) and n > 0
        for x in content:
            used[x] += n
    return (used == counts).all()


def test_small_cases_are_optimal():
    rng = random.Random(2)
    for _ in range(250):
        room = rng.choice([12, 20, 31])
        sizes = [rng.randint(1, rng.choice([room, room // 2, room // 3])) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(np.array(sizes, np.int64), minlength=room + 1)
        least, found, fit = fewest(sizes, room), packing.packed(counts), packing.best_fit(counts)
        assert holds(counts, found) and holds(counts, fit)
        assert packing.lower_bound(counts) <= least == len(found) <= len(fit)


def test_best_fit_in_groups_is_best_fit():
    rng = random.Random(4)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(1, 200))), reverse=True)
        room = 60
        left = []
        for x in sizes:
            fits = [r for r in left if r >= x]
            if fits:
                left.remove(min(fits))
            left.append((min(fits) if fits else room) - x)
        counts = np.bincount(sizes, minlength=room + 1)
        assert len(packing.best_fit(counts)) == len(left)


def test_search_improves_best_fit():
    sizes = np.random.default_rng(5).integers(400, 900, 100)
    counts = np.bincount(sizes, minlength=2049)
    assert len(packing.packed(counts)) < len(packing.best_fit(counts))
    assert len(packing.packed(counts, nodes=0)) == len(packing.best_fit(counts))


@pytest.mark.parametrize("n", [1, 200, 30000])
def test_documents_meet_the_bound(n):
    sizes = np.minimum(2048, np.random.default_rng(n).lognormal(5.5, 1.2, n).astype(int) + 1)
    counts = np.bincount(sizes, minlength=2049)
    found = packing.packed(counts)
    assert holds(counts, found) and len(found) == packing.lower_bound(counts)


def test_ranks_are_those_of_the_rank_file():
    ranks = packing.byte_ranks(PATH)
    assert ranks == bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def whole(rows, docs, length):
    """The rows of ``docs`` (doc_id, text) are all there, cut and packed as they must be."""
    ids = defaultdict(list)
    for (d, _), found in zip(docs, library([t or "" for _, t in docs])):
        ids[d].append(found)
    want = []
    for d, found in ids.items():
        for x in found:
            first = (len(x) - 1) % length + 1
            cuts = [0, *range(first, len(x) + 1, length)]
            want += [(d, n, a, b - a, zlib.crc32(x[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        content.sort()
        assert [a for a, _ in content] == [0, *np.cumsum([n for _, n in content])[:-1]]
        assert sum(n for _, n in content) <= length
    total = sum(n for *_, n, _ in want)
    return len(sequences), -(-total // length)


@pytest.mark.parametrize("length", [2048, 64])
def test_edge_rows(spark, edges, nothing, length):
    from skycat.llm.common import written
    from tests.llm.cases import edge_rows

    extra = [(50, " " * 5000 + "a" + "\n\t " * 3000 + "b"), (51, "<|endoftext|> x <|endoftext|>"), (52, "　" * 3000), (None, "same"), (None, "same")]
    more = spark.createDataFrame(extra, "doc_id long, text string")
    df = edges.select("doc_id", "text").union(more).repartition(3)
    cut = written(packing.pieces(df, PATH, public_tokenizers.PATTERN, length), "test-pieces")
    n, least = whole(packing.placed(cut, length).collect(), [(r[0], r[1]) for r in edge_rows()] + extra, length)
    assert n <= least + 1
    cut = written(packing.pieces(nothing, PATH, public_tokenizers.PATTERN), "test-pieces")
    assert packing.placed(cut).count() == 0


def test_query(spark):
    from skycat.llm import queries as Q

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = whole(Q.QUERIES["op12_bin_completion"](spark, sf).collect(), docs, packing.LENGTH)
    assert n == least
