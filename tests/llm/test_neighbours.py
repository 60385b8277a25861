"""Operator 1: recall where all vectors share a direction."""

import numpy as np
import pytest

from skycat.llm import hashing_ann


@pytest.mark.parametrize("shared", [0.0, 0.95, 0.98, 0.99, 0.999])
def test_recall_with_a_common_direction(shared):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((8000, 48))
    x *= np.sqrt(1 - shared**2) / np.linalg.norm(x, axis=1)[:, None]
    x[:, 0] += shared
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes = hashing_ann.Codes(x, 1.0)
    index = hashing_ann.Index(x, codes)
    hits = 0
    for i in range(0, 8000, 200):
        rows, _ = index.search(x[i], codes.substrings(x[i : i + 1], True)[0], 20)
        hits += len(set(rows.tolist()) & set(np.argsort(-(x @ x[i]), kind="stable")[:20].tolist()))
    assert hits >= 0.95 * 20 * 40


def test_every_substring_tells_rows_apart():
    """130 bits: a ninth substring of the last 2 would match a quarter of all rows at distance 0."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    codes = hashing_ann.Codes(x, np.linalg.norm(x, axis=1).max())
    index = hashing_ann.Index(x, codes)
    found = [len(index.probe(code, 0, np.zeros(len(x), bool))) for code in codes.substrings(x[:50], True)]
    assert max(found) < 0.02 * len(x)


def test_steps_that_read_codes_give_the_rows_of_the_probes():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 20)) * np.exp(rng.standard_normal((3000, 1)))
    codes = hashing_ann.Codes(x, np.linalg.norm(x, axis=1).max())
    index = hashing_ann.Index(x, codes)
    for code in codes.substrings(x[:10], True):
        seen = np.zeros(len(x), bool)
        steps = list(index.retrieved(code))
        for t, new in enumerate(steps):
            assert sorted(index.probe(code, t, seen)) == sorted(new)
        assert seen.all() and sum(map(len, steps)) == len(x)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e30])
def test_rows_left_out_by_single_precision_are_not_among_the_best(scale):
    """Scores that differ by less than single precision tells apart."""
    rng = np.random.default_rng(5)
    x = np.full((500, 16), 1.0)
    x += 1e-9 * rng.standard_normal(x.shape)
    x[:50] = rng.standard_normal((50, 16))
    x *= scale
    codes = hashing_ann.Codes(x, np.linalg.norm(x, axis=1).max())
    index = hashing_ann.Index(x, codes)
    for i in range(0, 500, 25):
        rows, _ = index.search(x[i], codes.substrings(x[i : i + 1], True)[0], 10)
        assert set(np.argsort(-(x * x[i]).sum(1), kind="stable")[:10].tolist()) <= set(rows.tolist())
