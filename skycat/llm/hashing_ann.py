"""Operator 1: nearest neighbours by multi-index hashing over learned rotated codes.

Codes: vectors get one more coordinate so that all have the length of the longest (the
largest inner product is then the smallest angle), are centred, and each of ``TURNS``
rotations, learned on a bounded sample (principal axes turned so that signs lose least,
as in iterative quantization), gives one bit a coordinate.

Index and search: codes are split into the fewest substrings of at most 16 bits, of
equal lengths but for one bit (a short one would match most rows), and each is indexed
by value.  Step t probes, for each substring of the query's code, all values at distance
t; where these outnumber the rows not yet retrieved, it reads their codes instead, which
gives the same rows.  By the pigeonhole principle every code within m * (t + 1) - 1 bits
(m substrings) has then been retrieved.  What is retrieved is reranked by the inner
product of the original vectors in double precision, but for rows that single precision
and its error bound show to be worse than the k best.  The search ends when all rows are
retrieved or at the first step whose radius covers
the bits that a vector at the widest angle to the k best would differ in, plus
``MARGIN`` standard deviations; the angles are those of the centred vectors, whose signs the codes are; without k results it goes on until all are retrieved.
There is no cap on candidates.

On Spark: equal vectors form one class with its k + 1 smallest ids (the only members
that any list can hold), so a vector that a third of all rows share is one candidate.
Queries and classes are dealt over blocks of bounded size; each (query block, class
block) is a task's group that builds the index of its block, and the lists of the
blocks are merged.

Defined cases: null, zero, ragged or non-finite vectors and those of another length
than most take no part; fewer candidates than k give shorter lists; ties go to the
smaller id; repeated rows with one id are candidates once; empty tables; extra columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import table, written

NEAREST = 20
EVERY = 20
#: Rows the rotations are learned on; rotations; turns of the fitting; standard deviations of margin.
SAMPLE = 8000
TURNS = 2
FIT_STEPS = 20
MARGIN = 2.0
#: Classes and queries of a block.
BLOCK = 1 << 16
QUERY_BLOCK = 1 << 12
SUB = 16


@cache
def _masks(width: int) -> list[np.ndarray]:
    """The values of ``width`` bits with t bits set, for t from 0 to ``SUB``."""
    values = np.arange(1 << width)
    ones = np.bitwise_count(values)
    return [values[ones == t] for t in range(SUB + 1)]


class Codes:
    """Learned rotations: ``bits`` of vectors, padded to whole substrings."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        self.longest = longest
        x = self._lift(sample)
        self.mean = x.mean(0) if len(x) else np.zeros(sample.shape[1] + 1)
        c = x - self.mean
        d = c.shape[1]
        _, axes = np.linalg.eigh(c.T @ c if len(c) else np.eye(d))
        rng = np.random.default_rng(seed)
        turns = []
        for _ in range(TURNS):
            r = np.linalg.qr(rng.standard_normal((d, d)))[0]
            v = c @ axes
            for _ in range(FIT_STEPS if len(c) else 0):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            turns.append(axes @ r)
        self.turns = np.concatenate(turns, 1)
        self.n_bits = self.turns.shape[1]
        m = -(-self.n_bits // SUB)
        self.widths = [len(part) for part in np.array_split(np.arange(self.n_bits), m)]

    def _lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def centred(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            return np.concatenate([x * (self.longest / np.linalg.norm(x, axis=1))[:, None], np.zeros((len(x), 1))], 1) - self.mean
        return self._lift(x) - self.mean

    def substrings(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, substrings) of values of ``widths`` bits."""
        bits = self.centred(x, query) @ self.turns > 0
        parts = np.split(bits, np.cumsum(self.widths)[:-1], axis=1)
        return np.stack([part @ (1 << np.arange(part.shape[1])) for part in parts], 1).astype(np.uint16)


class Index:
    """Multi-index over one block of classes."""

    def __init__(self, x: np.ndarray, codes: Codes):
        self.x, self.codes = x, codes
        self.single = (x / codes.longest).astype(np.float32)
        self.few = np.empty((1024, x.shape[1]), np.float32)
        #: A product of a row and a query of length 1 in single precision is off by less.
        self.error = (x.shape[1] + 8) * float(np.finfo(np.float32).eps)
        self.subs = np.ascontiguousarray(codes.substrings(x).T)
        self.order, self.first = [], []
        for s, width in zip(self.subs, codes.widths, strict=True):
            order = np.argsort(s, kind="stable")
            self.order.append(order)
            self.first.append(np.searchsorted(s[order], np.arange((1 << width) + 1)))

    def probe(self, code: np.ndarray, t: int, seen: np.ndarray) -> np.ndarray:
        """Rows not seen yet with a substring at distance t from the code's."""
        new = []
        for s, width, order, first in zip(code, self.codes.widths, self.order, self.first, strict=True):
            values = _masks(width)[t] ^ int(s)
            a, n = first[values], first[values + 1] - first[values]
            total = int(n.sum())
            if total:
                at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
                rows = order[at]
                rows = rows[~seen[rows]]
                seen[rows] = True
                new.append(rows)
        return np.concatenate(new) if new else np.zeros(0, np.int64)

    def retrieved(self, code: np.ndarray) -> Iterator[np.ndarray]:
        """The rows of each step, until all have been given."""
        seen, left, far = np.zeros(len(self.x), bool), len(self.x), None
        for t in range(SUB + 1):
            if far is None and sum(len(_masks(w)[t]) for w in self.codes.widths) > left:
                far = np.bitwise_count(self.subs ^ code[:, None]).min(0)
            new = self.probe(code, t, seen) if far is None else np.flatnonzero(far == t)
            left -= len(new)
            yield new
            if not left:
                return

    def _hopeful(self, new: np.ndarray, q: np.ndarray, k: int, least: float) -> np.ndarray:
        """``new`` without rows that are worse than ``least`` or than k others of ``new``."""
        scale = float(np.linalg.norm(q)) * self.codes.longest
        if not 0 < scale < math.inf:
            return new
        unit, score = (q / np.linalg.norm(q)).astype(np.float32), np.empty(len(new), np.float32)
        for a in range(0, len(new), len(self.few)):  # through a small buffer, which stays in the processor's cache
            some = new[a : a + len(self.few)]
            score[a : a + len(some)] = self.single.take(some, 0, self.few[: len(some)], "clip") @ unit
        if len(new) > k:
            least = max(least, scale * (float(np.partition(score, len(new) - k)[len(new) - k]) - self.error))
        return new[score >= least / scale - self.error] if least > -math.inf else new

    def search(self, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the best k found and all that equal the k-th, in no order."""
        rows, scores, least = np.zeros(0, np.int64), np.zeros(0), -math.inf
        m, from_mean = len(code), self.codes.centred(q[None, :], True)[0]
        for t, new in enumerate(self.retrieved(code)):
            if len(new):
                new = self._hopeful(new, q, k, least)
                rows = np.append(rows, new)
                scores = np.append(scores, (self.x[new] * q).sum(1))
                if len(rows) > k:
                    least = np.partition(scores, len(scores) - k)[len(scores) - k]
                    least -= 1e-9 * abs(least)
                    keep = scores >= least
                    rows, scores = rows[keep], scores[keep]
            if len(rows) >= k:
                near = self.codes.centred(self.x[rows])
                lengths = np.linalg.norm(near, axis=1) * np.linalg.norm(from_mean)
                cosine = np.divide(near @ from_mean, lengths, out=np.zeros(len(near)), where=lengths > 0).min()
                share = math.acos(max(-1.0, min(1.0, float(cosine)))) / math.pi
                n = self.codes.n_bits
                if m * (t + 1) - 1 >= n * share + MARGIN * math.sqrt(n * share * (1 - share)):
                    break
        return rows, scores


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and the vector as packed doubles, for vectors that take part."""
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64) + 0.0  # -0.0 becomes 0.0
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                vectors.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "v"])


def _matrix(column) -> np.ndarray:
    data = list(column)
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1) if data else np.zeros((0, 1))


def _rows(vectors: DataFrame) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(_valid, "vec_id long, v binary")
    rows = written(rows.distinct(), "vectors")
    length = rows.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows if length is None else rows.where(F.length("v") == length.n)


def _longest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield pd.DataFrame({"m": [float(np.linalg.norm(_matrix(b.v), axis=1).max())]})


def fitted(classes: DataFrame, sample: int = SAMPLE) -> Codes:
    """Rotations learned on at most ``sample`` vectors, those with the smallest hashes; the longest length is of all."""
    some = classes.orderBy(F.xxhash64("v")).limit(sample).select("v").toArrow().column("v").to_pylist()
    longest = classes.select("v").mapInPandas(_longest, "m double").agg(F.max("m")).first()[0]
    return Codes(_matrix([bytes(v) for v in some]), longest or 1.0)


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = _rows(vectors)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    low = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = written(low.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0]), "vector-classes")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = spark.sparkContext.broadcast(fitted(classes))
    asked = rows.where(F.col("vec_id") % every == 0)
    # one search for all queries with one vector
    queries = written(asked.select("v").distinct().join(classes.select("v", "class"), "v"), "query-classes")
    blocks, query_blocks = -(-n // block), -(-queries.count() // query_block)
    spread = lambda count: F.pmod(F.xxhash64("class"), F.lit(max(1, count)))
    sides = classes.withColumn("b", spread(blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(max(1, query_blocks) - 1))))
    asked_sides = queries.withColumn("q", spread(query_blocks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query": [], "class": [], "score": []}
        if len(q) and len(c):
            x, y = _matrix(c.v), _matrix(q.v)
            index = Index(x, codes.value)
            names = c["class"].to_numpy()
            for name, vector, code in zip(q["class"], y, codes.value.substrings(y, query=True), strict=True):
                rows, _ = index.search(vector, code, k + 1)
                out["query"] += [name] * len(rows)
                out["class"] += names[rows].tolist()
                out["score"] += [math.fsum(p) for p in (x[rows] * vector).tolist()]
        return pd.DataFrame(out).astype({"query": "int64", "class": "int64", "score": "float64"})

    found = asked_sides.groupBy("b", "q").cogroup(sides.select("b", "q", "class", "v").groupBy("b", "q")).applyInPandas(search, "query long, class long, score double")
    ids = classes.select(F.col("class").alias("c"), "ids")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (
        found.join(ids, F.col("class") == F.col("c"))
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= k + 1)
        .groupBy("query")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("list"))
    )
    # a query's own row is not among its neighbours
    each = asked.join(classes.select("v", F.col("class").alias("query")), "v").select(F.col("vec_id").alias("query_id"), "query")
    each = each.join(lists, "query").select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return each.select("query_id", F.posexplode("list").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
