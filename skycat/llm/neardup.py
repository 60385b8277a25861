"""Operator 3: near-duplicates by a signature-coordinate inverted join over MinHash.

Words are lower-cased (A-Z) runs of non-space; a document's set holds its distinct
5-word shingles as 64-bit hashes (fewer words: the whole sequence as one; none: an
empty set that links with nothing).  Documents with equal sets form a class, so groups
of copies cost one signature.

1. Every class has ``K`` MinHash coordinates and is posted under each (coordinate,
   value).  Classes that share at least T of K coordinates are candidates.  T goes with
   the similarity asked for (``least_equal``), so that a pair at exactly that similarity
   has fewer than T equal coordinates with a chance of at most 1e-5: 29 at 0.85, 25 at 0.80.
2. Prefix: a class's postings are ordered by the global frequency of their value,
   rarest first, and only the first K - T + 1 stay.  Two classes with T equal
   coordinates meet in both prefixes.  Values of one class only take places in the
   prefix and are skipped, as are values of passages that many documents share unless
   a document consists mostly of them.
3. Groups: in each posting list the class whose coordinates are commonest (the centre
   of its copies) is the hub, and all lists of one hub form one group.  Two classes that
   share a posting are in one group.  Groups above ``BLOCK_SHINGLES`` are cut into
   blocks, and each two blocks meet in a task of their own, so a group of any size is
   compared whole in bounded memory.
4. In a group the hub is counted against all members first.  Members linked with it are
   one component and are not compared with each other; every other member is counted
   against all: at least T equal coordinates, then 100 * intersection >= percent * union on
   the full shingle sets, counted through an inverted list of the group's shingles.
   Only links that join two parts are emitted (at most one per member), so a group of
   thousands of near copies gives no pair table, and no link between parts is lost.

Components come from alternating large-star and small-star steps over tables in the
shared folder; nothing about documents goes to the driver but row counts.

Defined cases: null or blank text (n_shingles 0, its own component), null doc_id
(takes part; ids are compared without nulls, kept if the whole group has none),
repeated rows (a result row each), empty tables, extra columns (ignored by the query,
kept by ``deduplicated``).

The query works at ``PERCENT``; the pipeline's stage asks for ``STAGE_PERCENT``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import WORD, table, written
from .textnum import mix, splitmix, word_hashes

#: Coordinates of a signature, words of a shingle, similarity in per cent of the query and of the pipeline's stage.
K = 48
SHINGLE = 5
PERCENT = 85
STAGE_PERCENT = 80
#: Chance at most that a pair at exactly the similarity asked for is no candidate.
MISSED = 1e-5

#: Shingles of a block of a large group (two blocks are held at once).
BLOCK_SHINGLES = 1_500_000

_STEPS = splitmix(SHINGLE, 21) | np.uint64(1)
_MULTIPLY = splitmix(K, 22) | np.uint64(1)
_ADD = splitmix(K, 23)


def least_equal(percent: int) -> int:
    """Equal coordinates that a candidate needs: the most that miss a pair at this similarity with a chance of ``MISSED``."""
    p, missed, t = percent / 100, 0.0, 0
    while t < K and (missed := missed + math.comb(K, t) * p**t * (1 - p) ** (K - t)) <= MISSED:
        t += 1
    return max(t, 1)


def _shingles(w: np.ndarray) -> np.ndarray:
    """The sorted distinct shingle hashes of one document's word hashes."""
    with np.errstate(over="ignore"):
        n = len(w)
        if n == 0:
            return w
        size = min(n, SHINGLE)
        h = np.full(n - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            h += w[k : n - size + 1 + k] * _STEPS[k]
        return np.unique(mix(h))


def _sets(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    for first, h, o in word_hashes(column):
        yield first, [_shingles(h[o[i] : o[i + 1]]) for i in range(len(o) - 1)]


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, sets in _sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            sig = np.zeros((len(sets), K), np.uint32)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                with np.errstate(over="ignore"):
                    for k in range(K):
                        v = (every * _MULTIPLY[k] + _ADD[k]) >> np.uint64(32)
                        sig[full, k] = np.minimum.reduceat(v, at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, len(sets)),
                    batch.column(2).slice(first, len(sets)),
                    pa.array(sizes),
                    pa.array([_print(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * K, K, dtype=np.int32), pa.array(sig.view(np.int32).ravel())),
                ],
                ["doc_id", "text_hash", "n_shingles", "print", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([_print(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["print", "shingles"]
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, a 128-bit print of the shingle set, and K MinHash coordinates."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    return rows.mapInArrow(_signatures, f"doc_id {kind}, text_hash long, n_shingles long, print binary, sig array<int>")


def _text_hash() -> Column:
    return F.xxhash64("text")


def prefix_postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(print, token, weight): the rare part of each class's postings that other classes share.

    ``weight`` is the sum of the frequencies of all the class's shared values.
    """
    posts = classes.select("print", F.posexplode("sig").alias("k", "v")).select(
        "print", (F.col("k").cast("long") * (1 << 32) + F.col("v").cast("long") + (1 << 31)).alias("token")
    )
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    p = posts.join(shared, "token")
    mine = Window.partitionBy("print")
    rare_first = mine.orderBy("df", "token")
    p = p.withColumn("nth", F.row_number().over(rare_first)).withColumn("n", F.count("*").over(mine)).withColumn("weight", F.sum("df").over(mine))
    return p.where(F.col("nth") <= F.col("n") - (least_equal(percent) - 1)).select("print", "token", "weight")


def group_links(sets: list[np.ndarray], sig: np.ndarray, hub: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the parts of one group, as pairs of positions; ``hub`` is tried first."""
    sizes = np.array([len(x) for x in sets])
    n, least = len(sets), least_equal(percent)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    values = every[order]
    member = np.repeat(np.arange(n), sizes)[order]
    root = np.arange(n)
    links: list[tuple[int, int]] = []

    def compare(i: int) -> None:
        open_ = (root != root[i]) & ((sig == sig[i]).sum(1) >= least)
        open_ &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
        if not open_.any():
            return
        # merge the inverted lists of this member's shingles
        first, last = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        count = last - first
        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(member[at], minlength=n)
        for j in np.flatnonzero(open_ & (100 * both >= percent * (sizes + sizes[i] - both))).tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]

    compare(hub)
    for i in np.flatnonzero(root != root[hub]).tolist():
        compare(i)
    return links


def _compared(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    rows = rows.drop_duplicates("print")
    prints, hub = rows["print"].tolist(), bytes(rows["hub"].iloc[0])
    names = [bytes(x) for x in prints]
    sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
    sig = np.array(rows["sig"].tolist(), np.int32).reshape(len(rows), K)
    links = group_links(sets, sig, names.index(hub) if hub in names else 0, percent)
    return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype=object)


def grouped(posts: DataFrame) -> DataFrame:
    """(hub, print): the members of each hub's posting lists, the hub among them."""
    hubs = posts.groupBy("token").agg(F.max(F.struct("weight", "print")).alias("hub"), F.count("*").alias("n")).where("n > 1")
    return posts.join(hubs, "token").select(F.col("hub.print").alias("hub"), "print").distinct()


def links_of(groups: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) that connect all linked classes of each group."""
    members = groups.select("print").distinct().join(classes, "print")
    some_doc = members.select("some.*").distinct().select(F.col("doc_id").alias("some_id"), F.col("text_hash").alias("some_hash"))
    mine = F.col("doc_id").eqNullSafe(F.col("some_id")) & (_text_hash() == F.col("some_hash"))
    texts = docs.select("doc_id", "text").join(some_doc, mine, "left_semi")
    sets = texts.mapInArrow(_full_sets, "print binary, shingles binary").groupBy("print").agg(F.first("shingles").alias("shingles"))
    sized = groups.join(classes.select("print", "n_shingles"), "print")
    volume = sized.groupBy("hub").agg((F.floor(F.sum("n_shingles") / BLOCK_SHINGLES) + 1).cast("int").alias("blocks"))
    placed = groups.join(volume, "hub").withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    # a member of block i goes to every pair of blocks with i in it; the hub to all pairs
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")),
    )
    all_pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda i: F.transform(F.sequence(i, F.col("blocks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j"))),
        )
    )
    dealt = placed.select("hub", "print", F.explode(F.when(F.col("print") == F.col("hub"), all_pairs).otherwise(pairs)).alias("at"))
    rows = dealt.join(sets, "print").join(classes.select("print", "sig"), "print")
    return rows.select("hub", "at", "print", "shingles", "sig").groupBy("hub", "at").applyInPandas(lambda rows: _compared(rows, percent), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the connected components of links (a, b); root is the smallest node."""
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    total = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    state = total(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        e = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "stars",
        )
        now = total(e)
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        state = now


def linked(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signature rows of all documents, (print, root) of the classes that link with others)."""
    sigs = written(signatures(docs), "signatures")
    classes = written(
        sigs.where("n_shingles > 0").groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("some"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")),
        "classes",
    )
    posts = written(prefix_postings(classes, percent), "postings")
    groups = written(grouped(posts), "groups")
    links = written(links_of(groups, docs, classes, percent), "confirmed")
    return sigs, components(links).select(F.col("node").alias("print"), "root")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sigs, roots = linked(docs, percent)
    roots = written(roots, "roots").select(F.col("print").alias("r_print"), "root")
    # one row per class first, so that a class with a third of all rows is one row where groups meet
    classes = sigs.where("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("low"))
    placed = classes.join(roots, F.col("print") == F.col("r_print"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = placed.join(lowest, "root").select(F.col("print").alias("c_print"), "component_id")
    full = sigs.where("n_shingles > 0").select("doc_id", "n_shingles", "print")
    out = full.join(ids, F.col("print") == F.col("c_print")).select("doc_id", "n_shingles", "component_id")
    empty = sigs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """One row of each near-duplicate group, with all its columns; rows without words all stay.

    The row with the smallest doc_id (nulls last), then print, then hash of the text; of rows
    with one doc_id and text the one whose columns come first.  An empty table stays empty.

    The winner is found on narrow rows; whole rows are read once, by a semi join on (doc_id,
    hash of the text), and only rows that share both with another are grouped.
    """
    sigs, roots = linked(docs, percent)
    roots = written(roots, "roots").select(F.col("print").alias("r_print"), "root")
    full = sigs.where("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = full.groupBy("print").agg(F.min(key).alias("low"))
    placed = classes.join(roots, F.col("print") == F.col("r_print"), "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    best = F.min(F.struct("low.none", "low.doc_id", "print", "low.text_hash")).alias("won")
    won = placed.groupBy("root").agg(best).select(F.col("won.doc_id").alias("w_id"), F.col("won.text_hash").alias("w_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))
    times = full.join(won, same).groupBy("w_id", "w_hash").agg(F.count("*").alias("times"))
    won = written(times, "won")

    kept = docs.columns
    mine = F.col("doc_id").eqNullSafe(F.col("w_id")) & (_text_hash() == F.col("w_hash"))
    inked = docs.where(F.col("text").rlike(WORD))
    single = inked.join(won.where("times = 1"), mine, "left_semi")
    rows = inked.join(won.where("times > 1"), mine, "left_semi").select(F.struct(*kept).alias("row"))
    one = rows.groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash")).agg(F.min_by("row", F.to_json("row")).alias("row"))
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(WORD))
    return single.union(one.select(*[F.col("row")[c].alias(c) for c in kept])).union(blank)


def op3_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)
