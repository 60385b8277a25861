"""Operator 13: ranked lexical search by pipelined term partitioning.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, as
64-bit hashes.  The documents are dealt into blocks; a block's postings of a term are one
row (documents, occurrences, lengths).  Only terms that some item has are posted: a bit
table of them (bounded, see ``suffixtree``) rules out nearly all others, a join the rest.

Every term is owned by one stage, by the share of the documents that hold it
(``OWNERS``): the rarest first.  The items come in bundles of ``BUNDLE``.  A bundle visits
the owners one after the other; at each, and for each block, a cogroup brings together the
accumulators the bundle carries (sparse: documents and scores of each item) and the
postings of the stage's terms that the bundle has, and adds their integer contributions.

What a bundle carries stays small, and the result exact, by bounds.  ``top`` is the largest
contribution a term makes to any document, so the stages to come add at most the sum of
their ``top``.  After each stage the tenth best score so far of an item is a score that ten
documents reach at least.  A document whose score and all that may come stay below it is no
longer carried, and no new ones are taken up once all that may come is below it.  Both
compare strictly, so ties are kept.

No task holds more than a block of documents by a bundle of items (``BLOCK`` x ``BUNDLE``
sums).  A frequent term has one row in each block, so no key is hot; the tenth best scores
come from ten rows of each item and block.

Defined cases: null or empty text of a document (no terms; not counted in N) or an item (no
rows), null doc_id (ranks after all ids of equal score), null or repeated item_id and
repeated rows (each a document or an item of its own), very long texts (whole), empty
tables (no rows), extra columns (ignored), fewer than ten matches (all of them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import table, written
from .suffixtree import _maybe, _maybe_table
from .textnum import NO_TERM, word_hashes

#: Best documents of an item.
BEST = 10
#: Documents of a block, items of a bundle.
BLOCK = 4096
BUNDLE = 256
#: A stage owns the terms held by at most this share of the documents; the last one owns all others.
OWNERS = (1 / 256, 1 / 64, 1 / 16)

_CARRIED = "block long, bundle long, item int, docs array<int>, scores array<long>"


def term_sets(items: DataFrame) -> DataFrame:
    """iid, item_id, terms of every item; ``iid`` numbers the rows, its low bits the items of a bundle."""
    ship_package(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, h, o in word_hashes(batch.column(2), space=NO_TERM):
                sets = [np.unique(h[a:b]).view(np.int64) for a, b in zip(o, o[1:])]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                terms = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
                rows = batch.slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), terms], ["iid", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("iid"), "item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"iid long, item_id {kind}, terms array<long>")


class _Block:
    """Documents and postings of a block while it fills."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.postings: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, ids: pa.Array, h: np.ndarray, offsets: np.ndarray, maybe: np.ndarray) -> None:
        sizes = np.diff(offsets)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        some = np.flatnonzero(_maybe(maybe, h))
        order = some[np.lexsort((doc[some], h[some]))]
        term, doc = h[order], doc[order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(order) else order
        tf = np.diff(np.append(new, len(order)))
        self.postings.append((term[new], (doc[new] + self.n).astype(np.int32), tf.astype(np.int32), sizes[doc[new]].astype(np.int32)))
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.n += len(sizes)

    def rows(self, block: int) -> pa.RecordBatch:
        """A row of the block's documents (no term), and one of each term."""
        term, *values = (np.concatenate(x) for x in zip(*self.postings, strict=True))
        order = np.argsort(term, kind="stable")
        term, values = term[order], [v[order] for v in values]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], first, [len(term)]]).astype(np.int32)  # the documents' row has no postings
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in values]
        sizes, m = np.concatenate(self.sizes), len(first)
        ids = pa.concat_arrays(self.ids)
        id_lists = pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (m + 1)], pa.int32()), ids)
        none = [None] * m
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(m + 1, block)),
                pa.array([None, *term[first].view(np.int64).tolist()], pa.int64()),
                *lists,
                id_lists,
                pa.array([int((sizes > 0).sum()), *none], pa.int64()),
                pa.array([int(sizes.sum()), *none], pa.int64()),
            ],
            ["block", "term", "docs", "tf", "n", "ids", "with_terms", "all_terms"],
        )


def postings(docs: DataFrame, maybe: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Rows of blocks: documents (``term`` null) and postings of the terms that the bit table lets through."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(maybe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, now = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for first, h, o in word_hashes(batch.column(1), space=NO_TERM):
                for a in range(0, len(o) - 1, block):
                    b = min(a + block, len(o) - 1)
                    if now.n and now.n + b - a > block:
                        yield now.rows(number)
                        number, now = number + 1, _Block()
                    now.add(batch.column(0).slice(first + a, b - a), h[o[a] : o[b]], o[a : b + 1] - o[a], shared.value)
        if now.n:
            yield now.rows(number)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"block long, term long, docs array<int>, tf array<int>, n array<int>, ids array<{kind}>, with_terms long, all_terms long"
    )


def impact(tf: np.ndarray, n: np.ndarray, documents: int, occurrences: int) -> np.ndarray:
    """What a term of weight 1 adds to documents of n terms that hold it tf times."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    m = 10 + 90 * n * documents // max(occurrences, 1)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weighed(posted: DataFrame, documents: int, occurrences: int) -> DataFrame:
    """term, w, top (its largest contribution to a document) and owner of every posted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tf, n = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            first = np.append(0, ends[:-1])
            most = np.maximum.reduceat(impact(tf, n, documents, occurrences), first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - first).cast(pa.int64()), pa.array(most)], ["term", "df", "most"])

    terms = posted.select("term", "tf", "n").mapInArrow(run, "term long, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    w = F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1)))
    owner = sum(((F.col("df") > share * documents).cast("int") for share in OWNERS), F.lit(0))
    return terms.select("term", w.alias("w"), (w * F.col("most")).alias("top"), owner.alias("owner"))


def _added(documents: int, occurrences: int):
    """The work of one owner on one block and bundle."""

    def run(key, carried: pa.Table, owned: pa.Table) -> pa.Table:
        block, bundle = (k.as_py() for k in key)
        lists = {c: owned.column(c).combine_chunks() for c in ("docs", "tf", "n", "items", "open", "needs")}
        docs, tf, n = (lists[c].flatten().to_numpy() for c in ("docs", "tf", "n"))
        ends = np.cumsum([0, *lists["docs"].value_lengths().to_pylist()])
        items, opened, needs = (lists[c].flatten().to_numpy(zero_copy_only=False) for c in ("items", "open", "needs"))
        item_ends = np.cumsum([0, *lists["items"].value_lengths().to_pylist()])
        have = carried.column("item").to_numpy()
        have_docs, have_scores = (carried.column(c).to_pylist() for c in ("docs", "scores"))
        width = 1 + max([int(docs.max()) if len(docs) else 0, *(max(d, default=0) for d in have_docs)])
        sums = np.zeros((BUNDLE, width), np.int64)
        for i, d, s in zip(have, have_docs, have_scores, strict=True):
            sums[i, d] = s
        closed = np.setdiff1d(items, items[opened])  # items that take up no new documents
        before = sums[closed] > 0
        add, w = impact(tf, n, documents, occurrences), owned.column("w").to_numpy()
        for k in range(owned.num_rows):
            d = docs[ends[k] : ends[k + 1]]
            sums[np.ix_(items[item_ends[k] : item_ends[k + 1]], d)] += w[k] * add[ends[k] : ends[k + 1]]
        sums[closed] *= before
        least = np.zeros(BUNDLE, np.int64)
        least[items] = needs
        sums[sums < least[:, None]] = 0
        item, doc = np.nonzero(sums)
        scores = sums[item, doc]
        at = np.append(np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else [], len(item)).astype(np.int32)
        m = len(at) - 1
        return pa.table(
            {
                "block": pa.array(np.full(m, block, np.int64)),
                "bundle": pa.array(np.full(m, bundle, np.int64)),
                "item": pa.array(item[at[:-1]].astype(np.int32)),
                "docs": pa.ListArray.from_arrays(at, pa.array(doc.astype(np.int32))),
                "scores": pa.ListArray.from_arrays(at, pa.array(scores)),
            }
        )

    return run


def _reached(carried: DataFrame) -> DataFrame:
    """iid and ``least``: the ``BEST``-th best score so far; items with fewer documents have no row."""
    best = carried.select("bundle", "item", F.explode(F.slice(F.sort_array("scores", False), 1, BEST)).alias("score"))
    nth = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.desc("score")))
    return best.withColumn("nth", nth).where(F.col("nth") <= BEST).where(F.col("nth") == BEST).select((F.col("bundle") * BUNDLE + F.col("item")).alias("iid"), F.col("score").alias("least"))


def ranked(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``BEST`` documents.  ``items``: item_id, text; ``docs``: doc_id, text."""
    spark = docs.sparkSession
    sets = written(term_sets(items), "item-terms")
    wanted = sets.select("iid", F.explode("terms").alias("term"))
    rows = written(postings(docs, _maybe_table(wanted.select(F.col("term").alias("key")).distinct())), "postings")
    posted = rows.where("term IS NOT NULL")
    documents, occurrences = (int(x or 0) for x in rows.where("term IS NULL").agg(F.sum("with_terms"), F.sum("all_terms")).first())
    terms = weighed(posted, documents, occurrences).select(F.col("term").alias("t_term"), "w", "top", "owner")
    asked = written(wanted.join(terms, F.col("term") == F.col("t_term")).drop("t_term"), "asked")

    stages = len(OWNERS) + 1
    # what the stages from each on may add to an item's documents
    rest = asked.groupBy("iid").agg(*[F.sum(F.when(F.col("owner") >= k, F.col("top")).otherwise(0)).alias(f"rest{k}") for k in range(stages + 1)])
    rest = written(rest, "rest")
    carried, least = None, None
    for stage in range(stages):
        bounds = rest if least is None else rest.join(least.withColumnRenamed("iid", "l_iid"), F.col("iid") == F.col("l_iid"), "left")
        reach = F.lit(0) if least is None else F.coalesce("least", F.lit(0))
        bounds = bounds.select(F.col("iid").alias("b_iid"), (F.col(f"rest{stage}") >= reach).alias("open"), (reach - F.col(f"rest{stage}")).alias("needs"), (reach - F.col(f"rest{stage + 1}")).alias("after"))
        owned = asked.where(F.col("owner") == stage).join(bounds, F.col("iid") == F.col("b_iid"))
        owned = owned.groupBy(F.floor(F.col("iid") / BUNDLE).alias("bundle"), F.col("term").alias("o_term"), "w").agg(
            F.collect_list(F.struct((F.col("iid") % BUNDLE).cast("int").alias("item"), "open", "after")).alias("by")
        )
        owned = owned.select("bundle", "o_term", "w", F.col("by.item").alias("items"), F.col("by.open").alias("open"), F.col("by.after").alias("needs"))
        right = posted.join(owned, F.col("term") == F.col("o_term")).select("block", "bundle", "docs", "tf", "n", "w", "items", "open", "needs")
        if carried is None:
            left = spark.createDataFrame([], _CARRIED)
        else:
            iid = F.col("bundle") * BUNDLE + F.col("item")
            left = carried.join(bounds, iid == F.col("b_iid")).select("block", "bundle", "item", F.arrays_zip("docs", "scores").alias("both"), "needs")
            left = left.withColumn("both", F.filter("both", lambda x: x["scores"] >= F.col("needs"))).where(F.size("both") > 0)
            left = left.select("block", "bundle", "item", F.col("both.docs").alias("docs"), F.col("both.scores").alias("scores"))
        both = left.groupBy("block", "bundle").cogroup(right.groupBy("block", "bundle"))
        carried = written(both.applyInArrow(_added(documents, occurrences), _CARRIED), f"carried-{stage}")
        least = written(_reached(carried), "reached")

    # the last scores: those at or above the tenth best
    found = carried.select("block", (F.col("bundle") * BUNDLE + F.col("item")).alias("iid"), F.explode(F.arrays_zip("docs", "scores")).alias("at"))
    found = found.select("block", "iid", F.col("at.docs").alias("doc"), F.col("at.scores").alias("score"))
    found = found.join(least.withColumnRenamed("iid", "l_iid"), F.col("iid") == F.col("l_iid"), "left").where(F.col("score") >= F.coalesce("least", F.lit(1)))
    ids = rows.where("term IS NULL").select(F.col("block").alias("d_block"), "ids")
    found = found.join(ids, F.col("block") == F.col("d_block")).select("iid", F.get("ids", F.col("doc")).alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("iid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).where(F.col("rank") <= BEST)
    named = sets.select(F.col("iid").alias("i_iid"), "item_id")
    return best.join(named, F.col("iid") == F.col("i_iid")).select("item_id", "rank", "doc_id", "score")


def op13_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
