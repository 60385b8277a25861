"""Operator 2: language-model scores by a probabilistic suffix tree over words.

Symbols are lower-cased (A-Z) words and one end per text.  The root gives
P0(x) = (c(x) + 0.5) / (N + 0.5 * (V + 1)).  A state is a context of up to three words.

Learning reads all training texts, and nothing in it depends on the size of the corpus:
1. Counts of all words (Spark: pre-aggregated per task, summed by word).
2. Counts of all sequences of two, three and four words, one length after the other.  A
   sequence seen ``LEAST_ENTRY`` times has parts seen as often, and a context is seen
   ``LEAST_COUNT`` times, so tasks skip sequences with a part that a bit table of the
   shorter ones rules out.  The bit table has a bound;
   a full one rules out less and costs time, never a count.
3. Divergence test, from short to long, by joins and groups in Spark: a context seen
   ``LEAST_COUNT`` times stays if its smoothed distribution describes what follows it
   better than its suffix's state does, by ``LEAST_GAIN`` nats over the corpus (count *
   Kullback-Leibler divergence).  States and entries stay tables.
Smoothing: P(x | s) = (c(sx) - DISCOUNT) / c(s) for entries, and the mass left over in
proportion to the suffix's distribution for all other words, so each state is a
distribution over all words.

Scoring: each token's state is the longest suffix of the words before it that stayed.
Its log probability is that of the root plus a value of each context that stayed and of
each entry, so a row's score is a sum over looked-up keys.  Words above ``TABLE_SHARE``
of all tokens and the ``HOT_ROWS`` most frequent states and entries of each length are
looked up in the task; all others go through one join by key and are summed by row.

Defined cases: null, empty or blank text (the end alone), null doc_id (trains, as
crc32 of an empty text is 0), repeated rows (each counts, each has its row), no
training rows (N = V = 0), empty tables, extra columns (ignored).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import table, written
from .textnum import mix, splitmix, word_hashes

TABLE_SHARE = 5e-7
#: Rows of each length's states and entries that are sent to the tasks; the others are joined.
HOT_ROWS = 1_000_000
#: Sequences that are summed together, about, and the least number of such blocks.
BLOCK_ROWS = 250_000
LEAST_BLOCKS = 512
#: Rows of the look-up table that a task of its join holds, about.
JOINED_ROWS = 250_000
#: Most 64-bit words of a bit table.
MAYBE_WORDS = 1 << 21
LENGTHS = 3
LEAST_COUNT = 8
LEAST_ENTRY = 4
DISCOUNT = 0.75
LEAST_GAIN = 12.0
#: An entry needs this many nats over the corpus by itself.
ENTRY_GAIN = 3.0

END = np.uint64(0x9D5C3F1B7A2E4861)
_OLDER, _NEWER = splitmix(2, 31) | np.uint64(1)
#: Keys of states differ by this from those of the entries that end in the same words.
_STATE = 0x5B1E6C93A7D40F25


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted ``keys``; -1 where absent."""
    if len(keys) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class _Directory:
    """Look-up in sorted keys that are hashes, so evenly spread: by the first bits, then a step or two."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, len(keys).bit_length() - 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of ``wanted``; -1 where absent."""
        last = len(self.keys) - 1
        if last < 0:
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(self.starts[wanted >> self.shift], last).astype(np.int64)
        behind = np.flatnonzero((self.keys[at] < wanted) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.keys[at[behind]] < wanted[behind]) & (at[behind] < last)]
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass
class Order:
    """The hot states and entries of one context length, by sorted keys of their words."""

    contexts: np.ndarray
    log_rest: np.ndarray  # log10 of the factor of the suffix's probability; 0 for words that are no state
    entries: np.ndarray
    log_p: np.ndarray
    added: np.ndarray  # log10 P less that of the suffix's state and less the context's log_rest


@dataclass
class Tree:
    words: np.ndarray  # sorted hashes of words above TABLE_SHARE
    log_p0: np.ndarray
    total: int
    distinct: int
    orders: list[Order]
    maybe: np.ndarray  # bit table of all states and entries
    cold: bool  # some states or entries are not in orders
    directories: dict[int, _Directory] = field(default_factory=dict)  # of the key arrays, made by a worker when first asked for

    def find(self, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Positions in one of the tree's key arrays; -1 where absent."""
        if id(keys) not in self.directories:
            self.directories[id(keys)] = _Directory(keys)
        return self.directories[id(keys)].find(wanted)


def _tokens(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and an end per row; the rows' first positions."""
    n = len(offsets) - 1
    out = np.full(len(h) + n, END, np.uint64)
    starts = offsets[:-1] + np.arange(n)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(offsets))] = h
    return out, starts


def _sequence(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Key of n words from the keys of the first and of the last n - 1."""
    with np.errstate(over="ignore"):
        return mix(older * _OLDER + newer * _NEWER)


def _grams(tokens: np.ndarray, starts: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the 1 to n words that end at each token, and each token's place in its row."""
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    out = [tokens]
    for _ in range(1, n):
        g = out[-1]
        out.append(np.append(np.zeros(min(1, len(g)), np.uint64), _sequence(g[:-1], g[1:])))
    return out, place


def _maybe_table(df: DataFrame) -> np.ndarray:
    """A bit table of ``key``, two bits in one word for each; made in Spark, at most ``MAYBE_WORDS`` long."""
    n = 1 << max(10, min(MAYBE_WORDS.bit_length() - 1, (df.count() // 3).bit_length()))
    bit = "shiftleft(1L, cast(shiftright(key, {}) & 63 as int))"
    t = df.groupBy(F.expr(f"pmod(key, {n}L)").alias("at")).agg(F.expr(f"bit_or({bit.format(32)} | {bit.format(40)})").alias("bits")).toArrow()
    out = np.zeros(n, np.uint64)
    out[t.column("at").to_numpy()] = t.column("bits").to_numpy().view(np.uint64)
    return out


def _maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False where a key is certainly not in the table."""
    one, at = np.uint64(1), np.uint64(63)
    bits = (one << ((keys >> np.uint64(32)) & at)) | (one << ((keys >> np.uint64(40)) & at))
    return table[keys & np.uint64(len(table) - 1)] & bits == bits


class _Counter:
    """Sums of counts by 64-bit key with bounded memory; ``take`` empties it."""

    LIMIT = 1_500_000

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.held += len(k)
        if self.held > self.LIMIT:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            k, where = np.unique(np.concatenate(self.keys), return_inverse=True)
            c = np.bincount(where, np.concatenate(self.counts), len(k)).astype(np.int64)
            self.keys, self.counts, self.held = [k], [c], len(k)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.merge()
        if self.keys:
            yield self.keys[0], self.counts[0].astype(np.int64)
        self.__init__()


def _counts(docs: DataFrame, keys_of) -> DataFrame:
    """(kind, key, c) over the training rows; ``keys_of(h, offsets)`` yields (kind, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, _Counter] = {}

        def rows(counter: _Counter, kind: int) -> Iterator[pa.RecordBatch]:
            for k, c in counter.take():
                for i in range(0, len(k), 200_000):
                    some = k[i : i + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(c[i : i + 200_000])], ["kind", "key", "c"])

        for batch in batches:
            for _, h, o in word_hashes(batch.column(0)):
                for kind, keys in keys_of(h, o):
                    counter = sums.setdefault(kind, _Counter())
                    counter.add(keys)
                    if counter.held > counter.LIMIT:
                        yield from rows(counter, kind)
        for kind, counter in sums.items():
            yield from rows(counter, kind)

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "kind int, key long, c long").groupBy("kind", "key").agg(F.sum("c").alias("c"))


class _Sequences:
    """Counts of sequences (older part, newer part) with bounded memory; ``take`` empties it."""

    LIMIT = 500_000

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, older: np.ndarray, newer: np.ndarray, c: np.ndarray | None = None) -> None:
        if len(older) == 0:
            return
        key = _sequence(older, newer)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        del key
        c = np.diff(np.append(first, len(order))) if c is None else np.add.reduceat(c[order], first)
        first = order[first]
        del order
        self.parts.append((older[first], newer[first], c))
        self.held += len(first)
        if self.held > self.LIMIT:
            self.merge()

    def merge(self) -> None:
        if len(self.parts) > 1:
            columns = [list(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.held = [], 0
            every = []
            while columns:  # one column's parts are let go before the next are joined
                every.append(np.concatenate(columns.pop(0)))
            self.add(*every)

    def take(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for older, newer, c in self.parts:
            for i in range(0, len(c), 200_000):
                j = i + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(older[i:j].view(np.int64)), pa.array(newer[i:j].view(np.int64)), pa.array(c[i:j])], ["ctx", "suf", "c"])
        self.__init__()


def _blocks(key: np.ndarray, columns: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Sorted keys' values of 64 bits as one row for each block: those whose keys share their first bits."""
    block = (key >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(key) else np.zeros(0, np.int64)
    offsets = pa.py_buffer((np.append(first, len(key)) * 8).astype(np.int32))
    values = [pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(c))]) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(block[first]), *values], ["block", "ctx", "suf", "c"])


def _summed(block: pa.Table) -> pa.Table:
    """The sequences of one block that were seen ``LEAST_ENTRY`` times."""
    older, newer, c = (np.frombuffer(b"".join(block.column(n).to_pylist()), kind) for n, kind in (("ctx", np.uint64), ("suf", np.uint64), ("c", np.int64)))
    key = _sequence(older, newer)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    c = np.add.reduceat(c[order], first)
    enough = c >= LEAST_ENTRY
    first, c = first[enough], c[enough]
    columns = [older[order[first]].view(np.int64), newer[order[first]].view(np.int64), c, key[first].view(np.int64)]
    return pa.table(dict(zip(("ctx", "suf", "c", "key"), columns, strict=True)))


def _parts_table(shorter: DataFrame) -> np.ndarray:
    """A bit table of the sequences' parts: ``key`` of what may come last, and by another key of what may be a context."""
    contexts = shorter.where(F.col("c") >= LEAST_COUNT).select(F.col("key").bitwiseXOR(F.lit(_STATE)).alias("key"))
    return _maybe_table(shorter.select("key").union(contexts))


def _sequence_counts(docs: DataFrame, n: int, shorter: np.ndarray, total: int) -> DataFrame:
    """(ctx, suf, c, key) of the sequences of n words seen ``LEAST_ENTRY`` times whose parts are in the table ``shorter``;
    ctx and suf are without the last and the first word.

    Most sequences are seen once, so Spark shuffles and groups blocks of them instead of
    rows; there are as many blocks as the corpus' ``total`` words need.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shorter)
    bits = max(LEAST_BLOCKS - 1, total // BLOCK_ROWS).bit_length()

    def packed(sums: _Sequences) -> Iterator[pa.RecordBatch]:
        for b in sums.take():
            older, newer, c = (x.to_numpy() for x in b.columns)
            older, newer = older.view(np.uint64), newer.view(np.uint64)
            yield _blocks(_sequence(older, newer), [older, newer, c], bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, maybe = _Sequences(), shared.value
        for batch in batches:
            for _, h, o in word_hashes(batch.column(0)):
                grams, place = _grams(*_tokens(h, o), n - 1)
                i = np.flatnonzero(place >= n - 1)
                i = i[_maybe(maybe, grams[-1][i])]
                i = i[_maybe(maybe, grams[-1][i - 1] ^ np.uint64(_STATE))]
                sums.add(grams[-1][i - 1], grams[-1][i])
                if sums.held > sums.LIMIT:
                    yield from packed(sums)
        yield from packed(sums)

    blocks = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "block int, ctx binary, suf binary, c binary")
    return blocks.groupBy("block").applyInArrow(_summed, "ctx long, suf long, c long, key long")


def _sorted(df: DataFrame, key: str, *values: str) -> tuple[np.ndarray, ...]:
    """Columns of a table of bounded size, by ascending unsigned key."""
    t = df.select(key, *values).toArrow()
    k = t.column(key).to_numpy().view(np.uint64)
    order = np.argsort(k)
    return (k[order], *(t.column(v).to_numpy()[order] for v in values))


def _hot(df: DataFrame) -> DataFrame:
    """``df`` with ``hot``: whether a row is among the ``HOT_ROWS`` with the highest c (whole steps of log2 c)."""
    step = F.floor(F.log2("c") * 8)
    least, held = math.inf, 0
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):
        held += r["count"]
        if held > HOT_ROWS:
            break
        least = r["step"]
    return df.withColumn("hot", step >= F.lit(float(least)))


def _tested(grams: DataFrame, shorter: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (ctx, c, log_rest) of one length, and its sequences (key, c, log_p, added), ``added`` for entries only.

    ``shorter``: key, c and log_p of the sequences one word shorter, by the states one word shorter.
    """
    contexts = shorter.where(F.col("c") >= LEAST_COUNT).select(F.col("key").alias("ctx"), F.col("c").alias("c_s"))
    below = shorter.select(F.col("key").alias("suf"), F.col("log_p").alias("log_below"))
    p, p_below = (F.col("c") - DISCOUNT) / F.col("c_s"), F.pow(F.lit(10.0), "log_below")
    e = grams.join(contexts, "ctx").join(below, "suf").select("key", "ctx", "c", "c_s", "log_below", p.alias("p"), p_below.alias("p_below"))
    gain = F.col("c") * F.log(F.col("p") / F.col("p_below"))
    e = e.withColumn("gain", F.when((F.col("p") > F.col("p_below")) & (gain >= ENTRY_GAIN), gain))
    left = lambda x: F.greatest(1 - F.sum(x), F.lit(1e-9))
    sums = e.where("gain IS NOT NULL").groupBy("ctx").agg(
        F.max("c_s").alias("c"), (left("p") / left("p_below")).alias("rest"), F.sum("gain").alias("gain"), F.sum("c").alias("c_entries")
    )
    stays = F.col("gain") + (F.col("c") - F.col("c_entries")) * F.log("rest") >= LEAST_GAIN
    states = written(sums.where(stays).select("ctx", "c", F.log10("rest").alias("log_rest")), "states")
    j = e.join(states.select("ctx", "log_rest"), "ctx", "left")
    other = F.col("log_below") + F.coalesce("log_rest", F.lit(0.0))
    entry = F.col("gain").isNotNull() & F.col("log_rest").isNotNull()
    log_p = F.when(entry, F.log10("p")).otherwise(other)
    return states, j.select("key", "c", log_p.alias("log_p"), F.when(entry, F.log10("p") - other).alias("added"))


def _added(tree: Tree, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """What the hot states and entries add to log10 P0 of each token; (positions, keys) to be looked up in the table."""
    out, open_ = np.zeros(len(words)), []
    grams, place = _grams(words, starts, len(tree.orders) + 1)
    for length, order in enumerate(tree.orders, 1):
        at = np.flatnonzero(place >= length)
        for back, salt, known, values in ((1, np.uint64(_STATE), order.contexts, order.log_rest), (0, np.uint64(0), order.entries, order.added)):
            keys = grams[length - back][at - back]
            some = _maybe(tree.maybe, keys ^ salt)
            keys, at = keys[some], at[some]  # only states have entries
            found = tree.find(known, keys)
            here = found >= 0
            out[at[here]] += values[found[here]]
            if tree.cold:
                open_.append((at[~here], keys[~here] ^ salt))
    return out, open_


def _state(tree: Tree, symbols: list[np.ndarray], log_p: np.ndarray) -> np.ndarray:
    """log10 P of symbols[0] after symbols[1], symbols[2], ... (nearest first), from log10 P0, by the hot part."""
    n, m = len(symbols[0]), len(symbols)
    words = np.array(symbols[::-1]).T.reshape(-1)
    rows = np.where(words >= 0, tree.words[words], np.uint64(0))
    return log_p + _added(tree, rows, np.arange(0, n * m, m))[0][m - 1 :: m]


def learned(docs: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree's part for the tasks, and the table of all else: (key, c) of all training words,
    (key, value) of the states and entries that are not in the tree.  ``docs``: held_out, text."""

    def words_of(h, o):
        yield 0, _tokens(h, o)[0]

    unigrams = written(_counts(docs, words_of).select("key", "c"), "words")
    looked_up = unigrams.select("key", "c", F.lit(None).cast("double").alias("value"))
    total, distinct = (int(x or 0) for x in unigrams.agg(F.sum("c"), F.count("*")).first())
    listed = max(1.0, TABLE_SHARE * total)
    log_p0 = F.log10((F.col("c") + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    words, log_p = _sorted(unigrams.where(F.col("c") >= listed).withColumn("log_p", log_p0), "key", "log_p")
    tree = Tree(words, log_p, total, distinct, [], np.zeros(1, np.uint64), False)
    if total == 0:
        return tree, looked_up

    shorter = unigrams.where(F.col("c") >= LEAST_ENTRY).withColumn("log_p", log_p0)
    every = None
    for length in range(1, LENGTHS + 1):
        grams = written(_sequence_counts(docs, length + 1, _parts_table(shorter), total), "sequences")
        states, sequences = _tested(grams, shorter)
        # the longest are of use as entries only
        shorter = written(sequences if length < LENGTHS else sequences.where("added IS NOT NULL"), "tested")
        entries = _hot(shorter.where("added IS NOT NULL"))
        states = states.withColumn("hot", F.col("c") >= listed) if length == 1 else _hot(states)
        contexts, log_rest = _sorted(states.where("hot"), "ctx", "log_rest")
        if length == 1:  # one for each listed word
            at = _find(contexts, words)
            contexts, log_rest = words, np.where(at >= 0, log_rest[at] if len(log_rest) else 0.0, 0.0)
        tree.orders.append(Order(contexts, log_rest, *_sorted(entries.where("hot"), "key", "log_p", "added")))
        values = entries.select("key", F.col("added").alias("value"), "hot").union(
            states.select(F.col("ctx").bitwiseXOR(F.lit(_STATE)), "log_rest", "hot")
        )
        every = values if every is None else every.union(values)
    tree.maybe = _maybe_table(every)
    cold = every.where("NOT hot")
    tree.cold = bool(cold.take(1))
    return tree, looked_up.union(cold.select("key", F.lit(None).cast("long"), "value")) if tree.cold else looked_up


def scored(docs: DataFrame, tree: Tree, looked_up: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for first, h, o in word_hashes(batch.column(3)):
                rows = batch.slice(first, len(o) - 1)
                tokens, starts = _tokens(h, o)
                at = tree.find(tree.words, tokens)
                listed = at >= 0
                base = np.where(listed, tree.log_p0[at] if len(tree.log_p0) else 0.0, 0.0)
                added, open_ = _added(tree, tokens, starts)
                score = base + added
                n = len(starts)
                row = np.repeat(np.arange(n), np.diff(np.append(starts, len(tokens))))
                rid = rows.column(0).to_numpy()
                total = lambda v: pa.array(np.bincount(row, v, n))  # noqa: B023, E731
                count = lambda v: pa.array(np.bincount(row, v, n).astype(np.int64))  # noqa: B023, E731
                # the row's own sums; its key only spreads these rows over the tasks
                own = pa.StructArray.from_arrays(
                    [rows.column(1), rows.column(2), count(None), count(listed), total(base), total(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"],
                )
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(mix(rid.astype(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), own],
                    ["rid", "word", "tf", "own"],
                )
                rare = np.flatnonzero(~listed)
                open_.append((rare, tokens[rare]))
                for k, (places, w) in enumerate(open_):
                    if not len(w):
                        continue
                    # by row and the word's first bits: words that share them only give more rows to be summed
                    order = np.argsort(row[places].astype(np.uint64) << np.uint64(44) | w >> np.uint64(20))
                    w, r = w[order], row[places[order]]
                    new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (r[1:] != r[:-1])))
                    m = len(new)
                    tf = np.diff(np.append(new, len(w))) * (1 if k == len(open_) - 1 else -1)  # above 0 for words only
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid[r[new]]), pa.array(w[new].view(np.int64)), pa.array(tf), pa.nulls(m, own.type)],
                        ["rid", "word", "tf", "own"],
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(
        run, f"rid long, word long, tf long, own struct<doc_id: {kind}, held_out: boolean, n_tokens: long, n_known: long, base: double, score: double>"
    )
    # the keys are hashes and each is summed by row, so the parts are even; more parts than the table needs only give more sums by row
    n_parts = max(docs.sparkSession.sparkContext.defaultParallelism, looked_up.count() // JOINED_ROWS + 1)
    held = looked_up.repartition(n_parts, "key").hint("shuffle_hash")
    j = parts.repartition(n_parts, "word").join(held, F.col("word") == F.col("key"), "left")
    rare = F.when(F.col("tf") > 0, F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(tree.total + 0.5 * (tree.distinct + 1))))
    j = j.select(
        "rid", "own.doc_id", "own.held_out", "own.n_tokens",
        F.coalesce("own.n_known", F.when((F.col("tf") > 0) & F.col("c").isNotNull(), F.col("tf"))).alias("n_known"),
        F.coalesce("own.base", rare).alias("base"),
        F.coalesce("own.score", rare, -F.col("tf") * F.col("value")).alias("score"),
    )
    return j.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("rid")


def with_fold(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return docs.select("doc_id", (fold == 1).alias("held_out"), F.col("text").cast("string").alias("text"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = with_fold(table(spark, sf_dir, "documents"))
    return scored(docs, *learned(docs))
