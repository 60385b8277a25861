"""Operator 12: packing documents into sequences by bin completion with branch and bound.

A document's ids and its end id are one piece; only longer ones than a sequence are cut,
the first piece taking what is over, so that all others fill a sequence each.

What a packing looks like depends on how many pieces there are of each length, so it is
found on that histogram: at most ``LENGTH`` numbers, whatever the corpus.

1. Incumbent: best-fit decreasing, for all pieces of one length at once.
2. Lower bound: ceil(ids / LENGTH), and the bound of Martello and Toth that counts pieces
   which cannot share a sequence.  An incumbent that meets it is optimal.
3. Bin completion: around the longest piece left, the fillings of one to four pieces that
   leave least room are listed, those that another dominates (it puts one longer piece in
   place of some, in the room left over) are left out, and the best are tried in turn,
   each as often as the pieces allow.  A branch ends when the room given away exceeds what
   the incumbent less one sequence would leave; a packing with fewer sequences becomes the
   incumbent.  ``NODES`` bounds the search, which then keeps the incumbent.

The result is a list of fillings, each with its number of sequences (a filling uses up a
length, so they are few thousand at most).  A piece finds its place by its length and its
number among the pieces of that length.  That number is a running number within the task
that encoded the piece plus a sum over the tasks before: no piece is shuffled for it by
its length, so a length that a third of all pieces have is no hot key.

Encoding: the byte-level BPE of the tokenizer file, by ``tiktoken``, which takes a third of
the time that the tokenizers library does for the same ids; the file's merges are checked
to be in the order of their ids, which is what makes the two agree.

Defined cases: null or empty text (the end id alone), very long texts (cut), null doc_ids
and repeated rows (pieces of their own), empty tables (no rows), extra columns (ignored).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import table, written

LENGTH = 2048
END_ID = 0
#: Nodes of the search, fillings tried at each, longest pieces that a filling of four begins with.
NODES = 4000
BRANCHES = 6
LEADS = 6
#: Runs of white space that tiktoken's pattern matcher may not get through; the tokenizers library encodes such texts.
WIDE = r"[\s\v\x{85}\p{Z}]{1000}"


# encoding


def byte_names() -> dict[str, int]:
    """The character that stands for each byte in the names of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file of the tokenizers library, its ids as ranks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    names, vocabulary = byte_names(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in pairs]
    if order != sorted(set(order)):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    return {bytes(names[c] for c in name): i for name, i in vocabulary.items()}


_coders: dict[tuple[str, str], object] = {}


def coder(path: str, pattern: str):
    """(text -> ids, text with very long runs of white space -> ids), kept by the worker."""
    if (path, pattern) not in _coders:
        import tiktoken
        from tokenizers import Tokenizer

        plain = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens={}).encode_ordinary
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        _coders[path, pattern] = plain, lambda text: whole.encode(text, add_special_tokens=False).ids
    return _coders[path, pattern]


def ids_of(texts: pa.Array, path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of each text; null is empty."""
    plain, spaced = coder(path, pattern)
    wide = pc.match_substring_regex(texts, WIDE).to_pylist()
    for text, w in zip(texts, wide, strict=True):
        yield (spaced if w else plain)(text.as_py() or "")


def pieces(docs: DataFrame, path: str, pattern: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the task's number and the piece's number among its pieces of that length."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        met = np.zeros(length + 1, np.int64)
        for batch in batches:
            rows, which = [], []
            for k, found in enumerate(ids_of(batch.column(1), path, pattern)):
                ids = np.array([*found, end_id], "<u4")
                first = (len(ids) - 1) % length + 1
                cuts = [0, *range(first, len(ids) + 1, length)]
                packed = memoryview(ids.tobytes())
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    which.append(k)
                    rows.append((n, a, b - a, zlib.crc32(packed[4 * a : 4 * b])))
            piece, start, size, crc = np.array(rows, np.int64).reshape(-1, 4).T
            order = np.argsort(size, kind="stable")
            _, begin, count = np.unique(size[order], return_index=True, return_counts=True)
            nth = np.empty(len(size), np.int64)
            nth[order] = np.arange(len(size)) - np.repeat(begin, count) + met[size[order]]
            met += np.bincount(size, minlength=length + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), pa.array(piece.astype(np.int32)), *map(pa.array, (start, size, crc)), pa.array(np.full(len(size), task)), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long"
    )


# packing a histogram


@dataclass
class Packing:
    """Fillings (lengths, longest first) and how many sequences have each."""

    fillings: list[tuple[tuple[int, ...], int]] = field(default_factory=list)

    def __len__(self) -> int:
        return sum(n for _, n in self.fillings)


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that any packing of ``counts[size]`` pieces needs (sizes up to len(counts) - 1)."""
    room = len(counts) - 1
    size = np.arange(room + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * size)
    upto = lambda sums, x: int(sums[x]) if x >= 0 else 0
    best = -(-int(total[-1]) // room)
    half = room // 2
    for least in range(half + 1):  # pieces shorter than ``least`` are left out
        alone = upto(number, room) - upto(number, room - least)
        halves = upto(number, room - least) - upto(number, half)
        free = halves * room - (upto(total, room - least) - upto(total, half))
        small = upto(total, half) - upto(total, least - 1)
        best = max(best, alone + halves + max(0, -(-(small - free) // room)))
    return best


def best_fit(counts: np.ndarray) -> Packing:
    """Best-fit decreasing; sequences of equal content are handled together."""
    room = len(counts) - 1
    open_: dict[int, list[list]] = {}  # room left -> [lengths, sequences]
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(content: tuple[int, ...], left: int, n: int) -> None:
        if n and left:
            open_.setdefault(left, []).append([content, n])
        elif n:
            closed.append((content, n))

    for size in range(room, 0, -1):
        n = int(counts[size])
        while n:
            fits = [r for r in open_ if r >= size]
            if fits:
                left = min(fits)
                content, have = open_[left].pop()
                if not open_[left]:
                    del open_[left]
            else:
                left, content, have = room, (), n
            each = left // size  # the sequence just begun has the least room, so it goes on
            full = min(have, n // each)
            put(content + (size,) * each, left - each * size, full)
            n -= full * each
            rest = n if full < have and n < each else 0
            if rest:
                put(content + (size,) * rest, left - rest * size, 1)
                n = 0
            if content:
                put(content, left, have - full - (1 if rest else 0))
    return Packing(closed + [(c, n) for groups in open_.values() for c, n in groups])


def _dominated(filling: tuple[int, ...], waste: int, fit: np.ndarray, counts: np.ndarray) -> bool:
    """Whether one piece that is left could take the place of some of the filling's, in the same room."""
    sums = {0: 0}
    for x in filling:
        sums |= {s + x: n + 1 for s, n in sums.items()}
    for total, n in sums.items():
        if n:
            other = int(fit[min(total + waste, len(fit) - 1)])  # the longest piece that is left and fits there
            spare = counts[other] - filling.count(other)
            if spare > 0 and (other > total or (other == total and n > 1)):
                return True
    return False


def fillings(counts: np.ndarray, room: int, most_waste: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, waste) of the best undominated fillings of ``room`` with the pieces left, or none.

    The longest pieces go in until four more could fill what is left; those are searched for.
    """
    counts = counts.copy()
    base: list[int] = []

    def longest_upto(limit: int) -> np.ndarray:
        """The longest piece left up to each length."""
        have = np.where(counts[: limit + 1] > 0, np.arange(limit + 1), 0)
        return np.maximum.accumulate(have)

    fit = longest_upto(room)
    while 0 < 4 * (x := int(fit[room])) < room:
        times = min(int(counts[x]), room // x - 3)
        base += [x] * times
        counts[x] -= times
        room -= x * times
        fit = longest_upto(room)
    if fit[room] == 0:
        return [(tuple(base), room)] if room <= most_waste else []
    found: dict[tuple[int, ...], int] = {}

    def add(*lengths: int) -> bool:
        """Note a filling; whether it leaves no room."""
        f = tuple(sorted((int(x) for x in lengths if x), reverse=True))
        waste = room - sum(f)
        if waste > most_waste or any(f.count(x) > counts[x] for x in set(f)):
            return False
        found[f] = waste
        return waste == 0

    if add(fit[room]):
        return [((*base, room), 0)]  # a piece that fits exactly dominates all else
    longest = np.flatnonzero(counts[: room + 1])[::-1]
    longest = longest[longest > 0]

    def pairs(left: int, *before: int) -> bool:
        """The best two pieces for ``left``."""
        a = longest[longest <= left]
        if len(a) == 0:
            return False
        most = np.minimum(left - a, a)
        b = fit[most]
        b = np.where((b == a) & (counts[a] < 2), fit[np.maximum(most - 1, 0)], b)
        waste = left - a - b
        exact = False
        for k in np.argsort(waste, kind="stable")[:BRANCHES].tolist():
            exact = add(*before, a[k], b[k]) or exact
        return exact

    if not pairs(room) and not any(pairs(room - a, a) for a in longest[: 4 * LEADS].tolist()):
        any(
            pairs(room - a - b, a, b)
            for a in longest[:LEADS].tolist()
            for b in longest[longest <= min(a, room - a)][:LEADS].tolist()
        )
    ranked = sorted(found.items(), key=lambda f: (f[1], tuple(-x for x in f[0])))
    best = [(f, w) for f, w in ranked if not _dominated(f, w, fit, counts)] or ranked
    return [((*base, *f), w) for f, w in best[:BRANCHES]]


def packed(counts: np.ndarray, nodes: int = NODES) -> Packing:
    """A packing of ``counts[size]`` pieces of each size into sequences of len(counts) - 1 ids."""
    room = len(counts) - 1
    counts = counts.astype(np.int64).copy()
    least, incumbent = lower_bound(counts), best_fit(counts)
    total = int((counts * np.arange(room + 1)).sum())
    path: list[tuple[tuple[int, ...], int, int, list]] = []  # filling, sequences, waste, other fillings to try
    wasted = 0

    def longest() -> int:
        left = np.flatnonzero(counts)
        return int(left[-1]) if len(left) else 0

    def step(options: list) -> bool:
        """Take the first of the options that the waste allows."""
        nonlocal wasted
        allowed = (len(incumbent) - 1) * room - total - wasted
        while options:
            content, waste = options.pop(0)
            if waste > allowed:
                continue
            sizes, need = np.unique(content, return_counts=True)
            times = int((counts[sizes] // need).min())
            if waste:
                times = min(times, allowed // waste)
            counts[sizes] -= need * times
            wasted += waste * times
            path.append((content, times, waste, options))
            return True
        return False

    def options() -> list:
        s = longest()
        counts[s] -= 1
        around = fillings(counts, room - s, (len(incumbent) - 1) * room - total - wasted)
        counts[s] += 1
        return [((s, *f), w) for f, w in around]

    while len(incumbent) > least and nodes > 0:
        nodes -= 1
        if longest() == 0:
            incumbent = Packing([(content, n) for content, n, _, _ in path])
        elif step(options()):
            continue
        while path:  # back to the last place with another filling
            content, times, waste, others = path.pop()
            sizes, need = np.unique(content, return_counts=True)
            counts[sizes] += need * times
            wasted -= waste * times
            if step(others):
                break
        else:
            break
    return incumbent


class Places:
    """The place of the nth piece of a length in a packing."""

    def __init__(self, packing: Packing):
        rows, used, sequence = [], {}, 0
        for content, n in packing.fillings:
            offset = 0
            for size in dict.fromkeys(content):
                each = content.count(size)
                rows.append((size, used.get(size, 0), each, sequence, offset))
                used[size] = used.get(size, 0) + each * n
                offset += each * size
            sequence += n
        rows.sort()
        self.size, self.first, self.each, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T

    def of(self, size: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset)"""
        bits = 44
        run = np.searchsorted((self.size << bits) + self.first, (size << bits) + nth, "right") - 1
        k, each = nth - self.first[run], self.each[run]
        return self.sequence[run] + k // each, self.offset[run] + size * (k % each)


def placed(cut: DataFrame, length: int = LENGTH, nodes: int = NODES) -> DataFrame:
    """The pieces with sequence_id and offset.  ``cut``: a written table as ``pieces`` returns it."""
    counts = written(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(length + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length up to ``length``
        histogram[r["length"]] = r["n"]
    places = cut.sparkSession.sparkContext.broadcast(Places(packed(histogram, nodes)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("task").alias("s_task"), F.col("length").alias("s_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = cut.join(starts, (F.col("task") == F.col("s_task")) & (F.col("length") == F.col("s_length")))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("nth"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = places.value.of(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return placed(written(pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), "pieces"))
