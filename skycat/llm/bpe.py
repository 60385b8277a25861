"""Operator 4: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Each pair of neighbours whose join has a rank
is queued in the bucket of that rank, as the list position of its left part.  A bitmap
of 64-bit words over the ranks, with a word for every 64 words above it, says which
buckets hold entries; find-first-set from the top gives the smallest rank in as many
steps as there are levels, whatever the queue's length.  Entries whose pair has changed
since are stale and skipped.  So n bytes cost O(n) queue steps, also in pre-tokens of
millions of bytes, where searching the whole list for each merge would cost O(n * n).

Encoding is one pass over the rows without a shuffle.  Workers read the rank file from
the path given (the tokenizer package is installed on every machine) and keep results of
short pieces in a bounded memo.

Defined cases: null or empty text (no ids), any Unicode, very long texts without spaces,
repeated rows (a result row each), null doc_ids (kept), empty tables, extra columns
(ignored).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycat.session import ship_package

from .common import table
from .pieces import Memo, pieces


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BITS = [1 << k for k in range(256)]


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        # the queue: bits of 256 ranks a word, and a top word with a bit for each of these; buckets by rank
        self.words = [0] * (max(ranks.values()) // 256 + 1)
        self.buckets: dict[int, list[int]] = {}
        # decoding: all token bytes in one run
        order = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            order[rank] = token
        self.lengths = np.array([len(t) for t in order], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(order), np.uint8)

    def merge(self, token: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(token)
        if whole is not None:
            return [whole]
        n = len(token)
        rank_of, words, buckets, top = ranks.get, self.words, self.buckets, 0
        part: list = [token[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        joined = [rank_of(token[i : i + 2], -1) for i in range(n)]  # rank of the pair that begins here; -1: none
        joined[n - 1] = -1
        for i, r in enumerate(joined):
            if r >= 0:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    words[r >> 8] |= _BITS[r & 255]
                    top |= 1 << (r >> 8)
        while top:
            # find first set: the word, then the rank in it; take its bucket out
            at = (top & -top).bit_length() - 1
            word = words[at]
            low = word & -word
            word ^= low
            words[at] = word
            if not word:
                top ^= 1 << at
            rank = (at << 8) | (low.bit_length() - 1)
            # one rank is one byte string: equal ranks merge from left to right
            waiting = buckets.pop(rank)
            if len(waiting) > 1:
                waiting.sort(reverse=True)
            lower = False
            while waiting and not lower:
                i = waiting.pop()
                if joined[i] != rank:  # stale: merged away, or the pair has changed
                    continue
                j = after[i]
                own = part[i] = part[i] + part[j]
                joined[i] = joined[j] = -1
                nxt = after[i] = after[j]
                if nxt < n:
                    before[nxt] = i
                    r = rank_of(own + part[nxt])
                    if r is not None:
                        joined[i] = r
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> 8] |= _BITS[r & 255]
                            top |= 1 << (r >> 8)
                        lower = r < rank
                prev = before[i]
                if prev >= 0:
                    r = joined[prev] = rank_of(part[prev] + own, -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(prev)
                        else:
                            buckets[r] = [prev]
                            words[r >> 8] |= _BITS[r & 255]
                            top |= 1 << (r >> 8)
                        lower = lower or r < rank
            if waiting:  # a smaller rank came up: it goes first
                buckets[rank] = waiting + buckets.get(rank, [])
                words[at] |= low
                top |= 1 << at
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for match in self.split(text) for i in self.merge(match.encode())]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.begins[ids] - (ends - lengths)
        return self.bytes[np.arange(ends[-1] if len(ids) else 0) + np.repeat(shift, lengths)].tobytes()


_coders: dict[tuple[str, str], tuple[ByteBPE, Memo]] = {}


def coder(path: str, pattern: str) -> tuple[ByteBPE, Memo]:
    """The worker's coder and its memo of pieces (ids as little-endian 32-bit integers)."""
    if (path, pattern) not in _coders:
        bpe = ByteBPE(read_ranks(path), pattern)
        short = Memo(lambda match: np.array(bpe.merge(match.encode()), "<u4").tobytes())
        memo = Memo(lambda piece: b"".join([short[m] for m in bpe.split(piece)]))
        _coders[path, pattern] = bpe, memo
    return _coders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, keep_memo: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for) of every row.

    Without ``keep_memo`` a worker gives up its memo at the end of each task, so that the
    steps of a pipeline that come after have the memory.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo = coder(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                packed = b"".join(map(memo.__getitem__, pieces(text.as_py() or "")))
                ids = np.frombuffer(packed, "<u4")
                back = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest(), ids))
            columns = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([r[3].astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        if not keep_memo:
            _coders.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and the bytes of each row's ids, the inverse of ``encoded(..., with_ids=True)``."""
    ship_package(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {v: k for k, v in read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(back.__getitem__, x.as_py() or [])) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, bytes binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
