"""Operator 5: token ids in shard files that are wavelet matrices.

A shard holds the ids of consecutive documents.  Its file is

    header   magic, version, documents, ids, bits an id, bytes of the index
    index    (zstd) doc_ids, ends of the documents, zeros and length of each plane
    planes   (zstd each) one bit of every id, in the order of the planes above

Plane 0 holds the top bit of the ids in text order; each next plane the next bit, with
the ids that had 0 before those that had 1.  With rank and select on the planes one
file answers ``access`` (id at a position), ``count`` (occurrences of an id in a range)
and ``locate`` (the k-th occurrence), reading only the compressed planes.

Writing: rows are range-partitioned and sorted by doc_id, encoded with the tokenizers
library, and each task writes a file whenever it holds ``SHARD_IDS`` ids, so memory
does not grow with the partition.  A file is written under a temporary name and moved;
a retried task writes the same files again.  Reading is Spark's binaryFile source.

Defined cases: null or empty text (the end id alone), null doc_ids (first), repeated
rows (each is written), empty tables (no files, no rows), extra columns (ignored).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skycat.session import ship_package
from skycat.sources import fsio

from .common import shared_folder, table
from .pieces import MEMO_CHARS, MEMO_PIECES, pieces, plain

MAGIC = b"SKWM"
VERSION = 1
HEADER = struct.Struct("<4sIQQII")
SHARD_IDS = 4_000_000
END_ID = 2
RUN_BYTES = 8_000_000  # texts that are encoded together
_BLOCK = 512  # bits a rank entry covers
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Plane:
    """A run of bits with rank and select."""

    def __init__(self, packed: np.ndarray, n: int):
        self.packed, self.n = packed, n
        ones = _ONES[packed].astype(np.int64)
        per = _BLOCK // 8
        padded = np.zeros(-(-len(ones) // per) * per, np.int64)
        padded[: len(ones)] = ones
        self.before = np.concatenate([[0], np.cumsum(padded.reshape(-1, per).sum(1))])

    def __getitem__(self, i: int) -> int:
        return int(self.packed[i >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, bit: int, i: int) -> int:
        """How many of the first i bits equal ``bit``."""
        block = i // _BLOCK
        byte = i >> 3
        ones = int(self.before[block]) + int(_ONES[self.packed[block * (_BLOCK // 8) : byte]].sum())
        if i & 7:
            ones += int(_ONES[self.packed[byte] >> (8 - (i & 7))])
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit that equals ``bit``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            if self.rank(bit, mid + 1) <= k:
                low = mid + 1
            else:
                high = mid
        return low

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)


def _places(one: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """In blocks of the bits: start and end, places in the block of those not set and of those set.

    Numpy takes and puts by places faster than by masks; blocks keep them in the processor's cache.
    """
    for a in range(0, len(one), 1 << 16):
        block = one[a : a + (1 << 16)]
        yield a, a + len(block), np.flatnonzero(~block), np.flatnonzero(block)


def build(ids: np.ndarray, bits: int) -> list[tuple[np.ndarray, int]]:
    """(packed bits, zeros) of each plane, top bit first."""
    out = []
    for level in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << level)) != 0
        zeros = len(ids) - int(np.count_nonzero(one))
        out.append((np.packbits(one), zeros))
        if level:
            down, low, high = np.empty_like(ids), 0, zeros
            for a, b, unset, are_set in _places(one):
                ids[a:b].take(unset, out=down[low : low + len(unset)], mode="clip")
                ids[a:b].take(are_set, out=down[high : high + len(are_set)], mode="clip")
                low, high = low + len(unset), high + len(are_set)
            ids = down
    return out


def to_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    import zstandard

    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    press = zstandard.ZstdCompressor(level=1).compress
    planes = build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    packed = [press(p.tobytes()) for p, _ in planes]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    index = press(
        known.tobytes()
        + np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.asarray(ends, "<i8").tobytes()
        + np.array([[z, len(p)] for (_, z), p in zip(planes, packed, strict=True)], "<i8").tobytes()
    )
    return HEADER.pack(MAGIC, VERSION, len(doc_ids), len(ids), bits, len(index)) + index + b"".join(packed)


class TokenFile:
    """One shard file; planes are unpacked when first asked for."""

    def __init__(self, data: bytes):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        magic, version, docs, self.n, self.bits, length = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        index = self._unpack(data[HEADER.size : HEADER.size + length])
        known = np.frombuffer(index, np.uint8, docs)
        values = np.frombuffer(index, "<i8", offset=docs) if docs % 8 == 0 else np.frombuffer(index[docs:], "<i8")
        self.doc_ids = [int(d) if k else None for d, k in zip(values[:docs], known, strict=True)]
        self.ends = values[docs : 2 * docs]
        table = values[2 * docs :].reshape(self.bits, 2)
        self.zeros = table[:, 0].tolist()
        at = HEADER.size + length + np.concatenate([[0], np.cumsum(table[:, 1])])
        self._raw = [data[at[k] : at[k + 1]] for k in range(self.bits)]
        self._planes: dict[int, Plane] = {}

    def plane(self, k: int) -> Plane:
        if k not in self._planes:
            self._planes[k] = Plane(np.frombuffer(self._unpack(self._raw[k]), np.uint8), self.n)
        return self._planes[k]

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for k in range(self.bits):
            p = self.plane(k)
            bit = p[i]
            value = value << 1 | bit
            i = self.zeros[k] + p.rank(1, i) if bit else p.rank(0, i)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for k in range(self.bits):
            p, bit = self.plane(k), token >> (self.bits - 1 - k) & 1
            shift = self.zeros[k] if bit else 0
            start, end = shift + p.rank(bit, start), shift + p.rank(bit, end)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in positions start to end."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        if k >= self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self.plane(level).select(bit, i - (self.zeros[level] if bit else 0))
        return i

    def ids(self) -> np.ndarray:
        """All ids in text order, from the lowest plane up; keeps one plane at a time."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for k in range(self.bits - 1, -1, -1):
            one = np.unpackbits(np.frombuffer(self._unpack(self._raw[k]), np.uint8), count=self.n).view(bool)
            up, low, high = np.empty(self.n, kind), 0, self.zeros[k]
            for a, b, unset, are_set in _places(one):
                up[a:b][unset] = out[low : low + len(unset)]
                up[a:b][are_set] = out[high : high + len(are_set)] | kind(1 << (self.bits - 1 - k))
                low, high = low + len(unset), high + len(are_set)
            out = up
        return out


_coders: dict[str, _Coder] = {}


def _gather(packed: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``packed`` that start at ``begin``, one after the other."""
    end = np.cumsum(size)
    return packed.take(np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size), mode="clip")


class _Known:
    """Words (Arrow) and their ids: those of word k are ``size[k]`` of ``packed`` from ``begin[k]`` on."""

    def __init__(self, words: pa.Array, packed: np.ndarray, size: np.ndarray, begin: np.ndarray | None = None):
        self.words, self.packed, self.size = words, packed, size
        self.begin = np.cumsum(size) - size if begin is None else begin

    def __len__(self) -> int:
        return len(self.size)

    def find(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 for those not here."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> _Known:
        size = self.size[at]
        return _Known(self.words.take(pa.array(at)), _gather(self.packed, self.begin[at], size), size)

    def with_more(self, other: _Known) -> _Known:
        return _Known(
            pa.concat_arrays([self.words, other.words]),
            np.concatenate([self.packed, other.packed]),
            np.concatenate([self.size, other.size]),
            np.concatenate([self.begin, other.begin + len(self.packed)]),
        )


def _nothing() -> _Known:
    return _Known(pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))


class _Coder:
    """Ids of texts by the tokenizers library, which sees each distinct word of a run of texts once.

    Texts are cut at their single spaces and the words numbered (Arrow's dictionary
    encoding); words not remembered are encoded together, and the ids of all texts are
    gathered from the table of distinct words.  Words stay in Arrow and ids in numpy: a
    Python string or bytes a word would cost more than the library.
    """

    JOINED = 50
    MARKS = ".,;:!?"
    CLOSED = f"[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f][{MARKS}]\\z"
    SPACED = "[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "]\\z"
    GATHER = 1 << 20

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of its name is a byte
        for name, i in vocabulary.items():
            self.lengths[i] = len(name)
        # words with the space before them, those met last: two halves, the older one given up when the other is full
        self.recent, self.older = _nothing(), _nothing()
        self.marks = _Known(pa.array(self.MARKS, pa.large_string()), *self._each(list(self.MARKS)))
        if (self.marks.size != 1).any():
            raise ValueError("a closing mark is not one id of this tokenizer")

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _encode(self, words: pa.Array) -> _Known:
        """Ids of words, encoded in runs; as no match reaches over a single space, the ids part where a word's bytes end."""
        import pyarrow.compute as pc

        alone = pc.or_(pc.equal(pc.binary_length(words), 0), pc.match_substring_regex(words, self.SPACED)).to_numpy(zero_copy_only=False)
        joinable = words.filter(pa.array(~alone)) if alone.any() else words
        starts = pa.array([*range(0, len(joinable), self.JOINED), len(joinable)], pa.int32())
        runs = pc.binary_join(pa.ListArray.from_arrays(starts, joinable), pa.scalar(" ", pa.large_string())) if len(joinable) else []
        packed, _ = self._each([" " + str(r) for r in runs])
        ends = np.cumsum(pc.binary_length(joinable).to_numpy() + 1)
        cut = np.searchsorted(np.cumsum(self.lengths[packed]), ends) + 1
        size = np.diff(cut, prepend=0)
        if not alone.any():
            return _Known(words, packed, size)
        more, sizes = self._each([" " + str(w) for w in words.filter(pa.array(alone))])
        every, begin = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        every[~alone], every[alone] = size, sizes
        begin[~alone], begin[alone] = cut - size, len(packed) + np.cumsum(sizes) - sizes
        return _Known(words, np.concatenate([packed, more]), every, begin)

    def _learn(self, new: pa.Array) -> _Known:
        """Ids of words not remembered.  A closing mark after a letter is a match of its own, so words that
        differ in it alone are encoded once."""
        import pyarrow.compute as pc

        marked = pc.match_substring_regex(new, self.CLOSED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(new, 0, -1), new).dictionary_encode()
        bare = stems.dictionary
        at = self.recent.find(bare)
        missed = np.flatnonzero(at < 0)
        at[missed] = len(self.recent) + np.arange(len(missed))
        found = self.recent.with_more(self._encode(bare.take(pa.array(missed))))
        at = at[stems.indices.to_numpy()]
        closed = marked.to_numpy(zero_copy_only=False)
        size = found.size[at] + closed
        packed = _gather(found.packed, found.begin[at], size)  # the id after a stem's own is replaced by its mark
        mark = self.marks.find(pc.utf8_slice_codeunits(new.filter(marked), -1, 1 << 30))
        packed[(np.cumsum(size) - 1)[closed]] = self.marks.packed[mark]
        return _Known(new, packed, size)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each word where its own begin, its space before it, and how many they are."""
        import pyarrow.compute as pc

        known = self.recent
        at = known.find(words)
        missed = np.flatnonzero(at < 0)
        if len(missed):
            unknown = words.take(pa.array(missed))
            again = self.older.find(unknown)
            new = np.flatnonzero(again < 0)
            again[new] = len(self.older) + np.arange(len(new))
            fresh = self.older.with_more(self._learn(unknown.take(pa.array(new)))).take(again)
            at[missed] = len(known) + np.arange(len(missed))
            short = np.flatnonzero(pc.less(pc.utf8_length(unknown), MEMO_CHARS).to_numpy(zero_copy_only=False))[: MEMO_PIECES // 2]
            kept = fresh.take(short)
            if len(known) + len(kept) > MEMO_PIECES // 2:
                self.recent, self.older = kept, known
            else:
                self.recent = known.with_more(kept)
            known = known.with_more(fresh)
        return known.packed, known.begin[at], known.size[at]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        even = [i for i, t in enumerate(texts) if plain(t)]
        self._even(texts, even, out)
        for i in set(range(len(texts))).difference(even):
            head, *tail = pieces(texts[i])
            # a word may come more than once, and is learnt once
            words = pa.array([w[1:] for w in tail], pa.large_string()).dictionary_encode()
            packed, begin, size = self._table(words.dictionary)
            n = words.indices.to_numpy()
            out[i] = self._each([head])[0].tobytes() + _gather(packed, begin[n], size[n]).tobytes()
        return out

    def _even(self, texts: list[str], even: list[int], out: list[bytes]) -> None:
        import pyarrow.compute as pc

        if not even:
            return
        cut = pc.split_pattern(pa.array([texts[i] for i in even], pa.large_string()), " ")
        words = cut.flatten().dictionary_encode()
        number = words.indices.to_numpy().copy()
        at = cut.offsets.to_numpy()
        number[at[:-1]] = len(words.dictionary) + np.arange(len(even))
        packed, begin, length = self._table(words.dictionary)
        heads, sizes = self._each([texts[i].split(" ", 1)[0] for i in even])
        begin = np.concatenate([begin, len(packed) + np.cumsum(sizes) - sizes])
        packed, length = np.concatenate([packed, heads]), np.concatenate([length, sizes])
        ids, ends = [], [np.zeros(1, np.int64)]
        for a in range(0, len(number), self.GATHER):
            n = number[a : a + self.GATHER]
            size = length[n]
            ids.append(_gather(packed, begin[n], size))
            ends.append(ends[-1][-1] + np.cumsum(size))
        every, bounds = memoryview(np.concatenate(ids)).cast("B"), 4 * np.concatenate(ends)[at]
        for i, a, b in zip(even, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = bytes(every[a:b])


def _coder(path: str) -> _Coder:
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def runs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of about RUN_BYTES of text (column 1); a longer text is a run of its own."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + RUN_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shard files in ascending doc_id order; one row per file (name, documents, ids)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        context = TaskContext.get()
        coder, end = _coder(path), np.array([end_id], "<u4").tobytes()
        doc_ids: list = []
        parts: list[bytes] = []
        held = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, made
            ends = np.cumsum([len(p) // 4 for p in parts])
            ids = np.frombuffer(b"".join(parts), "<u4")
            name = f"part-{context.partitionId():08d}-{made:08d}.wm"
            temporary = fsio.join(folder, f".{name}.{uuid.uuid4().hex}")
            fsio.write_bytes(temporary, [to_bytes(doc_ids, ends, ids)])
            fsio.move(temporary, fsio.join(folder, name))
            row = pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})
            doc_ids.clear()
            parts.clear()
            held, made = 0, made + 1
            return row

        for batch in batches:
            for rows in runs_of(batch):
                for d, e in zip(rows.column(0).to_pylist(), coder.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    doc_ids.append(d)
                    parts.append(e + end)
                    held += len(e) // 4 + 1
                    if held >= shard_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(run, "name string, n_docs long, n_ids long")
    listing = fsio.join(folder, "_files")
    files.write.parquet(listing)
    return docs.sparkSession.read.schema(files.schema).parquet(listing)


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                f = TokenFile(content.as_py())
                packed = memoryview(f.ids().astype("<u4").tobytes())
                starts = np.concatenate([[0], f.ends[:-1]])
                crc = [zlib.crc32(packed[4 * a : 4 * b]) for a, b in zip(starts.tolist(), f.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(crc)), pa.array(f.doc_ids, pa.int64()), pa.array(starts), pa.array(f.ends - starts), pa.array(crc, pa.int64())],
                    ["name", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    ship_package(spark)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wm").load(folder)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = content.mapInArrow(run, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    # one row per file: names are in text order
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(F.col("name").alias("f_name"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    return rows.join(starts, F.col("name") == F.col("f_name")).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op5_wavelet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder, files)
