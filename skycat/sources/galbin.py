"""Packed point files (D6) as a Python Data Source: ``format("galbin")``.

Layout, little-endian: a 16-byte header ``<IIII`` (magic, version, n, flags)
followed by n 16-byte records ``<fffBBH`` (x, y, z_cart, tracer, reserved,
z_encoded).

A table is one such file, or a folder of them.  A folder written here is
versioned: its data files never change or move, and a manifest
``_manifest-<version>-<job>.json`` lists the files of one version in row order
with their counts.  A write adds its files and then, as its last act, one
manifest, by a rename to a name that was not there before; readers follow the
latest manifest.  So a reader sees one whole version whenever it looks, also
after a write that died.  The version before the latest is kept, for readers
that have planned on it; what only older ones list is deleted.  A folder
without a manifest (files of other tools) is read by ``part-*.galbin``.

Read (S6): the driver reads one manifest, or the header of each file where
there is none, and splits every file into record ranges
(``recordsPerPartition``); each task seeks to ``16 + 16 * start`` and decodes
its range with one numpy structured view.  Columns: ``x, y, z_cart`` float,
``tracer`` short, ``z_encoded`` int.  The redshift is decoded in Spark
(``decode_z``).

Write (K3): a task gathers up to ``FILE_RECORDS`` records and writes them as a
complete file, so it holds 64 MiB at most, on any file system.  ``commit``
writes the manifest, ``abort`` removes the files.  ``compose`` makes one file
of ordered parts: their counts give each part its place behind one header, and
a Spark job copies all parts at once.

Paths are local paths or URIs of the cluster's shared storage (``hdfs://``,
``s3://``, ``gs://``), accessed through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from skycat.sources import fsio
from skycat.schema import PACKED_HEADER_BYTES, PACKED_MAGIC, PACKED_RECORD_BYTES, PACKED_VERSION

RECORD = np.dtype(
    [("x", "<f4"), ("y", "<f4"), ("z_cart", "<f4"), ("tracer", "u1"), ("reserved", "u1"), ("z_encoded", "<u2")]
)
assert RECORD.itemsize == PACKED_RECORD_BYTES
SCHEMA = "x float, y float, z_cart float, tracer short, z_encoded int"
PART_GLOB = "part-*.galbin"
DEFAULT_RECORDS_PER_PARTITION = 4 << 20  # 64 MiB of records
BATCH_RECORDS = 1 << 20
#: Records of a data file, which a task holds until it is full.
FILE_RECORDS = 4 << 20
MANIFEST_GLOB = "_manifest-*.json"
MAX_POINTS = 0xFFFFFFFF  # the header count is u32


def header(n: int) -> bytes:
    return struct.pack("<IIII", PACKED_MAGIC, PACKED_VERSION, n, 0)


@dataclass
class Manifest:
    """One version of a folder: its files, by name, in row order, with their counts."""

    version: int
    files: list
    path: str = ""


def manifests(path: str) -> list[Manifest]:
    """The versions that a folder still has, oldest first."""
    found = []
    for p in fsio.find(path, MANIFEST_GLOB, recursive=False) if fsio.exists(path) else []:
        with fsio.open_input(p) as f:
            doc = json.loads(f.read())
        found.append(Manifest(doc["version"], [(name, n) for name, n in doc["files"]], p))
    return sorted(found, key=lambda m: (m.version, m.path))


def list_files(path: str) -> list[tuple[str, int]]:
    """(file, records) of a table, in row order."""
    from concurrent.futures import ThreadPoolExecutor

    files = [path]
    if fsio.is_dir(path):
        if found := manifests(path):
            return [(fsio.join(path, name), n) for name, n in found[-1].files]
        files = fsio.find(path, PART_GLOB, recursive=False)
    # validate every header; overlap the reads (network file systems)
    with ThreadPoolExecutor(max_workers=max(1, min(32, len(files)))) as pool:
        return list(zip(files, pool.map(read_header, files)))


def read_header(path: str) -> int:
    """Validate one file's header and size; return its record count."""
    size = fsio.size(path)
    with fsio.open_input(path) as f:
        head = f.read(PACKED_HEADER_BYTES)
    if len(head) < PACKED_HEADER_BYTES:
        raise ValueError(f"{path}: truncated header ({len(head)} bytes)")
    magic, version, n, _flags = struct.unpack("<IIII", head)
    if magic != PACKED_MAGIC:
        raise ValueError(f"{path}: invalid magic number 0x{magic:x} (expected 0x{PACKED_MAGIC:x})")
    if version != PACKED_VERSION:
        raise ValueError(f"{path}: unsupported version {version}")
    need = PACKED_HEADER_BYTES + n * PACKED_RECORD_BYTES
    if size < need:
        raise ValueError(f"{path}: truncated body: header says {n} points, file has {size} of {need} bytes")
    return n


@dataclass
class RecordRange(InputPartition):
    path: str
    start: int
    count: int


def decode_records(buf: bytes) -> pa.RecordBatch:
    rec = np.frombuffer(buf, dtype=RECORD)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(rec["x"]),
            pa.array(rec["y"]),
            pa.array(rec["z_cart"]),
            pa.array(rec["tracer"].astype(np.int16)),
            pa.array(rec["z_encoded"].astype(np.int32)),
        ],
        names=["x", "y", "z_cart", "tracer", "z_encoded"],
    )


class GalbinReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.per_part = int(options.get("recordsPerPartition", DEFAULT_RECORDS_PER_PARTITION))

    def partitions(self):
        parts = []
        for f, n in list_files(self.path):
            for start in range(0, n, self.per_part):
                parts.append(RecordRange(f, start, min(self.per_part, n - start)))
        return parts or [RecordRange("", 0, 0)]

    def read(self, partition: RecordRange):
        if partition.count == 0:
            return
        with fsio.open_input(partition.path) as f:
            f.seek(PACKED_HEADER_BYTES + partition.start * PACKED_RECORD_BYTES)
            left = partition.count
            while left > 0:
                k = min(left, BATCH_RECORDS)
                buf = f.read(k * PACKED_RECORD_BYTES)
                if len(buf) != k * PACKED_RECORD_BYTES:
                    raise ValueError(f"{partition.path}: short read at record {partition.count - left}")
                yield decode_records(buf)
                left -= k


@dataclass
class FilesWritten(WriterCommitMessage):
    partition: int
    files: list  # (name, records)


def encode_batch(batch: pa.RecordBatch) -> np.ndarray:
    cols = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
    tracer = cols["tracer"].astype(np.int64)
    zenc = cols["z_encoded"].astype(np.int64)
    if len(tracer) and (tracer.min() < 0 or tracer.max() > 255):
        raise ValueError("tracer outside 0..255 cannot be packed into a u8")
    if len(zenc) and (zenc.min() < 0 or zenc.max() > 65535):
        raise ValueError("z_encoded outside 0..65535 cannot be packed into a u16")
    rec = np.zeros(len(tracer), dtype=RECORD)
    rec["x"], rec["y"], rec["z_cart"] = cols["x"], cols["y"], cols["z_cart"]
    rec["tracer"], rec["z_encoded"] = tracer, zenc
    return rec


class GalbinWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path = options.get("path")
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex[:12]  # in all names of this write, so that others' files stay untouched

    def write(self, iterator):
        from pyspark import TaskContext

        pid, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        files: list[tuple[str, int]] = []
        held: list[np.ndarray] = []

        def flush() -> None:
            name = f"data-{self.job}-{pid:08d}-{attempt}-{len(files):05d}.galbin"
            n = sum(map(len, held))
            files.append((name, n))
            fsio.write_bytes(fsio.join(self.path, name), [header(n), *(r.tobytes() for r in held)])
            held.clear()

        try:
            room = FILE_RECORDS
            for batch in iterator:
                records = encode_batch(batch)
                while len(records):
                    held.append(records[:room])
                    room -= len(held[-1])
                    records = records[len(held[-1]) :]
                    if not room:
                        flush()
                        room = FILE_RECORDS
            if held:
                flush()
        except BaseException:
            # a failed attempt sends no commit message: remove its files here
            for name, _ in files:
                fsio.delete(fsio.join(self.path, name))
            raise
        return FilesWritten(pid, files)

    def commit(self, messages):
        msgs = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        new = [f for m in msgs for f in m.files]
        there = manifests(self.path)
        if self.overwrite:
            files = new
        elif there:
            files = there[-1].files + new
        else:  # files of other tools come first
            files = [(fsio.name(p), n) for p, n in (list_files(self.path) if fsio.exists(self.path) else [])] + new
        version = there[-1].version + 1 if there else 1
        doc = {"version": version, "n_points": sum(n for _, n in files), "files": files}
        name = f"_manifest-{version:010d}-{self.job}.json"
        fsio.write_bytes(fsio.join(self.path, "." + name), [json.dumps(doc).encode()])
        fsio.move(fsio.join(self.path, "." + name), fsio.join(self.path, name))  # from here on the new version is the table
        self._tidy({n for n, _ in files}, there)

    def _tidy(self, now: set, there: list[Manifest]) -> None:
        """Delete what neither this version nor the one before lists; files of attempts that died (lost
        executor, speculation) are those of this write that no commit message names."""
        keep = now | {n for n, _ in there[-1].files} if there else now
        gone = {n for m in there[:-1] for n, _ in m.files} - keep
        if there:
            gone |= {fsio.name(p) for p in fsio.find(self.path, PART_GLOB, recursive=False)} - keep
        gone |= {fsio.name(p) for p in fsio.find(self.path, f"data-{self.job}-*.galbin", recursive=False)} - keep
        for m in there[:-1]:
            fsio.delete(m.path)
        for n in gone:
            fsio.delete(fsio.join(self.path, n))

    def abort(self, messages):
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fsio.delete(fsio.join(self.path, name))


def _copied(target: str):
    """Copies ranges of parts to their places in ``target``; yields the records of each."""

    def run(batches):
        for batch in batches:
            done = []
            for path, start, n, place in zip(*(c.to_pylist() for c in batch.columns)):
                with fsio.open_input(path) as src, open(target, "r+b") as dst:
                    src.seek(PACKED_HEADER_BYTES + start * PACKED_RECORD_BYTES)
                    dst.seek(PACKED_HEADER_BYTES + place * PACKED_RECORD_BYTES)
                    for first in range(0, n, BATCH_RECORDS):
                        want = min(BATCH_RECORDS, n - first) * PACKED_RECORD_BYTES
                        buf = src.read(want)
                        if len(buf) != want:
                            raise ValueError(f"{path}: short read at record {start + first}")
                        dst.write(buf)
                    dst.flush()
                    os.fsync(dst.fileno())
                done.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["n"])

    return run


def compose(spark, parts: list[tuple[str, int]], path: str) -> int:
    """One file ``path`` of the records of ordered parts (file, records); the number of records.

    Part k begins behind the records of the parts before it, so on a mounted file system all
    are copied at once by a Spark job, each to its place; a retried task writes the same bytes
    to the same place.  Stores without writes at an offset get one stream of all parts, in
    pieces.  The file appears by a rename when it is whole.
    """
    total = sum(n for _, n in parts)
    if total > MAX_POINTS:
        raise ValueError(f"{total} points; one file holds at most 2^32 - 1, write a folder of parts")
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    here = fsio.local(tmp)
    try:
        if here is None:
            fsio.write_bytes(tmp, _stream(parts, total))
        else:
            fsio.write_bytes(tmp, [header(total)])
            os.truncate(here, PACKED_HEADER_BYTES + total * PACKED_RECORD_BYTES)
            rows, place = [], 0
            for part, n in parts:
                rows += [(part, a, min(FILE_RECORDS, n - a), place + a) for a in range(0, n, FILE_RECORDS)]
                place += n
            if rows:
                jobs = spark.createDataFrame(rows, "part string, start long, n long, place long")
                copied = jobs.mapInArrow(_copied(here), "n long").groupBy().sum("n").first()[0]
                if copied != total:
                    raise OSError(f"{path}: {copied} of {total} records were copied")
        fsio.move(tmp, path)
    except BaseException:
        fsio.delete(tmp)
        raise
    return total


def _stream(parts, total: int):
    yield header(total)
    for part, n in parts:
        with fsio.open_input(part) as f:
            f.seek(PACKED_HEADER_BYTES)
            for first in range(0, n, BATCH_RECORDS):
                yield f.read(min(BATCH_RECORDS, n - first) * PACKED_RECORD_BYTES)


class GalbinDataSource(DataSource):
    @classmethod
    def name(cls):
        return "galbin"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GalbinReader(self.options)

    def writer(self, schema, overwrite):
        return GalbinWriter(self.options, overwrite)


def register(spark) -> None:
    from skycat.session import ship_package

    ship_package(spark)
    spark.dataSource.register(GalbinDataSource)
