"""FITS binary tables as a Python Data Source: ``format("fits_table")`` (S3).

    spark.read.format("fits_table")
        .option("extname", "LSS")                 # extension to read (default LSS)
        .option("columns", "RA,DEC,Z,WEIGHT")     # default: every scalar column
        .option("pattern", "*_clustering.dat.fits")  # when path is a directory
        .option("rowsPerPartition", 1_000_000)    # default: ~128 MiB of rows
        .option("batchBytes", 32 << 20)           # bytes per read / Arrow batch
        .option("minPartitions", 8)               # split small inputs over at least this many tasks
        .option("paths", json.dumps([...]))       # or: an explicit list of files
        .option("lengths", json.dumps([...]))     # their lengths, where a listing is at hand
        .load(path)

A BINTABLE extension stores rows of a fixed width (``NAXIS1`` bytes), so any
row range is one seek and one read.  The driver plans by the lengths of the
files alone, the way Spark's file sources do: large files are split into byte
ranges of at most the split size, small files are packed together (each
counting an open cost).  A range is a path and two numbers; the task that reads
it parses the file's header (a few 2,880-byte blocks) and takes the rows that
start in the range.  The driver reads one header, for the schema.  Tasks
decode their ranges with big-endian numpy structured views and hand Arrow
batches to Spark.  Besides the requested columns each row carries
``file_name`` (the file's base name) and ``row_index`` (its 0-based row in the
file), which together identify it.

Supported column formats: L, B, I, J, K, E, D (repeat 1) and fixed-width A;
``TSCALn``/``TZEROn`` are applied (the unsigned conventions B/-128, I/32768,
J/2^31 widen the type instead).  Variable-length columns (P, Q) can be skipped
but not read; tile-compressed tables are refused.  Paths are local paths or
URIs of shared storage (``hdfs://``, ``s3://``, ``gs://``), read through
``pyarrow.fs``.
"""

from __future__ import annotations

import glob
import json
import os
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skycat.schema import CATALOG_GLOB, FITS_EXTENSION
from skycat.sources import fsio

BLOCK = 2880
CARD = 80
TARGET_PARTITION_BYTES = 128 << 20
OPEN_COST_BYTES = 4 << 20  # a file costs as much as this many bytes to open (as in Spark's file sources)
BATCH_BYTES = 32 << 20  # one read (and one Arrow batch) per 32 MiB of rows

# type code -> (bytes per element, numpy big-endian dtype, Spark type)
FORMATS = {
    "L": (1, "i1", "boolean"),
    "B": (1, "u1", "short"),
    "I": (2, ">i2", "short"),
    "J": (4, ">i4", "int"),
    "K": (8, ">i8", "bigint"),
    "E": (4, ">f4", "float"),
    "D": (8, ">f8", "double"),
    "A": (1, "S", "string"),
}
OTHER_WIDTH = {"C": 8, "M": 16, "P": 8, "Q": 16}
TFORM_RE = re.compile(r"^\s*(\d*)([LXBIJKAEDCMPQ])(.*)$")


def _parse_value(raw: str):
    raw = raw.strip()
    if raw.startswith("'"):
        out, i = [], 1
        while i < len(raw):
            if raw[i] == "'":
                if i + 1 < len(raw) and raw[i + 1] == "'":
                    out.append("'")
                    i += 2
                    continue
                break
            out.append(raw[i])
            i += 1
        return "".join(out).rstrip()
    val = raw.split("/", 1)[0].strip()
    if val == "T":
        return True
    if val == "F":
        return False
    try:
        return int(val)
    except ValueError:
        pass
    try:
        return float(val.replace("D", "E"))
    except ValueError:
        return val


def read_header(f) -> dict | None:
    """Read one header (from the current position); None at end of file."""
    cards: dict = {}
    while True:
        block = f.read(BLOCK)
        if not block:
            return None if not cards else cards
        if len(block) < BLOCK:
            raise ValueError("truncated FITS header block")
        text = block.decode("ascii", errors="replace")
        for i in range(0, BLOCK, CARD):
            card = text[i : i + CARD]
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= " and key not in cards:
                cards[key] = _parse_value(card[10:])


def data_bytes(h: dict) -> int:
    naxis = int(h.get("NAXIS", 0))
    if naxis == 0:
        return 0
    n = 1
    for i in range(1, naxis + 1):
        n *= int(h[f"NAXIS{i}"])
    return abs(int(h.get("BITPIX", 8))) // 8 * int(h.get("GCOUNT", 1)) * (int(h.get("PCOUNT", 0)) + n)


@dataclass
class Column:
    name: str
    offset: int
    code: str
    repeat: int
    scale: float | None = None
    zero: float | None = None

    @property
    def readable(self) -> bool:
        return self.code in FORMATS and (self.repeat == 1 or self.code == "A")

    @property
    def unsigned(self) -> str | None:
        """Widened type for the unsigned-integer conventions, else None."""
        if self.scale in (None, 1.0) and self.zero is not None:
            if self.code == "B" and self.zero == -128:
                return "short"  # signed byte stored offset
            if self.code == "I" and self.zero == 32768:
                return "int"
            if self.code == "J" and self.zero == 2147483648:
                return "bigint"
        return None

    @property
    def spark_type(self) -> str:
        if self.unsigned:
            return self.unsigned
        if self.scale not in (None, 1.0) or self.zero not in (None, 0.0):
            return "double"
        return FORMATS[self.code][2]

    def numpy_dtype(self) -> str:
        width, dt, _ = FORMATS[self.code]
        return f"S{self.repeat}" if self.code == "A" else dt


@dataclass
class TableInfo:
    path: str
    data_start: int
    row_bytes: int
    n_rows: int
    columns: list[Column] = field(default_factory=list)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.upper() == name.upper():
                return c
        raise KeyError(f"{self.path}: no column {name!r} (have {[c.name for c in self.columns]})")


def _columns(h: dict) -> list[Column]:
    cols, off = [], 0
    for i in range(1, int(h.get("TFIELDS", 0)) + 1):
        m = TFORM_RE.match(str(h[f"TFORM{i}"]))
        if not m:
            raise ValueError(f"unsupported TFORM{i} = {h[f'TFORM{i}']!r}")
        repeat = int(m.group(1)) if m.group(1) else 1
        code = m.group(2)
        if code == "X":
            width = (repeat + 7) // 8
        elif code in FORMATS:
            width = FORMATS[code][0] * repeat
        else:
            width = OTHER_WIDTH[code] * repeat
        cols.append(
            Column(
                str(h.get(f"TTYPE{i}", f"COL{i}")).strip(),
                off,
                code,
                repeat,
                float(h[f"TSCAL{i}"]) if f"TSCAL{i}" in h else None,
                float(h[f"TZERO{i}"]) if f"TZERO{i}" in h else None,
            )
        )
        off += width
    if off != int(h["NAXIS1"]):
        raise ValueError(f"column widths add to {off} bytes, NAXIS1 is {h['NAXIS1']}")
    return cols


def scan_table(path: str, extname: str = FITS_EXTENSION) -> TableInfo:
    """Walk the HDUs of ``path`` and describe the BINTABLE named ``extname``."""
    with fsio.open_input(path) as f:
        first = True
        while True:
            h = read_header(f)
            if h is None:
                raise ValueError(f"{path}: no BINTABLE extension named {extname!r}")
            if first and not h.get("SIMPLE", False):
                raise ValueError(f"{path}: not a FITS file (no SIMPLE card)")
            start = f.tell()
            size = data_bytes(h)
            if not first and h.get("XTENSION") == "BINTABLE" and str(h.get("EXTNAME", "")).upper() == extname.upper():
                if h.get("ZTABLE") or h.get("ZIMAGE"):
                    raise ValueError(f"{path}: tile-compressed tables are not supported; decompress first")
                if int(h.get("GCOUNT", 1)) != 1:
                    raise ValueError(f"{path}: GCOUNT != 1")
                return TableInfo(path, start, int(h["NAXIS1"]), int(h["NAXIS2"]), _columns(h))
            first = False
            f.seek(start + (size + BLOCK - 1) // BLOCK * BLOCK)


def list_files(path: str, pattern: str = CATALOG_GLOB) -> list[str]:
    """A directory (searched recursively for ``pattern``), a local glob, or one file."""
    if fsio.is_dir(path):
        return fsio.find(path, pattern)
    if "://" not in path and any(ch in path for ch in "*?["):
        return sorted(glob.glob(path[len("file:"):] if path.startswith("file:") else path)) or [path]
    return [path]


def _files_of(options) -> list[str]:
    """``paths`` (a JSON list of files) when given, else ``path`` (file, glob or folder)."""
    if options.get("paths"):
        return sorted(_plain(p) for p in json.loads(options["paths"]))
    return list_files(options.get("path"), options.get("pattern", CATALOG_GLOB))


def _plain(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def _sized_files(options) -> list[tuple[str, int]]:
    """The same files with their lengths; ``lengths`` belong to ``paths`` one by one."""
    if options.get("paths") and options.get("lengths"):
        return sorted((_plain(p), n) for p, n in zip(json.loads(options["paths"]), json.loads(options["lengths"]), strict=True))
    files = _files_of(options)
    return list(zip(files, fsio.sizes(files), strict=True))


def _requested(info: TableInfo, columns: str | None) -> list[Column]:
    if columns:
        cols = [info.column(c.strip()) for c in columns.split(",") if c.strip()]
    else:
        cols = [c for c in info.columns if c.readable]
    for c in cols:
        if not c.readable:
            raise ValueError(f"{info.path}: column {c.name} has format {c.repeat}{c.code}; only scalar L B I J K E D and A are readable")
    return cols


#: The stop of a file's last range: whatever the listing said, all that the header promises is read.
TO_THE_END = 1 << 62


@dataclass
class FileRange:
    """The rows of a file that start at a byte in [start, stop)."""

    path: str
    start: int
    stop: int

    def rows(self, info: TableInfo) -> tuple[int, int]:
        first, last = (-((info.data_start - at) // max(1, info.row_bytes)) for at in (self.start, self.stop))
        return min(max(0, first), info.n_rows), min(max(0, last), info.n_rows)


@dataclass
class RangeGroup(InputPartition):
    """One task's work: consecutive ranges (of one or several small files)."""

    ranges: list


NUMPY_OF = {"short": np.int16, "int": np.int32, "bigint": np.int64, "float": np.float32, "double": np.float64}


def _decode(info: TableInfo, cols: list[Column], buf: bytes, first_row: int, n: int, with_path: bool) -> pa.RecordBatch:
    names = [c.name for c in cols]
    dt = np.dtype({"names": names, "formats": [c.numpy_dtype() for c in cols], "offsets": [c.offset for c in cols], "itemsize": info.row_bytes})
    rows = np.frombuffer(buf, dtype=dt, count=n)
    arrays = []
    for c in cols:
        v, kind = rows[c.name], _kind(c)
        if kind == "boolean":
            arrays.append(pa.array(v == ord("T")))
        elif kind == "string":
            # fixed-width ASCII, padded with blanks or NULs: trimmed in Arrow, not per row
            arrays.append(pc.utf8_rtrim(pc.cast(pa.array(v), pa.string()), characters=" \x00"))
        elif kind.startswith("unsigned_"):
            target = NUMPY_OF[kind[len("unsigned_"):]]
            arrays.append(pa.array((v.astype(np.int64) + int(c.zero)).astype(target)))
        elif kind == "scaled":
            arrays.append(pa.array(v.astype(np.float64) * (1.0 if c.scale is None else c.scale) + (c.zero or 0.0)))
        else:
            arrays.append(pa.array(v.astype(NUMPY_OF[kind])))
    arrays.append(pa.repeat(pa.scalar(os.path.basename(info.path), pa.string()), n))
    arrays.append(pa.array(np.arange(first_row, first_row + n, dtype=np.int64)))
    names += ["file_name", "row_index"]
    if with_path:
        arrays.append(pa.repeat(pa.scalar(info.path, pa.string()), n))
        names.append("path")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _kind(c: Column) -> str:
    if c.unsigned:
        return "unsigned_" + c.unsigned
    if c.scale not in (None, 1.0) or c.zero not in (None, 0.0):
        return "scaled"
    return c.spark_type


class FitsTableReader(DataSourceReader):
    def __init__(self, options, columns: list[Column]):
        self.options = options
        self.path = options.get("path")
        self.extname = options.get("extname", FITS_EXTENSION)
        self.pattern = options.get("pattern", CATALOG_GLOB)
        self.rows_per_part = options.get("rowsPerPartition")
        self.with_path = options.get("includePath", "false").lower() == "true"
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.min_partitions = int(options.get("minPartitions", 1))
        self.columns = columns

    def partitions(self):
        if self.rows_per_part:  # an explicit split in rows: one partition per range, planned from the headers
            return [RangeGroup([r]) for f in _files_of(self.options) for r in self._row_ranges(f)]
        files = _sized_files(self.options)
        # split size as Spark's file sources choose it: at most 128 MiB, at least
        # one open cost, and small enough to give every core a partition
        total = sum(n + OPEN_COST_BYTES for _, n in files)
        split = min(TARGET_PARTITION_BYTES, max(OPEN_COST_BYTES, total // max(1, self.min_partitions)))
        # pack small files (ranges) together up to the split size
        groups, current, size = [], [], 0
        for path, n in files:
            for start in range(0, max(1, n), split):
                cost = min(split, n - start) + OPEN_COST_BYTES
                if current and size + cost > split:
                    groups.append(RangeGroup(current))
                    current, size = [], 0
                current.append(FileRange(path, start, start + split if start + split < n else TO_THE_END))
                size += cost
        if current:
            groups.append(RangeGroup(current))
        return groups

    def _row_ranges(self, path: str) -> list[FileRange]:
        info = scan_table(path, self.extname)
        step = int(self.rows_per_part) * info.row_bytes
        end = info.data_start + info.n_rows * info.row_bytes
        return [FileRange(path, at, min(at + step, end)) for at in range(info.data_start, end, step)]

    def _layout(self, info: TableInfo) -> list[Column]:
        cols = [info.column(c.name) for c in self.columns]
        for c, want in zip(cols, self.columns):
            if c.spark_type != want.spark_type:
                raise ValueError(f"{info.path}: column {c.name} is {c.spark_type}, the first file has {want.spark_type}")
        return cols

    def read(self, group: RangeGroup):
        for rng in group.ranges:
            info = scan_table(rng.path, self.extname)
            cols = self._layout(info)
            at, last = rng.rows(info)
            if at >= last:
                continue
            with fsio.open_input(rng.path) as f:
                f.seek(info.data_start + at * info.row_bytes)
                per_batch = max(1, self.batch_bytes // info.row_bytes)
                while at < last:
                    n = min(per_batch, last - at)
                    buf = f.read(n * info.row_bytes)
                    if len(buf) != n * info.row_bytes:
                        raise ValueError(f"{rng.path}: truncated table data at row {at}")
                    yield _decode(info, cols, buf, at, n, self.with_path)
                    at += n


class FitsTableDataSource(DataSource):
    @classmethod
    def name(cls):
        return "fits_table"

    def _columns(self) -> list[Column]:
        files = _files_of(self.options)
        if not files or not fsio.exists(files[0]):
            raise FileNotFoundError(f"no FITS files at {self.options.get('path')}")
        info = scan_table(files[0], self.options.get("extname", FITS_EXTENSION))
        return _requested(info, self.options.get("columns"))

    def schema(self):
        cols = self._columns()
        extra = ", path string" if self.options.get("includePath", "false").lower() == "true" else ""
        return ", ".join(f"`{c.name}` {c.spark_type}" for c in cols) + ", file_name string, row_index bigint" + extra

    def reader(self, schema):
        return FitsTableReader(self.options, self._columns())


def register(spark) -> None:
    from skycat.session import ship_package

    ship_package(spark)
    spark.dataSource.register(FitsTableDataSource)


# ---------------------------------------------------------------------------
# Writing (test and benchmark fixtures only)
# ---------------------------------------------------------------------------

_NP_CODE = {"f8": "D", "f4": "E", "i8": "K", "i4": "J", "i2": "I", "u1": "B"}


def _card(key: str, value=None, comment: str = "") -> bytes:
    if value is None:
        text = f"{key:<8}"
    else:
        if isinstance(value, bool):
            v = f"{'T' if value else 'F':>20}"
        elif isinstance(value, str):
            v = f"'{value.replace(chr(39), chr(39) * 2):<8}'"
        else:
            v = f"{value:>20}"
        text = f"{key:<8}= {v}" + (f" / {comment}" if comment else "")
    return text[:CARD].ljust(CARD).encode("ascii")


def _header(cards: list[bytes]) -> bytes:
    raw = b"".join(cards) + _card("END")
    return raw + b" " * ((-len(raw)) % BLOCK)


def bintable_bytes(columns: dict[str, np.ndarray], extname: str = FITS_EXTENSION) -> bytes:
    """One BINTABLE HDU (header + big-endian rows, padded) for numeric columns."""
    names = list(columns)
    n = len(next(iter(columns.values()))) if columns else 0
    fields = []
    for name in names:
        a = np.asarray(columns[name])
        key = a.dtype.str[1:]
        fields.append((name, ">" + key if key != "u1" else "u1", _NP_CODE[key]))
    dt = np.dtype([(f, t) for f, t, _ in fields])
    rows = np.empty(n, dtype=dt)
    for name in names:
        rows[name] = columns[name]
    cards = [
        _card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", dt.itemsize),
        _card("NAXIS2", n), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(fields)),
    ]
    for i, (f, _t, code) in enumerate(fields, 1):
        cards += [_card(f"TTYPE{i}", f), _card(f"TFORM{i}", code)]
    cards.append(_card("EXTNAME", extname))
    body = rows.tobytes()
    return _header(cards) + body + b"\x00" * ((-len(body)) % BLOCK)


def primary_hdu() -> bytes:
    return _header([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True)])


def write_fits_table(path: str, columns: dict[str, np.ndarray], extname: str = FITS_EXTENSION, before: list[bytes] = ()) -> None:
    """Write a FITS file: primary HDU, any extra HDUs, then the table."""
    import uuid

    tmp = f"{path}.{uuid.uuid4().hex}.tmp"  # a retried or speculative task writes its own file
    fsio.write_bytes(tmp, [primary_hdu(), *before, bintable_bytes(columns, extname)])
    fsio.move(tmp, path)
