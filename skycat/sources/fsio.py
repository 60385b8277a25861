"""File access for the Python data sources through ``pyarrow.fs``.

Paths may be local (``/data/x``, ``file:/data/x``, ``file:///data/x``) or any
URI pyarrow understands (``hdfs://``, ``s3://``, ``gs://``), so the FITS and
packed-point sources read and write the cluster's shared storage directly.
"""

from __future__ import annotations

import fnmatch
import posixpath

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]  # Spark's file:/x form
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.split("://", 1)[1]  # Spark's names of the same store
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _uri(fs: pafs.FileSystem, p: str, like: str) -> str:
    """Give back a path in the caller's spelling (keep the scheme and host of ``like``)."""
    if "://" in like and not like.startswith("file:"):
        scheme, rest = like.split("://", 1)
        host = rest.split("/", 1)[0]
        if p.startswith(f"{scheme}://"):
            return p
        if p.startswith("/"):  # hdfs: the path without its name node
            return f"{scheme}://{host}{p}"
        if "@" in host:  # abfss: container/path without the account
            return f"{scheme}://{host}/{p.split('/', 1)[1]}"
        return f"{scheme}://{p}"
    return p


def name(path: str) -> str:
    return posixpath.basename(path)


def open_input(path: str):
    fs, p = resolve(path)
    return fs.open_input_file(p)


def size(path: str) -> int:
    fs, p = resolve(path)
    return fs.get_file_info(p).size


def sizes(paths: list[str]) -> list[int]:
    """Lengths of files: one listing for each folder they are in, and no request a file."""
    known: dict[str, dict[str, int]] = {}
    out = []
    for path in paths:
        fs, p = resolve(path)
        folder = posixpath.dirname(p)
        if (at := posixpath.dirname(path)) not in known:
            infos = fs.get_file_info(pafs.FileSelector(folder or ".", allow_not_found=True))
            known[at] = {posixpath.basename(i.path): i.size for i in infos if i.type == pafs.FileType.File}
        found = known[at].get(posixpath.basename(p))
        if found is None:
            raise FileNotFoundError(path)
        out.append(found)
    return out


def is_dir(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type == pafs.FileType.Directory


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def find(path: str, pattern: str, recursive: bool = True) -> list[str]:
    """Files under directory ``path`` whose base name matches ``pattern``, sorted."""
    fs, p = resolve(path)
    infos = fs.get_file_info(pafs.FileSelector(p, recursive=recursive))
    hits = [i.path for i in infos if i.type == pafs.FileType.File and fnmatch.fnmatch(posixpath.basename(i.path), pattern)]
    return sorted(_uri(fs, h, path) for h in hits)


def write_bytes(path: str, chunks) -> None:
    fs, p = resolve(path)
    parent = posixpath.dirname(p)
    if parent:
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(p) as out:
        for c in chunks:
            out.write(c)


def move(src: str, dst: str) -> None:
    """Rename, replacing a file at ``dst``: in one step where the file system can."""
    fs, s = resolve(src)
    _, d = resolve(dst)
    try:
        fs.move(s, d)
    except OSError:
        if fs.get_file_info(d).type != pafs.FileType.File or fs.get_file_info(s).type != pafs.FileType.File:
            raise
        fs.delete_file(d)  # this file system does not rename over a file
        fs.move(s, d)


def delete(path: str) -> None:
    fs, p = resolve(path)
    if fs.get_file_info(p).type == pafs.FileType.File:
        fs.delete_file(p)


def delete_folder(path: str) -> None:
    fs, p = resolve(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def local(path: str) -> str | None:
    """The path on a mounted file system, or None when it lives on another."""
    fs, p = resolve(path)
    return p if isinstance(fs, pafs.LocalFileSystem) else None


def qualified(spark, path: str) -> str:
    """A path without a scheme means the cluster's default file system, as for Spark's own sources."""
    if "://" in path or path.startswith("file:"):
        return path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return path if full.startswith("file:") else full


def join(path: str, name: str) -> str:
    return path.rstrip("/") + "/" + name


def dirname(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else "."
