"""Small file-system helpers over pyarrow.fs: local paths, and any URI that pyarrow can open (hdfs, s3, gs).

Used on the driver for listings and by tasks for byte-range reads; no data
passes through the driver. Listings keep the scheme and authority of the path
that was asked for, so a task opens the same file system as the driver.
``qualify`` completes a path without a scheme by the session's default file system.
"""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

# Files that writers leave beside the data, never part of a dump.
_NO_DATA = re.compile(r"^(\..*|_SUCCESS|_started.*|_committed.*|_schema\.json|_temporary|.*\.crc|metadata\.json)$")


def qualify(path: str) -> str:
    """``path`` with the scheme of the session's default file system; local paths stay plain."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", path, re.I):
        return path
    spark = SparkSession.getActiveSession()
    if spark is None:
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return path if full.startswith("file:") else full


def _normal(path: str) -> str:
    """One spelling per file system: s3a and s3n are s3, and an authority may be empty."""
    path = re.sub(r"^s3[an]:", "s3:", path)
    return re.sub(r"^([a-z][a-z0-9+.-]*):/(?!/)", r"\1:///", path)


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    path = _normal(path)
    if path.startswith("file://"):
        return pafs.LocalFileSystem(), path[7:]
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def prefix_of(path: str) -> str:
    """What stands before the file system's own path in a URI; empty for local paths."""
    path = _normal(path).rstrip("/")
    if "://" not in path or path.startswith("file://"):
        return ""
    inner = resolve(path)[1].rstrip("/")
    if not path.endswith(inner):
        raise ValueError(f"cannot keep the file system of {path}")
    return path[: len(path) - len(inner)]


def list_files(path: str, recursive: bool = True) -> list[tuple[str, int]]:
    """(path, size) of every regular file under ``path`` (or the file itself), with the scheme of ``path``."""
    path = qualify(path)
    fs, p = resolve(path)
    prefix = prefix_of(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(prefix + p, info.size)]
    sel = pafs.FileSelector(p, recursive=recursive, allow_not_found=True)
    inside = lambda q: q[len(p.rstrip("/")) :].split("/")
    return sorted((prefix + fi.path, fi.size) for fi in fs.get_file_info(sel) if fi.type == pafs.FileType.File and not any(_NO_DATA.match(x) for x in inside(fi.path) if x))


def read_range(path: str, start: int, length: int) -> bytes:
    fs, p = resolve(path)
    with fs.open_input_file(p) as f:
        return f.read_at(length, start)


def file_size(path: str) -> int:
    fs, p = resolve(qualify(path))
    return fs.get_file_info(p).size


def modified(path: str) -> int | None:
    """When a file was last written, in nanoseconds, where its file system tells."""
    fs, p = resolve(qualify(path))
    return fs.get_file_info(p).mtime_ns


def exists(path: str) -> bool:
    fs, p = resolve(qualify(path))
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def write_bytes(path: str, data: bytes) -> None:
    fs, p = resolve(qualify(path))
    parent = p.rsplit("/", 1)[0]
    if parent:
        fs.create_dir(parent, recursive=True)
    with fs.open_output_stream(p, compression=None) as f:
        f.write(data)


def read_bytes(path: str) -> bytes:
    fs, p = resolve(qualify(path))
    with fs.open_input_stream(p, compression=None) as f:
        return f.read()


def move(src: str, dst: str) -> None:
    fs, s = resolve(src)
    _, d = resolve(dst)
    parent = d.rsplit("/", 1)[0]
    if parent:
        fs.create_dir(parent, recursive=True)
    fs.move(s, d)


def delete_dir(path: str) -> None:
    fs, p = resolve(qualify(path))
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def list_dirs(path: str) -> list[str]:
    path = qualify(path)
    fs, p = resolve(path)
    sel = pafs.FileSelector(p, recursive=False, allow_not_found=True)
    return sorted(prefix_of(path) + fi.path for fi in fs.get_file_info(sel) if fi.type == pafs.FileType.Directory)
