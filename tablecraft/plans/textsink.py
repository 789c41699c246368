"""K5: text output with any codec.

gzip (and no codec) go through Spark's own text writer. zstd (level 3) and
xz (level 6) are not available to it, so they go through a Python data
source writer: each task streams its partition through the compressor into
a private temporary file, a new frame or stream every PART_BYTES; rows arrive as Arrow batches and are joined with
line feeds by Arrow kernels (no Python per row); the driver's commit moves the files of the
successful task attempts into place, abort removes them. A lost executor
therefore leaves no partial file behind.
"""

from __future__ import annotations

import itertools
import lzma
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources import fs

ZSTD_LEVEL = 3  # fixed value
XZ_LEVEL = 6  # fixed value
PART_BYTES = 16 << 20  # text of a frame or stream
EXT = {"zstd": ".sql.zst", "xz": ".sql.xz", "gzip": ".sql.gz", None: ".sql"}


def _lines(col: pa.Array) -> bytes:
    """All values of a string column, each followed by a line feed, as one byte block (Arrow kernels)."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    sep = pa.scalar("\n", pa.large_string())
    joined = pc.binary_join_element_wise(col, pa.scalar("", pa.large_string()), sep)
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    if len(joined) == 0:
        return b""
    offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)  # large_string: 64-bit value offsets
    start, end = int(offsets[joined.offset]), int(offsets[joined.offset + len(joined)])
    return memoryview(joined.buffers()[2])[start:end].tobytes()


@dataclass
class _Written(WriterCommitMessage):
    tmp: str | None
    final: str | None
    rows: int


class _CompressedWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.codec = options.get("codec", "zstd")
        self.job = options["job"]
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def _part(self, raw):
        if self.codec == "zstd":
            import zstandard

            return zstandard.ZstdCompressor(level=ZSTD_LEVEL).stream_writer(raw, closefd=False)
        return lzma.LZMAFile(raw, "wb", preset=XZ_LEVEL)

    def write(self, iterator):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        pid = ctx.partitionId() if ctx else 0
        ext = EXT[self.codec]
        tmp = f"{self.path}/_temporary/{self.job}/part-{pid:05d}-{uuid.uuid4().hex}{ext}"
        final = f"{self.path}/part-{pid:05d}{ext}"
        first = next(iterator, None)
        while first is not None and first.num_rows == 0:
            first = next(iterator, None)
        if first is None:
            return _Written(None, None, 0)  # no file for an empty partition; Spark takes no None for a message
        fsys, p = fs.resolve(tmp)
        fsys.create_dir(p.rsplit("/", 1)[0], recursive=True)
        n = 0
        with fsys.open_output_stream(p, compression=None) as raw:
            if self.codec not in ("zstd", "xz"):
                raise ValueError(f"codec {self.codec} is written by Spark's text writer")
            out, held = self._part(raw), 0
            for batch in itertools.chain([first], iterator):
                n += batch.num_rows
                lines = _lines(batch.column(0))
                if held and held + len(lines) > self.part_bytes:  # a frame or stream of its own, so that readers can share the file out
                    out.close()
                    out, held = self._part(raw), 0
                out.write(lines)
                held += len(lines)
            out.close()
        return _Written(tmp, final, n)

    def commit(self, messages):
        for m in messages:
            if m is not None and m.tmp is not None:
                fs.move(m.tmp, m.final)
        fs.delete_dir(f"{self.path}/_temporary")

    def abort(self, messages):
        fs.delete_dir(f"{self.path}/_temporary/{self.job}")


class CompressedText(DataSource):
    @classmethod
    def name(cls):
        return "tablecraft_text"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _CompressedWriter(self.options)


def write_text(df: DataFrame, path: str, codec: str | None = None, part_bytes: int = PART_BYTES) -> None:
    """Write a one-column string frame, one row per line (plus the row's own line feeds)."""
    codec = {"gz": "gzip", "zst": "zstd"}.get(codec, codec)
    if codec in (None, "none", "gzip"):
        w = df.write.mode("errorifexists")
        if codec == "gzip":
            w = w.option("compression", "gzip")
        w.text(path)
        return
    df.sparkSession.dataSource.register(CompressedText)
    if fs.exists(path):
        raise FileExistsError(path)
    df.write.format("tablecraft_text").option("path", path).option("codec", codec).option("part_bytes", part_bytes).option("job", uuid.uuid4().hex).mode("append").save()
