"""Parts of compressed files that can be read by themselves, so that one large file is read by many tasks.

zstd: frames, found by walking the headers of frames and blocks without unpacking. xz: blocks, from the index at the end
of each stream. gzip: members; where they begin is only known by unpacking, so tasks look for a member's header in
their own range of the file and unpack from there, and the members that follow one another without a gap are the true
ones. A file that is one frame, block or member is read as a stream by one task.

Formats as published: RFC 8878 (zstd), the .xz file format 1.1, RFC 1952 (gzip).
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator

from . import fs

NEAR, READ = 64 << 10, 1 << 20
#: Bytes unpacked at once.
OUT = 4 << 20


class _Window:
    """Random reads of a file through a buffer."""

    def __init__(self, path: str, size: int):
        fsys, p = fs.resolve(path)
        self.file, self.size, self.at, self.buf = fsys.open_input_file(p), size, 0, b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def read(self, start: int, n: int) -> bytes:
        if start < self.at or start + n > self.at + len(self.buf):
            self.at, self.buf = start, self.file.read_at(min(max(n, READ), max(self.size - start, 0)), start)
        return self.buf[start - self.at : start - self.at + n]

    def pieces(self, start: int, end: int) -> Iterator[bytes]:
        step = NEAR  # who needs little of it reads little
        while start < end and (piece := self.file.read_at(min(step, end - start), start)):
            start, step = start + len(piece), min(2 * step, READ)
            yield piece


# Magic numbers.
_ZSTD, _ZSTD_SKIP, _XZ, _XZ_END, _GZIP = 0xFD2FB528, 0x184D2A50, b"\xfd7zXZ\x00", b"YZ", b"\x1f\x8b\x08"


def zstd_frames(path: str, size: int) -> Iterator[tuple[int, int]]:
    """(start, end) of every frame."""
    with _Window(path, size) as w:
        at = 0
        while at < size:
            magic = struct.unpack("<I", w.read(at, 4))[0]
            begin = at
            if magic & 0xFFFFFFF0 == _ZSTD_SKIP:
                at += 8 + struct.unpack("<I", w.read(at + 4, 4))[0]
                continue
            if magic != _ZSTD:
                raise ValueError(f"{path} has no zstd frame at byte {at}")
            flags = w.read(at + 4, 1)[0]
            single, content = flags >> 5 & 1, flags >> 6
            at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0) if content == 0 else 1 << content)
            last = False
            while not last:
                if at >= size:
                    raise ValueError(f"the zstd frame at byte {begin} of {path} is cut short")
                head = int.from_bytes(w.read(at, 3), "little")
                last, kind, length = bool(head & 1), head >> 1 & 3, head >> 3
                at += 3 + (1 if kind == 1 else length)
            at += 4 if flags >> 2 & 1 else 0
            if at > size:
                raise ValueError(f"the zstd frame at byte {begin} of {path} is cut short")
            yield begin, at


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number of the xz format, and the place behind it."""
    value, shift = 0, 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 0x7F) << shift, at + 1, shift + 7
        if not byte & 0x80:
            return value, at


def xz_blocks(path: str, size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, start of the stream, end of the stream's blocks) of every block."""
    out, end = [], size
    with _Window(path, size) as w:
        while end > 0:
            while w.read(end - 4, 4) == b"\0\0\0\0":  # padding between streams
                end -= 4
            footer = w.read(end - 12, 12)
            if footer[10:] != _XZ_END:
                raise ValueError(f"{path} has no xz stream that ends at byte {end}")
            length = (struct.unpack("<I", footer[4:8])[0] + 1) * 4
            index = w.read(end - 12 - length, length)
            n, at = _number(index, 1)
            sizes = []
            for _ in range(n):
                packed, at = _number(index, at)
                _, at = _number(index, at)
                sizes.append(-(-packed // 4) * 4)
            stop = end - 12 - length
            start = stop - sum(sizes)
            head, at = start - 12, start
            for s in sizes:
                out.append((at, at + s, head, stop))
                at += s
            end = head
    return sorted(out)


def gzip_members(path: str, size: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """(start, end) of what unpacks as a member and begins in [lo, hi)."""
    out, at = [], lo
    with _Window(path, size) as w:
        while at < hi:
            data = w.read(at, READ)
            k = data.find(_GZIP)
            if k < 0:
                if at + len(data) >= size:
                    break
                at += len(data) - 2
                continue
            at += k
            if at >= hi:
                break
            end = _member_end(w, at, size)
            if end is None:
                at += 1
            else:
                out.append((at, end))
                at = end
    return out


def _member_end(w: _Window, at: int, size: int) -> int | None:
    unpack, done = zlib.decompressobj(31), at
    try:
        for piece in w.pieces(at, size):
            rest = piece
            while rest and not unpack.eof:
                unpack.decompress(rest, OUT)
                rest = unpack.unconsumed_tail
            done += len(piece)
            if unpack.eof:
                return done - len(unpack.unused_data)
    except zlib.error:
        return None
    return None


def unpacked(path: str, codec: str, size: int, lo: int, hi: int, head: int | None = None, stop: int | None = None) -> Iterator[bytes]:
    """The content of whole frames, blocks or members in [lo, hi) of a file; xz blocks with the place of their stream.

    With ``hi`` at the end of the file, xz goes on with the streams behind the one of the first block.
    """
    with _Window(path, size) as w:
        if codec == "zstd":
            import zstandard

            make = lambda: zstandard.ZstdDecompressor().decompressobj()
            unpack = make()
            for piece in w.pieces(lo, hi):
                while piece:
                    if data := unpack.decompress(piece):
                        yield data
                    piece = unpack.unused_data if unpack.eof else b""
                    unpack = make() if unpack.eof else unpack
        elif codec == "gzip":
            unpack = zlib.decompressobj(31)
            for piece in w.pieces(lo, hi):
                while piece:
                    if data := unpack.decompress(piece, OUT):
                        yield data
                    if unpack.eof:
                        piece, unpack = unpack.unused_data.lstrip(b"\0"), zlib.decompressobj(31)
                    else:
                        piece = unpack.unconsumed_tail
        else:
            yield from _unxz(w, lo, min(hi, stop), w.read(head, 12))
            if hi > stop:
                at = stop  # behind the index and footer of this stream, whole streams follow
                while at < size and w.read(at, 6) != _XZ:
                    at += 4
                while at < size:
                    ends = lzma.LZMADecompressor(lzma.FORMAT_XZ)
                    for piece in w.pieces(at, size):
                        at += len(piece)
                        while True:
                            if data := ends.decompress(piece, OUT):
                                yield data
                            piece = b""
                            if ends.eof or ends.needs_input:
                                break
                        if ends.eof:
                            at -= len(ends.unused_data)
                            break
                    while at < size and w.read(at, 4) == b"\0\0\0\0":
                        at += 4
                    if not ends.eof:
                        return


def _unxz(w: _Window, lo: int, hi: int, header: bytes) -> Iterator[bytes]:
    """Blocks of one stream, unpacked behind the stream's header as if they were its first ones."""
    unpack = lzma.LZMADecompressor(lzma.FORMAT_XZ)
    unpack.decompress(header)
    for piece in w.pieces(lo, hi):
        while True:
            if data := unpack.decompress(piece, OUT):
                yield data
            piece = b""
            if unpack.needs_input:
                break
