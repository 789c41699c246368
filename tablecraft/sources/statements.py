"""SQL dump text -> DataFrame of statements, in parallel.

Files are cut into chunks of about ``chunk_bytes``: plain files after a line feed, or anywhere if there is none within
READ_BLOCK bytes; compressed files (.gz .gzip .zst .zstd .xz, any case) between members, frames or blocks, whose index
is built by ``blocks``. Pass 1 (one Spark task per chunk, in bounded blocks) runs the automaton of ``splitter`` over its
chunk and reports the end state and the number of statement ends; a grouped task per file composes these small rows to
learn the true start state of every chunk. A chunk is scanned from the normal state first, and only where a file's
chain leaves that state, once more from every state that is possible there. A state may be pending: the last byte
before a cut (``-`` ``/`` ``*`` or a backslash) may need its successor, and is read again with the next chunk.
Pass 2 starts each chunk in its true state and emits the statements that *begin* in it, reading past the chunk end only
to finish the last one. Files of one chunk skip pass 1.

Line mode (``DELIMITER`` aware) composes in the same way, over states that hold the delimiter in force as well.
"""

from __future__ import annotations

import gzip
import io
import itertools
import json
import lzma
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fs
from ..session import ensure_checkpoint_dir
from .blocks import gzip_members, unpacked, xz_blocks, zstd_frames
from .splitter import B, L, N, Q1, Q2, Q3, Automaton, strip_comments

DEFAULT_CHUNK = 64 << 20
MAX_STATEMENT = 64 << 20  # fixed value: largest statement accepted on load
READ_BLOCK = 1 << 20  # how far a cut looks for a line feed
BLOCK = 4 << 20  # bytes read at once
NEAR = 64 << 10  # bytes of the first read behind a place of which little may be needed; each further one is twice as long
PACKED = 4  # a chunk of a compressed file has a fraction of the bytes
MOST_TASKS = 20_000
TASK_BYTES = 8 << 20  # small chunks share a task of about so many bytes
FLUSH_BYTES = 16 << 20  # statement text that a task holds before it passes it on

STMT_SCHEMA = "file string, stmt_no long, byte_start long, byte_end long, stmt string"
LINE_SCHEMA = "file string, stmt_no long, start_line long, stmt string"

_CODECS = ((".gzip", "gzip"), (".gz", "gzip"), (".zstd", "zstd"), (".zst", "zstd"), (".xz", "xz"))


def detect_codec(path: str) -> str | None:
    """Codec from the file name, case-insensitive (``.sql.gz`` and friends)."""
    p = path.lower()
    for ext, codec in _CODECS:
        if p.endswith(ext):
            return codec
    return None


def open_stream(path: str, codec: str | None):
    fsys, p = fs.resolve(path)
    f = fsys.open_input_stream(p, compression=None)
    if codec is None:
        return f
    if codec == "gzip":
        return gzip.GzipFile(fileobj=f)
    if codec == "xz":
        return lzma.LZMAFile(f)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True)
    raise ValueError(f"unknown codec {codec}")


# ---------------------------------------------------------------------------
# per-task helpers
# ---------------------------------------------------------------------------

def _cut(path: str, size: int, nominal: int) -> int:
    """Where the chunk at ``nominal`` starts: after the first line feed of the next READ_BLOCK bytes, else right there."""
    if nominal >= size:
        return size
    pos = nominal - 1
    for blk in _ranges(path, pos, min(pos + READ_BLOCK, size), NEAR):
        if (k := blk.find(b"\n")) >= 0:
            return pos + k + 1
        pos += len(blk)
    return nominal


def _ranges(path: str, start: int, end: int, step: int) -> Iterator[bytes]:
    """The bytes of a plain file in [start, end), first ``step`` of them and then twice as many each time, up to BLOCK."""
    while start < end and (blk := fs.read_range(path, start, min(step, end - start))):
        yield blk
        start, step = start + len(blk), min(2 * step, BLOCK)


def _stream_statements(blocks, base, state, own_first, owned_end, aut: Automaton, max_bytes, eof_known=None):
    """Yield (byte_start, byte_end, text) for statements that start before ``owned_end``.

    ``blocks`` yields consecutive byte blocks starting at absolute offset
    ``base``; ``own_first`` says whether ``base`` itself starts a statement.
    """
    buf = b""
    buf_base = base
    pos = 0
    stmt_start = base if own_first else None
    marks: list[int] = []  # comment start/end offsets, alternating
    if state in (B, L):
        marks.append(base)  # the chunk starts inside a comment
    it = iter(blocks)
    final = False
    while True:
        blk = next(it, None)
        if blk is None:
            final = True
        else:
            buf = buf + blk if buf else blk
        semis: list[int] = []
        pos, state, _ = aut.advance(buf, pos, state, len(buf), final, semis, marks, base=buf_base)
        for q in semis:
            if stmt_start is not None:
                yield _stmt(buf, buf_base, stmt_start, q + 1, marks, max_bytes, aut.executable)
            if q + 1 < owned_end:
                stmt_start = q + 1
            else:
                return
        eof = buf_base + len(buf)
        if final:
            if stmt_start is not None and stmt_start < eof:
                yield _stmt(buf, buf_base, stmt_start, eof, marks, max_bytes, aut.executable)
            return
        if stmt_start is None and buf_base + pos >= owned_end:
            return
        if max_bytes is not None and stmt_start is not None and buf_base + pos - stmt_start > max_bytes:
            raise ValueError(f"statement at byte {stmt_start} exceeds maximum size of {max_bytes} bytes")
        keep = stmt_start if stmt_start is not None else buf_base + pos
        cut = keep - buf_base
        if cut > 0:
            buf = buf[cut:]
            buf_base += cut
            pos -= cut
            _prune(marks, keep)


def _prune(marks: list[int], keep: int) -> None:
    i = 0
    while i + 1 < len(marks) and marks[i + 1] <= keep:
        i += 2
    if i:
        del marks[:i]


def _stmt(buf, buf_base, s, e, marks, max_bytes, executable):
    if max_bytes is not None and e - s > max_bytes:
        raise ValueError(f"statement at byte {s} exceeds maximum size of {max_bytes} bytes")
    spans = []
    for i in range(0, len(marks), 2):
        cs = marks[i]
        ce = marks[i + 1] if i + 1 < len(marks) else e
        if ce > s and cs < e:
            spans.append((cs, ce))
    text = strip_comments(buf[s - buf_base : e - buf_base], s, spans, executable)
    return s, e, text


def _content(r: dict, end: int) -> Iterator[bytes]:
    """The bytes of a file from the start of chunk ``r``: to the chunk's end (``end`` = its hi) or to the file's."""
    if r["codec"]:
        yield from unpacked(r["path"], r["codec"], r["size"], r["lo"], end, r["head"], r["stop"])
        return
    yield from _ranges(r["path"], r["lo"], min(r["hi"], end), BLOCK)
    yield from _ranges(r["path"], r["hi"], end, NEAR)  # the last statement's rest, which is mostly short


# ---------------------------------------------------------------------------
# Spark jobs
# ---------------------------------------------------------------------------

def _stream_blocks(stream, size=8 << 20):
    while blk := stream.read(size):
        yield blk


#: Bytes that may need their successor, by state. A state at a cut is its number plus 8 for the first of them pending, 16 for the second.
_PENDING = {N: b"-/", Q1: b"\\", Q2: b"\\", Q3: b"\\", B: b"*", L: b""}

_CHUNK = [("path", pa.string(), "string"), ("size", pa.int64(), "long"), ("codec", pa.string(), "string"), ("j", pa.int64(), "long"), ("lo", pa.int64(), "long"), ("hi", pa.int64(), "long"),
          ("head", pa.int64(), "long"), ("stop", pa.int64(), "long")]
_SCAN = [*_CHUNK, ("base", pa.int64(), "long"), ("raw", pa.int64(), "long"), ("last", pa.int32(), "int"), ("before", pa.int32(), "int"), ("codes", pa.list_(pa.int32()), "array<int>"),
         ("ends", pa.list_(pa.int32()), "array<int>"), ("semis", pa.list_(pa.int64()), "array<long>"), ("miss", pa.int32(), "int"), ("count", pa.int64(), "long")]
_PLAN = [*_CHUNK, ("base", pa.int64(), "long"), ("raw", pa.int64(), "long"), ("code", pa.int32(), "int"), ("own", pa.bool_(), "boolean"), ("stmt_offset", pa.int64(), "long")]
_FOLD = [*_PLAN, ("before", pa.int32(), "int"), ("miss", pa.int32(), "int"), ("count", pa.int64(), "long")]
_ddl = lambda cols: ", ".join(f"`{n}` {t}" for n, _, t in cols)


def _pending(code: int, mysql: bool) -> bytes:
    """The byte before a cut that a state still has to see."""
    k = code >> 3
    return _PENDING[code & 7][k - 1 : k] if k else b""


def _possible(before: int, mysql: bool) -> list[int]:
    """States that a chunk may start in, by the byte before it."""
    states = [N, Q1, Q2, Q3, B] + ([L] if before != 10 else [])
    return states + [st + 8 * (k + 1) for st in states for k, c in enumerate(_PENDING[st]) if c == before and (mysql or st in (N, B))]


class _Runner:
    """The automaton over a chunk that comes block by block."""

    def __init__(self, aut: Automaton, code: int):
        self.aut, self.state, self.carry, self.semis = aut, code & 7, _pending(code, aut.executable), 0

    def feed(self, block: bytes) -> None:
        buf = self.carry + block
        pos, self.state, n = self.aut.advance(buf, 0, self.state, len(buf), False)
        self.carry, self.semis = buf[pos:], self.semis + n

    def end(self) -> int:
        """The state behind the chunk."""
        if self.carry and (self.aut.executable or self.state in (N, B)) and (k := _PENDING[self.state].find(self.carry)) >= 0:
            return self.state + 8 * (k + 1)
        if self.carry:
            _, self.state, n = self.aut.advance(self.carry, 0, self.state, len(self.carry), True)
            self.carry, self.semis = b"", self.semis + n
        return self.state


def _pass1(dialect: str):
    """Per chunk: end state and statement count from the normal state, or (second time, with ``before``) from all possible ones.

    The first time, plain chunks come with the places where they would start and end but for line feeds.
    """

    def run(batches):
        aut = Automaton(dialect)
        for b in batches:
            out = {n: [] for n, *_ in _SCAN}
            for r in b.to_pylist():
                again = r.get("miss") is not None
                if not again and not r["codec"]:
                    r["lo"] = _cut(r["path"], r["size"], r["lo"]) if r["j"] else r["lo"]
                    r["hi"] = _cut(r["path"], r["size"], r["hi"])
                codes = ([r["miss"]] if r["miss"] >= 0 else _possible(r["before"], aut.executable)) if again else [N]
                runners, raw, last = [_Runner(aut, c) for c in codes], 0, None
                for blk in _content(r, r["hi"]):
                    raw, last = raw + len(blk), blk[-1]
                    for x in runners:
                        x.feed(blk)
                ends = [x.end() for x in runners]
                row = r | {"raw": raw, "last": last, "codes": codes, "ends": ends, "semis": [x.semis for x in runners]}
                for k, v in out.items():
                    v.append(row.get(k))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, t) for n, t, _ in _SCAN]))

    return run


def _decoded(text: bytes, path: str, at: int, encoding: str) -> str:
    """The statement as text; bytes that are none in ``encoding`` are an error, never replaced."""
    try:
        return text.decode(encoding)
    except UnicodeDecodeError as e:
        raise ValueError(f"statement at byte {at} of {path} is not {encoding}: {e}") from None


def _pass2(dialect: str, max_bytes: int | None, encoding: str = "utf-8"):
    def run(batches):
        aut = Automaton(dialect)
        for b in batches:
            out, held = {"file": [], "stmt_no": [], "byte_start": [], "byte_end": [], "stmt": []}, 0
            for r in b.to_pylist():
                path, before = r["path"], _pending(r["code"], aut.executable)
                if r["codec"] and r["raw"] is None:  # one task for the whole file
                    blocks, end = _stream_blocks(open_stream(path, r["codec"])), float("inf")
                else:
                    blocks, end = _content(r, r["size"]), r["base"] + r["raw"]
                gen = _stream_statements(itertools.chain([before], blocks) if before else blocks, r["base"] - len(before), r["code"] & 7, r["own"], end, aut, max_bytes)
                no = r["stmt_offset"]
                for s, e, text in gen:
                    out["file"].append(path)
                    out["stmt_no"].append(no)
                    out["byte_start"].append(s)
                    out["byte_end"].append(e)
                    out["stmt"].append(_decoded(text, path, s, encoding))
                    no, held = no + 1, held + len(text)
                    if len(out["stmt"]) >= 2048 or held >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_pydict(out)
                        out, held = {k: [] for k in out}, 0
            if out["stmt"]:
                yield pa.RecordBatch.from_pydict(out)

    return run


def list_dump_files(path) -> list[tuple[str, int]]:
    """(path, size) of the statement files under ``path`` (a folder, a file or a list of files)."""
    if isinstance(path, (list, tuple)):
        return sorted((fs.prefix_of(q) + fs.resolve(q)[1], fs.file_size(q)) for q in map(fs.qualify, path))
    return fs.list_files(path)


def read_statements(spark: SparkSession, path, dialect: str = "mysql", chunk_bytes: int | None = None,
                    max_stmt_bytes: int | None = MAX_STATEMENT, start_byte: int | dict[str, int] = 0,
                    encoding: str = "utf-8") -> DataFrame:
    """S3: DataFrame(file, stmt_no, byte_start, byte_end, stmt) over every file under ``path``.

    ``start_byte`` (S10) resumes an uncompressed load at byte positions that
    begin a statement: a number for a single file, or {file: byte}; files
    that are not in the dict are left out. Comments become one space;
    statements keep their terminating ``;`` and surrounding white space.
    """
    files = list_dump_files(path)
    if not files:
        return spark.createDataFrame([], STMT_SCHEMA)
    chunk_bytes = chunk_bytes or DEFAULT_CHUNK
    if isinstance(start_byte, dict):
        sizes = dict(files)
        if missing := sorted(set(start_byte) - set(sizes)):
            raise ValueError(f"no such files to resume: {missing}")
        if packed := [p for p in start_byte if detect_codec(p)]:
            raise ValueError(f"compressed files cannot be resumed: {packed}")
        if not start_byte:
            return spark.createDataFrame([], STMT_SCHEMA)
        return _read_files(spark, [(p, sizes[p]) for p in sorted(start_byte)], dialect, chunk_bytes, max_stmt_bytes, start_byte, encoding)
    if start_byte and (len(files) != 1 or detect_codec(files[0][0])):
        raise ValueError("start_byte as a number needs exactly one uncompressed file")
    return _read_files(spark, files, dialect, chunk_bytes, max_stmt_bytes, {p: start_byte for p, _ in files}, encoding)


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int, int]], dialect: str = "mysql", max_stmt_bytes: int | None = MAX_STATEMENT, encoding: str = "utf-8") -> DataFrame:
    """The statements of ``ranges`` (path, first byte, byte behind, number of the first statement) of plain files, as ``read_statements`` gives them.

    Both bytes begin a statement or are the file's ends; nothing else of the files is read.
    """
    rows = [(p, hi, None, 0, lo, hi, None, None, lo, hi - lo, N, True, no) for p, lo, hi, no in ranges]
    plan = spark.createDataFrame(rows, _ddl(_PLAN)).repartition(_tasks(spark, len(rows), sum(hi - lo for _, lo, hi, _ in ranges)))
    return plan.mapInArrow(_pass2(dialect, max_stmt_bytes, encoding), STMT_SCHEMA)


def _index(batches):
    """Frames, blocks or members of compressed files: (path, size, codec, lo, hi, head, stop)."""
    names = ("path", "size", "codec", "lo", "hi", "head", "stop")
    for b in batches:
        for r in b.to_pylist():
            path, size = r["path"], r["size"]
            if r["codec"] == "zstd":
                found = ((lo, hi, None, None) for lo, hi in zstd_frames(path, size))
            elif r["codec"] == "xz":
                found = xz_blocks(path, size)
            else:
                found = [(lo, hi, None, None) for lo, hi in gzip_members(path, size, r["from"], r["to"])]
                if r["from"] == 0 and (not found or found[0][0]):
                    found.insert(0, (0, size, None, None))  # no whole member at the start: read as a stream, which says what is wrong
            rows = [(path, size, r["codec"], *x) for x in found]
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=list(names))


def _parts(spark: SparkSession, packed: list[tuple[str, int, str]], chunk_bytes: int) -> DataFrame:
    """Chunks (_CHUNK) of large compressed files: neighbouring parts of one stream, of about ``chunk_bytes`` packed bytes."""
    rows = []
    for path, size, codec in packed:
        step = chunk_bytes if codec == "gzip" else size
        rows += [(path, size, codec, at, min(at + step, size)) for at in range(0, size, step)]
    ranges = spark.createDataFrame(rows, "path string, size long, codec string, `from` long, `to` long").repartition(_tasks(spark, len(rows), PACKED * sum(s for _, s, _ in packed)))
    found = ranges.mapInArrow(_index, "path string, size long, codec string, lo long, hi long, head long, stop long")
    order = Window.partitionBy("path").orderBy("lo")
    # a member is true if the one before it ends where it begins; unpacking finds no member inside another but by chance
    found = found.withColumn("gap", (F.col("codec") == "gzip") & (F.col("lo") != F.coalesce(F.lag("hi").over(order), F.lit(0))))
    every = Window.partitionBy("path")
    broken = F.max("gap").over(every) | (F.max("hi").over(every) != F.col("size"))
    found = found.withColumn("part", F.when((F.col("codec") == "gzip") & broken, F.lit(0)).otherwise(F.floor((F.sum(F.col("hi") - F.col("lo")).over(order) - (F.col("hi") - F.col("lo"))) / chunk_bytes)))
    parts = found.groupBy("path", "size", "codec", "head", "stop", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.withColumn("j", F.row_number().over(Window.partitionBy("path").orderBy("lo")) - 1).select(*[F.col(n).cast(t) for n, _, t in _CHUNK])


def _tasks(spark: SparkSession, n: int, size: int) -> int:
    """Tasks for ``n`` chunks of ``size`` bytes in all: one each, but several chunks a task where they are small or very many."""
    return max(1, min(n, MOST_TASKS, max(4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def _read_files(spark: SparkSession, files: list[tuple[str, int]], dialect: str, chunk_bytes: int, max_stmt_bytes: int | None,
                starts: dict[str, int], encoding: str) -> DataFrame:
    """Statements of all files, of plain ones from the byte in ``starts`` on: one plan, however many files there are."""
    starts = {p: max(at, 0) for p, at in starts.items()}
    plain = [(p, s) for p, s in files if not detect_codec(p)]
    packed = [(p, s, detect_codec(p)) for p, s in files if detect_codec(p)]
    # files of one chunk start in the normal state: no pass 1 needed. Text packs to a fraction, so packed chunks are smaller
    packed_bytes = max(1, chunk_bytes // PACKED)
    whole = [(p, s, None, 0, starts[p], s, None, None, starts[p], s - starts[p], N, True, 0) for p, s in plain if s - starts[p] <= chunk_bytes]
    whole += [(p, s, c, 0, 0, s, None, None, 0, None, N, True, 0) for p, s, c in packed if s <= packed_bytes]
    plain = [(p, s) for p, s in plain if s - starts[p] > chunk_bytes]
    packed = [(p, s, c) for p, s, c in packed if s > packed_bytes]
    parts = []
    if whole:
        size = sum((s if c is None else PACKED * s) for _, s, c, *_ in whole)
        parts.append(spark.createDataFrame(whole, _ddl(_PLAN)).repartition(_tasks(spark, len(whole), size)))
    scans, total, size = [], 0, 0
    if plain:
        fdf = spark.createDataFrame([(p, s, starts[p]) for p, s in plain], "path string, size long, start long")
        nchunks = F.ceil((F.col("size") - F.col("start")) / F.lit(chunk_bytes)).cast("long")
        chunks = fdf.select("path", "size", "start", F.explode(F.sequence(F.lit(0).cast("long"), nchunks - 1)).alias("j"))
        none = lambda t: F.lit(None).cast(t)
        lo = F.col("start") + F.col("j") * chunk_bytes
        scans.append(chunks.select("path", "size", none("string").alias("codec"), "j", lo.alias("lo"), (lo + chunk_bytes).alias("hi"), *[none("long").alias(c) for c in ("head", "stop")]))
        total += sum(-(-(s - starts[p]) // chunk_bytes) for p, s in plain)
        size += sum(s - starts[p] for p, s in plain)
    if packed:
        ensure_checkpoint_dir(spark)
        found = _parts(spark, packed, packed_bytes).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("path"))).checkpoint(eager=True)  # a small row per chunk
        streams = found.where("of = 1").select("path", "size", "codec", F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("lo"), F.col("size").alias("hi"), "head", "stop", F.lit(0).cast("long").alias("base"),
                                               F.lit(None).cast("long").alias("raw"), F.lit(N).alias("code"), F.lit(True).alias("own"), F.lit(0).cast("long").alias("stmt_offset"))
        packed_size = PACKED * sum(s for _, s, _ in packed)
        parts.append(streams.repartition(_tasks(spark, len(packed), packed_size)))
        scans.append(found.where("of > 1").drop("of"))
        total += sum(-(-s // packed_bytes) for _, s, _ in packed)
        size += packed_size
    if scans:
        chunks = scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])
        ensure_checkpoint_dir(spark)
        tasks = _tasks(spark, total, size)
        # pass 1a: one scan per chunk, from the normal state only (right for nearly every
        # line-aligned chunk); the per-file fold keeps the chain while it stays normal
        p1 = chunks.withColumn("miss", F.lit(None).cast("int")).repartition(tasks).mapInArrow(_pass1(dialect), _ddl(_SCAN))
        f1 = p1.groupBy("path").applyInPandas(_fold_normal, _ddl(_FOLD)).checkpoint(eager=True)  # one small row per chunk
        plan_cols = [n for n, *_ in _PLAN]
        # pass 1b: chunks after a file's chain left the normal state, scanned from all states that are possible there
        tail = f1.where("miss IS NOT NULL").repartition(tasks)
        rest = tail.mapInArrow(_pass1(dialect), _ddl(_SCAN)).groupBy("path").applyInPandas(_fold_tail, _ddl(_PLAN))
        parts.append(f1.where("miss IS NULL").select(*plan_cols).unionByName(rest).repartition(tasks))
    inp = parts[0]
    for extra in parts[1:]:
        inp = inp.unionByName(extra)
    return inp.mapInArrow(_pass2(dialect, max_stmt_bytes, encoding), STMT_SCHEMA)


def _planned(r, base: int, code: int, count: int, before: int) -> dict:
    """The plan row of a chunk that starts in state ``code`` after ``count`` statement ends and the byte ``before``."""
    own = r.j == 0 or (code == N and before == 59)  # a statement begins right at the cut behind a ;
    return {n: getattr(r, n) for n, *_ in _CHUNK} | {"base": base, "raw": r.raw, "code": code, "own": own, "stmt_offset": count + (0 if own else 1)}


def _frame(rows: list[dict], cols):
    import pandas as pd

    kinds = {"string": "object", "array<int>": "object", "array<string>": "object", "boolean": "boolean", "long": "Int64", "int": "Int32"}
    return pd.DataFrame({n: pd.array([r.get(n) for r in rows], dtype=kinds[t]) for n, _, t in cols})


def _in_order(pdf):
    """Chunks of one file that hold anything, in order, with their place in the unpacked file."""
    pdf = pdf[pdf["raw"] > 0].sort_values("j")
    for c in ("head", "stop"):
        pdf[c] = pdf[c].astype("object").where(pdf[c].notna(), None)
    first = pdf["lo"] if len(pdf) and pdf["codec"].iloc[0] is None else 0
    pdf["base"] = first if len(pdf) and pdf["codec"].iloc[0] is None else pdf["raw"].cumsum() - pdf["raw"]
    return pdf


def _fold_normal(pdf):
    """Pass-1a rows of one file (end state from the normal state only), in chunk order.

    While the chain stays in the normal state each chunk gets its plan row; from the first chunk that starts elsewhere
    on, rows carry ``miss`` (that chunk's start state, -1 for the later ones), the byte before them, and the statement
    ends before the first of them.
    """
    code, count, before, out, missed = N, 0, 10, [], False
    for r in _in_order(pdf).itertuples(index=False):
        row = _planned(r, int(r.base), code, count, before)
        if not missed and code == N:
            out.append(row)
            code, count = int(r.ends[0]), count + int(r.semis[0])
        else:
            out.append(row | {"before": before, "miss": -1 if missed else code, "count": count})
            missed = True
        before = int(r.last)
    return _frame(out, _FOLD)


def _fold_tail(pdf):
    """Pass-1b rows of one file from its first unresolved chunk on, each with all its possible start states."""
    pdf = pdf.sort_values("j")
    for c in ("head", "stop"):
        pdf[c] = pdf[c].astype("object").where(pdf[c].notna(), None)
    code, count, out = int(pdf["miss"].iloc[0]), int(pdf["count"].iloc[0]), []
    for r in pdf.itertuples(index=False):
        k = list(r.codes).index(code)
        out.append(_planned(r, int(r.base), code, count, int(r.before)))
        code, count = int(r.ends[k]), count + int(r.semis[k])
    return _frame(out, _PLAN)


# ---------------------------------------------------------------------------
# S4 line mode
# ---------------------------------------------------------------------------
#: Runs that leave the quote state as it is: outside quotes, and inside each kind.
_OUTSIDE = re.compile(r"(?:[^\\'\"`]|\\.)*+")
_INSIDE = {q: re.compile(rf"(?:[^\\{q}]|\\.)*+") for q in "'\"`"}


def _open_quote(line: str, quote: str, at: int) -> tuple[str, int]:
    """The quote that is open behind ``line`` ('' for none), and how many characters of the next line are escaped."""
    while True:
        at = (_INSIDE[quote] if quote else _OUTSIDE).match(line, at).end()
        if at >= len(line):
            return quote, 0
        if line[at] == "\\":
            return quote, 1
        quote, at = "" if quote else line[at], at + 1


@dataclass(frozen=True)
class LineState:
    """Where a line splitter stands between two lines: the delimiter in force, and what an open statement left open."""

    delimiter: str = ";"
    inside: bool = False
    quote: str = ""
    skip: int = 0

    def after(self, line: str) -> tuple[LineState, bool, bool]:
        """The state behind ``line``, whether a statement opens with it, and whether one closes."""
        opens = not self.inside
        if opens:
            head = line.strip()
            if not head or head.startswith(("--", "#")):
                return self, False, False
            if (set_to := _new_delimiter(head)) is not None:
                return LineState(set_to), False, False
        quote, skip = _open_quote(line, self.quote, self.skip)
        if not quote and line.rstrip().endswith(self.delimiter):
            return LineState(self.delimiter), opens, True
        return LineState(self.delimiter, True, quote, skip), opens, False

    def packed(self) -> str:
        return json.dumps([self.delimiter, self.inside, self.quote, self.skip])


def _new_delimiter(head: str) -> str | None:
    """What a DELIMITER line sets."""
    command, _, value = head.partition(" ")
    return value.strip() if command.upper() == "DELIMITER" and value else None


def split_lines(lines, delimiter: str = ";", state: LineState | None = None, own: int | None = None):
    """Line-oriented splitter: (first line number, statement) per statement.

    Rules: between statements, blank lines and lines starting with ``--`` or ``#`` are passed over and
    ``DELIMITER xx`` sets the delimiter. Any other line opens a statement, which takes lines until one ends with
    the delimiter (white space aside) outside quotes. A backslash escapes the next character anywhere. The
    delimiter is cut off; what is open at the end of the input is a statement as well.

    From another ``state`` the rest of its open statement is passed over; only statements that open within the first
    ``own`` lines are returned, the last one whole.
    """
    state, taken, first = state or LineState(delimiter), None, 0
    for no, raw in enumerate(lines, 1):
        line = raw.removesuffix("\n")
        if own is not None and no > own and taken is None:
            return
        now, opens, closes = state.after(line)
        if opens:
            taken, first = [], no
        if taken is not None:
            taken.append(line)
            if closes:
                yield first, "\n".join(taken).strip()[: -len(state.delimiter)].strip()
                taken = None
        state = now
    if taken is not None and (rest := "\n".join(taken).strip()):
        yield first, rest


_LINES = [("path", pa.string(), "string"), ("size", pa.int64(), "long"), ("j", pa.int64(), "long"), ("lo", pa.int64(), "long"), ("hi", pa.int64(), "long")]
_LINE_SCAN = [*_LINES, ("lines", pa.int64(), "long"), ("delims", pa.list_(pa.string()), "array<string>"), ("starts", pa.list_(pa.string()), "array<string>"), ("ends", pa.list_(pa.string()), "array<string>"),
              ("opened", pa.list_(pa.int64()), "array<long>"), ("miss", pa.string(), "string"), ("count", pa.int64(), "long"), ("before", pa.int64(), "long")]
_LINE_PLAN = [*_LINES, ("lines", pa.int64(), "long"), ("state", pa.string(), "string"), ("stmt_offset", pa.int64(), "long"), ("before", pa.int64(), "long")]
_LINE_FOLD = [*_LINE_PLAN, ("delims", pa.list_(pa.string()), "array<string>"), ("miss", pa.string(), "string"), ("count", pa.int64(), "long")]
#: Encodings in which a line feed is the byte 10 and no other character has that byte.
_BY_BYTE = re.compile(r"(?i)^(utf[-_]?8|ascii|us-ascii|latin[-_]?1|iso[-_]?8859[-_]\d+|cp125\d|windows-125\d)$")


def _line_cut(path: str, size: int, nominal: int) -> int:
    """The first place behind a line feed at or after ``nominal``."""
    pos = nominal - 1
    if pos < 0:
        return 0
    for blk in _ranges(path, pos, size, NEAR):
        if (k := blk.find(b"\n")) >= 0:
            return pos + k + 1
        pos += len(blk)
    return size


def _text_lines(path: str, lo: int, hi: int, encoding: str, end: int | None = None) -> Iterator[str]:
    """Lines in [lo, hi) of a plain file, without their line feeds, and then those up to ``end``."""
    rest = b""
    for blk in itertools.chain(_ranges(path, lo, hi, BLOCK), _ranges(path, hi, end or hi, NEAR)):
        *lines, rest = (rest + blk).split(b"\n")
        for x in lines:
            yield x.decode(encoding)
    if rest:
        yield rest.decode(encoding)


def _line_states(delims: list[str]) -> list[str]:
    """States that a chunk may start in."""
    out = []
    for d in sorted({";", *delims}):
        out += [LineState(d)] + [LineState(d, True, q, k) for q in ("", "'", '"', "`") for k in (0, 1)]
    return [x.packed() for x in out]


def _line_pass1(chunk_bytes: int, encoding: str):
    """Per chunk: its lines, the state behind it and the statements that open in it, by the state it starts in."""

    def run(batches):
        for b in batches:
            out = {n: [] for n, *_ in _LINE_SCAN}
            for r in b.to_pylist():
                if r["miss"] is None:
                    r["lo"], r["hi"] = (_line_cut(r["path"], r["size"], j * chunk_bytes) for j in (r["j"], r["j"] + 1))
                starts = [LineState().packed()] if r["miss"] is None else [r["miss"]] if r["miss"] else _line_states(r["delims"])
                states, opened, lines, delims = [LineState(*json.loads(x)) for x in starts], [0] * len(starts), 0, set()
                for line in _text_lines(r["path"], r["lo"], r["hi"], encoding):
                    lines += 1
                    if line.lstrip()[:9].upper() == "DELIMITER" and (d := _new_delimiter(line.strip())) is not None:
                        delims.add(d)
                    for i, st in enumerate(states):
                        states[i], opens, _ = st.after(line)
                        opened[i] += opens
                row = r | {"lines": lines, "delims": sorted(delims), "starts": starts, "ends": [x.packed() for x in states], "opened": opened}
                for k, v in out.items():
                    v.append(row.get(k))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, t) for n, t, _ in _LINE_SCAN]))

    return run


def _line_fold(pdf):
    """Chunks of one file in order, from the first state on; where it is another, they wait for the scan from all states."""
    pdf = pdf[pdf["hi"] > pdf["lo"]].sort_values("j")
    delims = sorted({d for x in pdf["delims"] for d in x})
    normal = LineState().packed()
    state, count, before, out, missed = normal, 0, 0, [], False
    for r in pdf.itertuples(index=False):
        row = {n: getattr(r, n) for n, *_ in _LINES} | {"lines": r.lines, "state": state, "stmt_offset": count, "before": before}
        if not missed and state == normal:
            out.append(row)
            state, count = r.ends[0], count + int(r.opened[0])
        else:
            out.append(row | {"delims": delims, "miss": "" if missed else state, "count": count})
            missed = True
        before += int(r.lines)
    return _frame(out, _LINE_FOLD)


def _line_fold_tail(pdf):
    pdf = pdf.sort_values("j")
    state, count, out = pdf["miss"].iloc[0], int(pdf["count"].iloc[0]), []
    for r in pdf.itertuples(index=False):
        k = list(r.starts).index(state)
        out.append({n: getattr(r, n) for n, *_ in _LINES} | {"lines": r.lines, "state": state, "stmt_offset": count, "before": r.before})
        state, count = r.ends[k], count + int(r.opened[k])
    return _frame(out, _LINE_PLAN)


_LINE_ARROW = pa.schema([("file", pa.string()), ("stmt_no", pa.int64()), ("start_line", pa.int64()), ("stmt", pa.string())])


def _line_pass2(encoding: str):
    def run(batches):
        for r in (r for b in batches for r in b.to_pylist()):
            path, out, held = r["path"], [], 0
            if r["state"] is None:  # one task for the whole file
                lines = io.TextIOWrapper(open_stream(path, detect_codec(path)), encoding=encoding, newline="\n")
                found = split_lines(lines)
            else:
                lines = _text_lines(path, r["lo"], r["hi"], encoding, r["size"])
                found = split_lines(lines, state=LineState(*json.loads(r["state"])), own=r["lines"])
            for no, (line, stmt) in enumerate(found, r["stmt_offset"]):
                out.append({"file": path, "stmt_no": no, "start_line": line + r["before"], "stmt": stmt})
                held += len(stmt)
                if held >= FLUSH_BYTES or len(out) >= 2048:
                    yield pa.RecordBatch.from_pylist(out, schema=_LINE_ARROW)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_LINE_ARROW)

    return run


def read_statements_lines(spark: SparkSession, path: str, encoding: str = "utf-8", chunk_bytes: int | None = None) -> DataFrame:
    """DataFrame(file, stmt_no, start_line, stmt).

    Plain files are cut into chunks at line feeds. A chunk's effect on (delimiter, open quote, escape) is found from the
    usual state first, and where a file leaves that state, from all states with a delimiter that the file sets anywhere;
    the chunks of a file compose to the state in which each starts. Compressed files, and encodings in which a line feed
    cannot be told by its byte, are one task per file.
    """
    chunk_bytes = chunk_bytes or DEFAULT_CHUNK
    files = list_dump_files(path)
    split = [(p, s) for p, s in files if s > chunk_bytes and not detect_codec(p) and _BY_BYTE.match(encoding)]
    whole = [(p, s, 0, 0, s, None, None, 0, 0) for p, s in files if (p, s) not in set(split)]
    parts = [spark.createDataFrame(whole, _ddl(_LINE_PLAN)).repartition(_tasks(spark, len(whole), sum(s for _, s, *_ in whole)))] if whole else []
    if split:
        tasks = _tasks(spark, sum(-(-s // chunk_bytes) for _, s in split), sum(s for _, s in split))
        ensure_checkpoint_dir(spark)
        none = lambda t: F.lit(None).cast(t)
        chunks = spark.createDataFrame(split, "path string, size long").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / chunk_bytes) - 1)).alias("j"))
        chunks = chunks.withColumns({"lo": none("long"), "hi": none("long"), "miss": none("string")}).repartition(tasks)
        folded = chunks.mapInArrow(_line_pass1(chunk_bytes, encoding), _ddl(_LINE_SCAN)).groupBy("path").applyInPandas(_line_fold, _ddl(_LINE_FOLD)).checkpoint(eager=True)  # one small row per chunk
        tail = folded.where("miss IS NOT NULL").repartition(tasks).mapInArrow(_line_pass1(chunk_bytes, encoding), _ddl(_LINE_SCAN))
        plan = folded.where("miss IS NULL").select(*[n for n, *_ in _LINE_PLAN]).unionByName(tail.groupBy("path").applyInPandas(_line_fold_tail, _ddl(_LINE_PLAN)))
        parts.append(plan.repartition(tasks))
    if not parts:
        return spark.createDataFrame([], LINE_SCHEMA)
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).mapInArrow(_line_pass2(encoding), LINE_SCHEMA)
