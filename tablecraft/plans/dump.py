"""K1 / K3 / K5 / K8: table sets -> SQL dump directories.

Layout of a dump (one directory; files sort in load order)::

    000000_header.sql
    000001_<table>/00_schema.sql     DROP + CREATE (driver-written, tiny)
    000001_<table>/_schema.json      Spark schema, for typed reloading
    000001_<table>/data/part-*       INSERT statements, written by Spark tasks
    ...
    999999_footer.sql

Each INSERT carries up to ``batch`` rows. By default batches are cut inside
each partition (no shuffle at all: the rendered tuples of consecutive rows
are joined with Arrow string kernels). With ``order_by`` the rows are
numbered in key order (W3) and batches are global, like a sequential dump.
"""

from __future__ import annotations

import itertools
import json
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.dialect import create_table_sql, drop_table_sql, insert_prefix, norm_dialect, quote_ident, row_tuple
from ..operators.sequence import with_sequence
from ..sources import fs
from ..tableset import TableSet
from .progress import Event
from .textsink import write_text

ROWS_PER_INSERT = 1000  # fixed value: default rows per INSERT statement


# ---------------------------------------------------------------------------
# K3
# ---------------------------------------------------------------------------

MAX_STATEMENT_TEXT = 16 << 20  # bytes of tuple text per INSERT, well under the loader's 64 MB statement limit


def _cuts(lengths: np.ndarray, batch: int, max_bytes: int) -> list[int]:
    """Statement end offsets: at most ``batch`` rows and, past one row, at most ``max_bytes`` of tuple text."""
    csum = np.concatenate([[0], np.cumsum(lengths + 2)])  # each tuple plus its ",\n"
    cuts, start, n = [], 0, len(lengths)
    while start < n:
        end = min(start + batch, n)
        if csum[end] - csum[start] > max_bytes:
            end = max(start + 1, int(np.searchsorted(csum, csum[start] + max_bytes, side="right")) - 1)
        cuts.append(end)
        start = end
    return cuts


def _join_batches(prefix: str, batch: int, max_bytes: int = MAX_STATEMENT_TEXT):
    suffix = ";\n"
    large = pa.large_string()

    def emit(arr: pa.Array, ends: list[int]):
        offs = np.array([0] + ends, dtype=np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offs, pa.int64()), arr.slice(0, ends[-1]))
        body = pc.binary_join(lists, pa.scalar(",\n", large))
        stmt = pc.binary_join_element_wise(pa.scalar(prefix, large), body, pa.scalar(suffix, large), pa.scalar("", large))
        rows = pa.array(np.diff(offs).astype(np.int32))
        return pa.RecordBatch.from_arrays([rows, stmt.cast(pa.string())], names=["rows", "stmt"])

    def run(batches):
        carry = None
        for b in batches:
            arr = b.column(0).cast(large)
            if carry is not None and len(carry):
                arr = pa.concat_arrays([carry, arr])
            ends = _cuts(pc.binary_length(arr).to_numpy(zero_copy_only=False), batch, max_bytes)
            # the last statement stays open (carried into the next Arrow batch) unless it is full
            last_start = ends[-2] if len(ends) > 1 else 0
            if ends and ends[-1] == len(arr) and ends[-1] - last_start < batch:
                ends = ends[:-1]
            if ends:
                yield emit(arr, ends)
            carry = arr.slice(ends[-1] if ends else 0)
        if carry is not None and len(carry):
            yield emit(carry, _cuts(pc.binary_length(carry).to_numpy(zero_copy_only=False), batch, max_bytes))

    return run


def render_inserts(df: DataFrame, table: str, dialect: str = "mysql", batch: int = ROWS_PER_INSERT,
                   max_bytes: int = MAX_STATEMENT_TEXT) -> DataFrame:
    """K3, partition-local: DataFrame(rows, stmt); no shuffle, no Python per row.

    A statement holds at most ``batch`` rows and, once it has more than one
    row, at most ``max_bytes`` of tuple text, so wide rows never produce a
    statement the loader would refuse.
    """
    prefix = insert_prefix(table, df.columns, dialect)
    tuples = df.select(row_tuple(df.schema, dialect).alias("t"))
    return tuples.mapInArrow(_join_batches(prefix, batch, max_bytes), "rows int, stmt string")


def render_inserts_ordered(df: DataFrame, table: str, order_by: str, dialect: str = "mysql", batch: int = ROWS_PER_INSERT,
                           max_bytes: int = MAX_STATEMENT_TEXT) -> DataFrame:
    """K3, global batches in key order: DataFrame(batch_id, part, rows, stmt).

    Batches hold at most ``batch`` rows each, whatever the key distribution. A batch of wide rows is cut into
    parts, each begun after at most ``max_bytes`` of tuple text.
    """
    prefix = insert_prefix(table, df.columns, dialect)
    t = df.select(F.col(order_by).alias("_k"), row_tuple(df.schema, dialect).alias("_t"))
    seq = with_sequence(t, "_k", out="_seq").withColumn("batch_id", F.floor(F.col("_seq") / batch))
    before = Window.partitionBy("batch_id").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    seq = seq.withColumn("part", F.floor(F.coalesce(F.sum(F.octet_length("_t") + 2).over(before), F.lit(0)) / max_bytes).cast("int"))
    g = seq.groupBy("batch_id", "part").agg(
        F.count(F.lit(1)).cast("int").alias("rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "_t"))), lambda x: x["_t"]), ",\n").alias("body"),
    )
    return g.select("batch_id", "part", "rows", F.concat(F.lit(prefix), F.col("body"), F.lit(";\n")).alias("stmt"))


# ---------------------------------------------------------------------------
# K1 / K5 / K8
# ---------------------------------------------------------------------------

@dataclass
class TableDump:
    table: str
    rows: int = 0
    statements: int = 0
    bytes: int = 0
    files: list = field(default_factory=list)


@dataclass
class JobStats:
    tables: list = field(default_factory=list)
    seconds: float = 0.0

    @property
    def rows(self) -> int:
        return sum(t.rows for t in self.tables)

    @property
    def bytes(self) -> int:
        return sum(t.bytes for t in self.tables)

    @property
    def rows_per_second(self) -> float:
        return self.rows / self.seconds if self.seconds else 0.0

    def to_rows(self) -> list[tuple]:
        return [(t.table, t.rows, t.statements, t.bytes) for t in self.tables]


def _header(dialect: str) -> str:
    d = norm_dialect(dialect)
    lines = ["-- SQL dump written by tablecraft", f"-- dialect: {d}", ""]
    if d == "mysql":
        lines += ["SET NAMES utf8mb4;", "SET FOREIGN_KEY_CHECKS=0;", ""]
    else:
        lines += ["SET client_encoding = 'UTF8';", ""]
    return "\n".join(lines) + "\n"


def _footer(dialect: str) -> str:
    if norm_dialect(dialect) == "mysql":
        return "SET FOREIGN_KEY_CHECKS=1;\n\n-- end of dump\n"
    return "-- end of dump\n"


def table_dir(root: str, i: int, table: str) -> str:
    return f"{root.rstrip('/')}/{i:06d}_{table}"


def write_dump(ts: TableSet, path: str, dialect: str = "mysql", tables=None, data: bool = True, create: bool = True,
               drop: bool = True, codec: str | None = None, batch: int = ROWS_PER_INSERT, order_by: dict | None = None,
               parts: int | None = None, parallel: int = 4, primary_keys: dict | None = None, progress=None) -> JobStats:
    """K1: dump every (or the listed) table; returns job accounting (K8).

    ``codec``: None, gzip, zstd or xz. ``parts``: output files per table
    (coalesce without shuffle); default keeps the input partitioning.
    ``order_by``: {table: key} for key-ordered global batches. ``progress`` gets an ``Event`` per table (H3).
    """
    t0 = time.time()
    done = itertools.count(1)
    sel = ts.select(tables)
    root = path.rstrip("/")
    fs.write_bytes(f"{root}/000000_header.sql", _header(dialect).encode())
    order_by = order_by or {}
    primary_keys = primary_keys or {}

    def one(i_name):
        i, name = i_name
        df = sel[name]
        d = table_dir(root, i, name)
        info = TableDump(name)
        head = f"-- Table structure for table {quote_ident(name, dialect)}\n\n"
        if create:
            if drop:
                head += drop_table_sql(name, dialect) + "\n"
            head += create_table_sql(df.schema, name, dialect, primary_keys.get(name)) + "\n\n"
        fs.write_bytes(f"{d}/00_schema.sql", head.encode())
        fs.write_bytes(f"{d}/_schema.json", json.dumps({"table": name, "schema": json.loads(df.schema.json())}).encode())
        if data:
            if name in order_by:
                # key-ordered dump: files hold contiguous batch ranges, each file in order
                stm = render_inserts_ordered(df, name, order_by[name], dialect, batch)
                n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                stm = stm.repartitionByRange(n, "batch_id", "part").sortWithinPartitions("batch_id", "part").select("rows", "stmt")
            else:
                stm = render_inserts(df, name, dialect, batch)
                if parts:
                    stm = stm.coalesce(parts)
            obs = Observation(f"dump_{name}_{i}")
            stm = stm.observe(obs, F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("statements"))
            write_text(stm.select("stmt"), f"{d}/data", codec)
            m = obs.get
            info.rows, info.statements = int(m["rows"]), int(m["statements"])
        files = fs.list_files(d)
        info.files = [p for p, _ in files]
        info.bytes = sum(s for _, s in files)
        if progress:
            progress(Event("dump", "table", name, None, next(done), len(sel), info.rows, info.bytes))
        return info

    items = list(enumerate(sel.names(), start=1))
    # Python data source lookups need the session active on the calling
    # thread, so zstd / xz dumps submit their table jobs from this thread.
    if parallel > 1 and len(items) > 1 and codec not in ("zstd", "zst", "xz"):
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            infos = list(pool.map(one, items))
    else:
        infos = [one(x) for x in items]
    fs.write_bytes(f"{root}/999999_footer.sql", _footer(dialect).encode())
    return JobStats(tables=infos, seconds=time.time() - t0)
