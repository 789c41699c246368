"""Loads that can be stopped and started again, with a ledger of what was applied.

Files are loaded in steps: as many whole files as have ``step_bytes`` together, or, of a file that is larger, ranges of
``step_batches`` batches. A step writes its rows into a folder of its own (overwriting what a stopped run left there)
and then its ledger entry. Steps with an entry are never done again and only their folders are read, so every row is
there once, whatever was stopped; compressed files as well, as batches are counted in statements, not bytes.

Where the ranges of a file begin is found once and noted beside the ledger's entries, so that a range of a plain file
reads its own bytes only; of a compressed one it reads the whole file.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.statements import STATEMENTS_PER_BATCH
from ..sources import fs
from ..sources.statements import detect_codec, list_dump_files, read_statements
from .load import load_dump

STEP_BYTES, STEP_BATCHES = 8 << 30, 10_000
LEDGER = "step string, files array<string>, sizes array<long>, first_batch long, last_batch long, ended boolean"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """One row per applied step; a range of a file has its first and last batch, and whether the file ended with it."""
    entries = [p for p, _ in fs.list_files(ledger)] if fs.exists(ledger) else []
    return spark.read.schema(LEDGER).json(entries) if entries else spark.createDataFrame([], LEDGER)


def _entries(ledger: str) -> list[dict]:
    return [json.loads(fs.read_bytes(p)) for p, _ in fs.list_files(ledger)] if fs.exists(ledger) else []


def _begins(spark: SparkSession, ledger: str, path: str, size: int, dialect: str, each: int) -> tuple[int, list[int]]:
    """The number of statements of a file, and the byte at which every ``each``-th of them begins."""
    asked = [path, size, fs.modified(path), dialect, each]
    note = f"{ledger}/.ranges-{hashlib.sha256(json.dumps(asked).encode()).hexdigest()[:20]}.json"  # no entry: its name is passed over
    if fs.exists(note):
        try:
            held = json.loads(fs.read_bytes(note))
            return held["statements"], held["begins"]
        except (ValueError, KeyError, TypeError):
            pass  # a run stopped while it wrote the note
    marks = read_statements(spark, [path], dialect).groupBy(F.floor(F.col("stmt_no") / each).alias("k")).agg(F.min(F.struct("stmt_no", "byte_start")).alias("first"), F.max("stmt_no").alias("last"))
    found = sorted((r["k"], r["first"]["byte_start"], r["last"]) for r in marks.collect())
    statements, begins = (found[-1][2] + 1 if found else 0), [at for _, at, _ in found]
    fs.write_bytes(note, json.dumps({"statements": statements, "begins": begins}).encode())
    return statements, begins


def _steps(files: list[tuple[str, int]], step_bytes: int) -> list[list[tuple[str, int]]]:
    out: list[list[tuple[str, int]]] = []
    held = 0
    for f in files:
        if out and held + f[1] <= step_bytes:
            out[-1].append(f)
            held += f[1]
        else:
            out.append([f])
            held = f[1]
    return out


def load_journaled(spark: SparkSession, path, schemas: dict[str, T.StructType], out: str, ledger: str, dialect: str = "mysql", on_error: str = "fail",
                   batch: int = STATEMENTS_PER_BATCH, step_bytes: int = STEP_BYTES, step_batches: int = STEP_BATCHES, most_steps: int | None = None) -> bool:
    """Apply what the ledger does not have yet, at most ``most_steps`` steps; True when everything is applied.

    Tables are those of ``schemas``; they hold the rows of all INSERTs (repeated keys and dropped tables are the matter
    of ``load_dump``). A file whose size is another than in the ledger is an error.
    """
    out, ledger = out.rstrip("/"), ledger.rstrip("/")
    applied = _entries(ledger)
    sizes = {f: s for e in applied for f, s in zip(e["files"], e["sizes"])}
    files = list_dump_files(path)
    if changed := [f for f, s in files if sizes.get(f, s) != s]:
        raise ValueError(f"files changed since they were loaded: {changed}")
    ended = {f for e in applied if e["first_batch"] is None for f in e["files"]}
    ranges: dict[str, dict[int, dict]] = {}
    for e in applied:
        if e["first_batch"] is not None:
            ranges.setdefault(e["files"][0], {})[e["first_batch"]] = e
    for f, held in ranges.items():  # a file is done when its ranges follow one another to its end, whichever entries there are
        at = 0
        while at in held and not held[at]["ended"]:
            at = held[at]["last_batch"] + 1
        if at in held:
            ended.add(f)
    done = 0

    def apply(step: list[tuple[str, int]], first: int | None, last: int | None, whole: bool, ranges: list | None = None) -> None:
        only = None if first is None else (F.col("stmt_no") >= first * batch) & (F.col("stmt_no") < (last + 1) * batch)
        name = hashlib.sha256(json.dumps([step, first]).encode()).hexdigest()[:20]
        res = load_dump(spark, [f for f, _ in step], dialect, tables=list(schemas), schemas=schemas, batch=batch, on_error=on_error, only=only, drops=False, ranges=ranges)
        for table, df in res.tables.items():
            df.write.mode("overwrite").parquet(f"{out}/{table}/step={name}")
        entry = {"step": name, "files": [f for f, _ in step], "sizes": [s for _, s in step], "first_batch": first, "last_batch": last, "ended": whole}
        fs.write_bytes(f"{ledger}/{name}.json", json.dumps(entry).encode())

    for step in _steps([f for f in files if f[0] not in ended], step_bytes):
        path_, size = step[0]
        if len(step) > 1 or (size <= step_bytes and path_ not in ranges):
            if done == most_steps:
                return False
            apply(step, None, None, True)
            done += 1
            continue
        statements, begins = _begins(spark, ledger, path_, size, dialect, batch * step_batches)
        batches, plain = -(-statements // batch), not detect_codec(path_)
        held, first = ranges.get(path_, {}), 0
        while first < max(batches, 1):
            if first in held:
                first = held[first]["last_batch"] + 1
                continue
            if done == most_steps:
                return False
            last = min([first + step_batches, max(batches, 1), *[k for k in held if k > first]]) - 1
            k, behind = first // step_batches, -(-(last + 1) // step_batches)  # a range between others may begin between two marks
            own = [(path_, begins[k], begins[behind] if behind < len(begins) else size, k * step_batches * batch)] if plain and begins else None
            apply(step, first, last, last + 1 >= batches, own)
            first, done = last + 1, done + 1
    return True


def read_journaled(spark: SparkSession, table: str, schema: T.StructType, out: str, ledger: str) -> DataFrame:
    """The rows of a table that applied steps have written."""
    paths = [p for e in _entries(ledger.rstrip("/")) if fs.exists(p := f"{out.rstrip('/')}/{table}/step={e['step']}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
