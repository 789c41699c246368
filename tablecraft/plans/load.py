"""S3 -> P7 -> S5 -> A13 -> typed tables: loading a SQL dump.

The statements are split in parallel, filtered, and the INSERTs of each
table decoded in parallel into typed rows. Decoded rows are staged once in
the shared checkpoint folder (so failures do not re-parse and lost executors
recompute from files, not lineage); batch outcomes are computed from the
staged flags and only rows of good batches are kept.

Nothing is lost silently: every statement that should give rows and does not
(unreadable, of an unknown kind or table, a value that does not convert) is
a reject row, and by default (``on_error='fail'``) the load raises on the
first failed batch with its statement. ``on_error='skip'`` leaves out failed
batches and reports them in ``rejects`` and ``outcomes``.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import norm_dialect
from ..operators.statements import STATEMENTS_PER_BATCH, batch_outcomes, filter_statements, good_rows
from ..operators.upsert import last_writes
from ..session import staging_path
from ..sources import fs
from ..sources.inserts import DEFAULT, DOT, JOINT, RAW_DDL, constant, decode_raw, typed
from ..sources.statements import DEFAULT_CHUNK, MAX_STATEMENT, PACKED, detect_codec, list_dump_files, read_ranges, read_statements
from ..tableset import TableSet
from .progress import Event
from .scope import Position, Scopes, Source, Target, resolve, with_namespace


#: Text of a dump that is worth a task of its own.
SHARE_BYTES = 256 << 10
#: Tables that a task writes side by side; rows of more are sorted by table first.
WRITERS = 8


@dataclass
class LoadResult:
    """Loaded tables; outcomes per batch; rejects (table, file, batch_id, stmt_no, error, stmt); the statements."""

    tables: TableSet
    outcomes: DataFrame
    rejects: DataFrame
    statements: DataFrame
    seconds: float = 0.0

    def totals(self) -> DataFrame:
        """One row: statements, bytes of statement text, batches, failed batches, rejected statements."""
        text = self.statements.agg(F.count(F.lit(1)).alias("statements"), F.coalesce(F.sum(F.octet_length("stmt")), F.lit(0)).alias("bytes"))
        batches = self.outcomes.agg(F.count(F.lit(1)).alias("batches"), F.count_if("failed").alias("failed_batches"))
        errors = self.rejects.agg(F.count(F.lit(1)).alias("errors"))
        on = F.lit(1).alias("_one")
        out = text.select("*", on).join(batches.select("*", on), "_one").join(errors.select("*", on), "_one").drop("_one")
        return out.withColumn("seconds", F.lit(self.seconds))


def dump_schemas(path: str) -> dict[str, T.StructType]:
    """Schemas from the ``_schema.json`` files of a dump written by ``write_dump``."""
    out = {}
    fsys, root = fs.resolve(fs.qualify(path))
    import pyarrow.fs as pafs

    if fsys.get_file_info(root).type != pafs.FileType.Directory:
        return out
    for fi in fsys.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if fi.base_name == "_schema.json":
            with fsys.open_input_stream(fi.path) as f:
                doc = json.loads(f.read())
            out[doc["table"]] = T.StructType.fromJson(doc["schema"])
    return out


def _forms(raw: DataFrame) -> list:
    """One row per table and form of its statements, and per text of a scope statement, with the last position of each."""
    use = F.col("_use") if "_use" in raw.columns else F.lit(None).cast("string")
    text = F.when(F.col("_kind") != "use", F.col("_stmt"))
    keys = [F.col(f"_{c}").alias(c) for c in ("table", "kind", "mode", "cols", "width")]
    keys += [use.alias("use"), text.alias("stmt")]
    # by file first: the last number is a hash aggregate, while the last (file, number) would sort all rows
    files = raw.groupBy(*keys, "_file").agg(F.max("_stmt_no").alias("_stmt_no"), F.count(F.lit(1)).alias("rows"))
    names = ["table", "kind", "mode", "cols", "width", "use", "stmt"]
    return files.groupBy(*names).agg(F.max(F.struct("_file", "_stmt_no")).alias("at"), F.sum("rows").alias("rows")).collect()


def _targets(shapes: list, scopes: Scopes, schemas: dict | None, tables) -> tuple[list[Target], list[tuple[str, str | None, Position | None]]]:
    """The tables of a dump, and what has no schema: (written name, namespace, position after which its rows count)."""
    defs = scopes.definitions
    out: dict = {}
    if schemas:
        for name, schema in schemas.items():
            ns, _, plain = name.rpartition(".")
            out[name] = Target(name, schema, defs.get((ns or None, plain)) or (defs.get(scopes.find(None, name)) if not ns else None))
    else:
        several = len({ns for ns, _ in defs} - {None}) > 1 or len({name for _, name in defs}) < len(defs)
        names = {k: f"{k[0]}.{k[1]}" if several and k[0] is not None else k[1] for k in defs}
        out = {k: Target(names[k], d.schema, d) for k, d in defs.items()}
    unknown = []
    for table, use in sorted({(r["table"], r["use"]) for r in shapes}, key=str):
        ns, _, name = table.rpartition(DOT)
        ns = ns or use
        if schemas:
            key = f"{ns}.{name}" if f"{ns}.{name}" in out else name
        else:
            key = scopes.find(ns, name)
        after = max((p for p in (scopes.after((ns, name)), scopes.after(key) if isinstance(key, tuple) else None) if p is not None), default=None)
        if key in out:
            out[key].sources.append(Source(table, use, after))
        else:
            unknown.append((table, use, after))
    found = list(out.values())
    if tables:
        by_name = {n: [t for t in found if n in (t.name, t.name.rpartition(".")[2])] for n in tables}
        if missing := [n for n, ts in by_name.items() if not ts]:
            raise KeyError(f"no schema for tables {missing}")
        found, unknown = [t for n in tables for t in by_name[n]], []
    return found, unknown


def _converted(raw: DataFrame, target: Target, shapes: list, dialect: str) -> DataFrame:
    """Typed columns of a target, and _file, _stmt_no, _row_no, _mode, _sets, _bad, _error.

    A column that a statement leaves out, or gives as DEFAULT, has the default of the table's definition. Without a
    definition it is null where it is left out.
    """
    fields, d = target.schema.fields, target.definition
    names = {f.name.lower(): i for i, f in enumerate(fields)}
    own = [s for s in shapes if s["table"] in {x.table for x in target.sources}]
    layouts = sorted({(s["cols"], s["width"]) for s in own}, key=str)
    asked, marked = (any(x in (s["mode"] or "")[1:] for s in own) for x in "dm")

    def default(name: str) -> tuple[Column, str | None]:
        """The raw default of a column, and why there is none."""
        if d is None or name not in d.schema.fieldNames():
            return F.lit(None).cast("string"), None
        if name in d.filled or (name in d.defaults and not constant(d.defaults[name], dialect)[0]):
            return F.lit(None).cast("string"), f"column {name} is filled by the server"
        if name in d.required:
            return F.lit(None).cast("string"), f"column {name} has no default"
        return F.lit(constant(d.defaults[name], dialect)[1] if name in d.defaults else None).cast("string"), None

    def layout(cols: str | None, width: int | None):
        """(raw value per field, error per field or None, error of the layout)."""
        given = [f.name for f in fields] if cols is None else cols.split(JOINT)
        error = f"row has {width} values, expected {len(fields)}" if cols is None and width != len(fields) else None
        exact = {f.name: i for i, f in enumerate(fields)}
        at = {exact[c] if c in exact else names.get(c.lower(), c): i for i, c in enumerate(given)}
        error = error or next((f"unknown column {c}" for c in at if isinstance(c, str)), None)
        raws, errors = [], []
        for i, f in enumerate(fields):
            text, why = default(f.name)
            if i not in at or error:
                raws.append(text)
                errors.append(F.lit(why))
            else:
                value = F.col("_vals")[at[i]]
                raws.append(F.when(value == DEFAULT, text).otherwise(value) if asked else value)
                no = why or (f"column {f.name} has no known default" if d is None else None)
                errors.append(F.when(value == DEFAULT, F.lit(no)) if asked and no else None)
        return raws, errors, error

    made = {k: layout(*k) for k in layouts}
    rows = target.rows(raw).where("_kind IS NULL AND _error IS NULL")

    def pick(part) -> Column | None:
        """One of the layouts' expressions, by the layout of the row."""
        exprs = {k: part(made[k]) for k in layouts}
        if len(layouts) == 1:
            return next(iter(exprs.values()))
        if all(e is None for e in exprs.values()):
            return None
        out = F.lit(None).cast("string")
        for (cols, width), e in exprs.items():
            if e is not None:
                out = F.when(F.col("_cols").eqNullSafe(F.lit(cols)) & F.col("_width").eqNullSafe(F.lit(width)), e).otherwise(out)
        return out

    raws = [pick(lambda m, i=i: m[0][i]) if layouts else F.lit(None).cast("string") for i in range(len(fields))]
    errors = [F.col("_error")]
    errors += [F.lit(m[2]) if len(layouts) == 1 else F.when(F.col("_cols").eqNullSafe(F.lit(k[0])) & F.col("_width").eqNullSafe(F.lit(k[1])), F.lit(m[2])) for k, m in made.items() if m[2]]
    errors += [e for i in range(len(fields)) if layouts and (e := pick(lambda m, i=i: m[1][i])) is not None]
    # a value that is there and does not convert
    pairs = rows.select("_file", "_stmt_no", "_row_no", F.substring("_mode", 1, 1).alias("_mode"), "_sets", F.coalesce(*errors).alias("_error"),
                        *[F.struct(r.isNotNull().alias("given"), typed(r, f.dataType, dialect, marked or asked or d is not None and bool(d.defaults)).alias("v")).alias(f"v{i}") for i, (r, f) in enumerate(zip(raws, fields))])
    lost = reduce(lambda a, b: a | b, [F.col(f"v{i}.given") & F.col(f"v{i}.v").isNull() for i in range(len(fields))], F.lit(False))
    error = F.coalesce("_error", F.when(lost, F.lit("value does not convert to the column type")))
    return pairs.select("_file", "_stmt_no", "_row_no", "_mode", "_sets", error.isNotNull().alias("_bad"), error.alias("_error"), *[F.col(f"v{i}.v").alias(f.name) for i, f in enumerate(fields)])


def _upserted(rows: DataFrame, target: Target, modes: set[str], on_error: str) -> DataFrame:
    """Rows of a table as the writes of a dump leave them, by the primary key of its definition."""
    names = [f.name for f in target.schema.fields]
    by_low = {n.lower(): n for n in names}
    keys = [by_low[k.lower()] for k in target.definition.primary_key if k.lower() in by_low] if target.definition else []
    if not keys or not modes & set("rgux"):
        return rows.select(*names)
    split = F.split(F.lower("_sets"), JOINT)
    at = F.array_position(split, "")  # what stands behind an empty name is the conflict target
    sets = F.coalesce(F.when(at > 0, F.slice(split, F.lit(1), (at - 1).cast("int"))).otherwise(split), F.array().cast("array<string>"))
    out = last_writes(rows, keys, names, F.struct("_file", "_stmt_no", "_row_no"), "_mode", sets)
    if modes & {"i", "x"} and on_error == "fail":
        out = stage_rows(out, "upsert")
        wrong = out.where("first_error IS NOT NULL").select("first_error").orderBy("first_error").limit(1).take(1)
        if wrong:
            e = wrong[0][0]
            raise ValueError(f"statement {e['_stmt_no']} of {e['_file']} writes a key of table {target.name} that is there already, and does not say what becomes of it")
    return out.select(*names)


def stage_rows(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_table(raw: DataFrame, ddl: str) -> DataFrame:
    """Decoded rows, written to a folder for each table and read again."""
    p = staging_path(raw.sparkSession, "load")
    spark, key = raw.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, WRITERS)  # the rows of a task are mostly of one table and need no sort
    try:
        raw.write.partitionBy("_table").parquet(p)
    finally:
        spark.conf.set(key, before)
    return raw.sparkSession.read.schema(ddl).parquet(p)  # a table may be named 01: its name stays a string


def load_dump(spark: SparkSession, path: str, dialect: str = "mysql", tables=None, schemas: dict | None = None,
              rename: dict | None = None, batch: int = STATEMENTS_PER_BATCH, on_error: str = "fail",
              chunk_bytes: int | None = None, max_stmt_bytes: int = MAX_STATEMENT, start_byte: int | dict = 0,
              stage: bool = True, encoding: str = "utf-8", progress=None, only: Column | None = None, drops: bool = True, ranges: list | None = None) -> LoadResult:
    """Load a dump directory (or file) into typed DataFrames.

    ``schemas``: {table: StructType}; defaults to the dump's own schema files, and without such to its CREATE TABLE
    statements. A plain name stands for the table in every namespace, ``ns.name`` for that of one. From CREATE TABLE
    statements, tables of several namespaces are named ``ns.name`` and kept apart. ``tables`` restricts the load to
    some; INSERTs of all others are then passed over, else an INSERT of a table without a schema is a reject.
    ``rename``: {old: new} names. ``only`` restricts the load to some statements (a condition on file, stmt_no and the
    like), ``ranges`` to those in byte ranges of plain files (see ``read_ranges``), and no more of them is read. ``drops=False`` keeps the rows before a DROP, TRUNCATE or DELETE as well. ``progress`` gets an ``Event`` per table (H3): its rows as they were read from the dump.

    The result holds what the dump leaves in the tables: rows before a DROP, TRUNCATE or unconditional DELETE of their
    table are gone, columns that a statement leaves out have the defaults of the definition, and where a table with a
    primary key is written by REPLACE, IGNORE or conflict clauses, each key has its last write.
    """
    if on_error not in ("skip", "fail"):
        raise ValueError("on_error is 'skip' or 'fail'")
    began = time.time()
    d = norm_dialect(dialect)
    if ranges is None:
        stmts = read_statements(spark, path, dialect, chunk_bytes=chunk_bytes, max_stmt_bytes=max_stmt_bytes, start_byte=start_byte, encoding=encoding)
    else:
        stmts = read_ranges(spark, ranges, dialect, max_stmt_bytes, encoding)
    stmts = filter_statements(stmts if only is None else stmts.where(only), rename=bool(rename))
    files = list_dump_files(path) if ranges is None else [(p, hi - lo) for p, lo, hi, _ in ranges]
    tasks = sum(1 if detect_codec(f) else -(-size // (chunk_bytes or DEFAULT_CHUNK)) for f, size in files)
    shares = min(2 * spark.sparkContext.defaultParallelism, sum(size * (PACKED if detect_codec(f) else 1) for f, size in files) // SHARE_BYTES)
    if tasks < shares:  # a few files or chunks: their statements are shared out before they are read value by value
        stmts = stmts.repartition(shares)
    # one pass over the statements for every table, staged once (partitioned by table)
    raw = decode_raw(stmts, d, [t.rpartition(".")[2] for t in tables] if tables else None)
    if stage:
        raw = _by_table(raw, RAW_DDL)
    else:
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    forms = _forms(raw)
    if any(r["kind"] == "use" for r in forms):
        raw = with_namespace(raw)
        if stage:  # every table, the check and the rejects read it
            raw = _by_table(raw, f"{RAW_DDL}, _use string")
        forms = _forms(raw)
    shapes = [r for r in forms if r["table"] is not None and r["mode"] is not None]
    scopes = resolve([r for r in forms if r["kind"] not in (None, "use")], d)
    if not drops:
        scopes.cleared.clear()
        scopes.dropped.clear()
    schemas = schemas or (dump_schemas(path) if isinstance(path, str) else {})
    if schemas and tables:
        if missing := [t for t in tables if t not in schemas]:
            raise KeyError(f"no schema for tables {missing}")
        schemas = {t: schemas[t] for t in tables}
    targets, unknown = _targets(shapes, scopes, schemas, tables)
    decoded = {t.name: _converted(raw, t, shapes, d) for t in targets}

    # statements that should give rows and do not: unreadable ones, and those of tables without a schema
    failed = raw.where("_error IS NOT NULL").select(F.element_at(F.split("_table", DOT), -1).alias("table"), "_file", "_stmt_no", F.lit(True).alias("_bad"), "_error")
    for table, use, after in unknown:
        name = table.rpartition(DOT)[2]
        rows = Target(name, None, None, [Source(table, use, after)]).rows(raw).where("_kind IS NULL AND _error IS NULL")
        failed = failed.unionByName(rows.select(F.lit(None).cast("string").alias("table"), "_file", "_stmt_no", F.lit(True).alias("_bad"), F.lit(f"no schema for table {name}").alias("_error")))
    checked = failed
    for name, df in decoded.items():
        checked = checked.unionByName(df.select(F.lit(name).alias("table"), "_file", "_stmt_no", "_bad", "_error"))
    flags = checked.groupBy("table", "_file", "_stmt_no").agg(F.bool_or("_bad").alias("bad"), F.min("_error").alias("error"))
    outcomes = batch_outcomes(flags, seq="_stmt_no", bad="bad", size=batch, by=("_file",), error="error")
    if on_error == "fail":
        first = checked.where("_bad").orderBy("_file", "_stmt_no").limit(1).take(1)
        if first:
            r = first[0]
            text = stmts.where((F.col("file") == r["_file"]) & (F.col("stmt_no") == r["_stmt_no"])).select("stmt").take(1)
            raise ValueError(f"batch {r['_stmt_no'] // batch} of {r['_file']} failed at statement {r['_stmt_no']}: {r['_error']}: {text[0].stmt[:200] if text else ''}")
    out = {}
    for done, t in enumerate(targets, 1):
        if progress:
            read = sum(r["rows"] for r in shapes if any(r["table"] == x.table and r["use"] == x.use for x in t.sources))
            progress(Event("load", "table", t.name, None, done, len(targets), read))
        good = decoded[t.name]
        if on_error == "skip":  # otherwise no batch has failed
            good = good_rows(good.where(~F.col("_bad")), outcomes, seq="_stmt_no", size=batch, by=("_file",))
        modes = {s["mode"][:1] for s in shapes if s["table"] in {x.table for x in t.sources}}
        out[(rename or {}).get(t.name, t.name)] = _upserted(good, t, modes, on_error)
    bad = flags.where("bad").select("table", F.col("_file").alias("file"), F.floor(F.col("_stmt_no") / batch).cast("long").alias("batch_id"), F.col("_stmt_no").alias("stmt_no"), "error")
    # by merge: the text of a dump has no size until it is read, and must not be taken for small and sent to the driver
    rejects = bad.join(stmts.select("file", "stmt_no", "stmt").hint("merge"), ["file", "stmt_no"], "left").select("table", "file", "batch_id", "stmt_no", "error", "stmt")
    return LoadResult(TableSet(out), outcomes, rejects, stmts, time.time() - began)
