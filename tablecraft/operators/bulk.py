"""Bulk table operations across table sets: copy (P2), clone (U3), merge (U4),
append (U2), schema diff (J4), name set logic (J5/U5) and key-based row sync (J6).

All of them build lazy plans; nothing is scanned until a write or action.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staging_path
from ..sources import fs
from ..tableset import TableSet, save_table

# ---------------------------------------------------------------------------
# P2 / P10 / U2 / U3
# ---------------------------------------------------------------------------

def copy_table(src: DataFrame, where: str | Column | None = None, data: bool = True) -> DataFrame:
    """Filtered copy. ``where`` is raw SQL text (or a Column); Catalyst pushes it
    into the parquet scan. ``data=False`` keeps only the structure (P10)."""
    out = src
    if where is not None and (not isinstance(where, str) or where.strip()):
        out = out.where(F.expr(where) if isinstance(where, str) else where)
    if not data:
        out = out.limit(0)
    return out


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """``INSERT INTO a SELECT * FROM b`` - positional, keeps a's names; a
    column-count mismatch is an analysis error, as on a server."""
    return a.union(b)


def write_tables(tables: dict[str, DataFrame], root: str, if_exists: str = "error") -> TableSet:
    """Write tables under ``root`` and read them back.

    With ``error`` nothing is written when any target exists, and what was
    written is removed when a later table fails. With ``replace`` every table
    is first written to the shared staging folder and only then over its
    target, so a target may be among the tables that are read.
    """
    if if_exists not in ("error", "replace"):
        raise ValueError("if_exists is 'error' or 'replace'")
    root = root.rstrip("/")
    paths = {name: f"{root}/{name}.parquet" for name in tables}
    if if_exists == "error" and (there := [n for n, p in paths.items() if fs.exists(p)]):
        raise FileExistsError(f"tables exist in {root}: {there}")
    out, staged = OrderedDict(), OrderedDict()
    if if_exists == "replace":
        for name, df in tables.items():
            held = staging_path(df.sparkSession, f"swap-{name}")
            df.write.parquet(held)
            staged[name] = df.sparkSession.read.schema(df.schema).parquet(held)
    try:
        for name, df in (staged or tables).items():
            save_table(df, paths[name], mode="overwrite" if staged else "errorifexists")
            out[name] = df.sparkSession.read.schema(df.schema).parquet(paths[name])
    except BaseException:
        if if_exists == "error":
            for p in paths.values():
                fs.delete_dir(p)
        raise
    return TableSet(out, name=root.rsplit("/", 1)[-1])


def clone(ts: TableSet, target_root: str, data: bool = True, if_exists: str = "error", tables: Iterable[str] | None = None) -> TableSet:
    """Copy every table of ``ts`` (list order) under ``target_root``; see ``write_tables``."""
    return write_tables({n: copy_table(df, data=data) for n, df in ts.select(tables).items()}, target_root, if_exists)


def copy_into(src: DataFrame, target_root: str, name: str, where: str | Column | None = None, data: bool = True, if_exists: str = "error") -> DataFrame:
    """P2 into a table of its own name under ``target_root``."""
    return write_tables({name: copy_table(src, where, data)}, target_root, if_exists)[name]


# ---------------------------------------------------------------------------
# U4 merge
# ---------------------------------------------------------------------------
POLICIES = ("skip", "replace", "append", "rename")


def merge(target: TableSet, sources: Sequence[TableSet], policy: str | Callable[[str, str], str] = "skip") -> TableSet:
    """U4: fold ``sources`` into ``target`` table by table.

    A table not yet present is copied. On a name conflict the policy decides:
    ``skip`` keeps the present table, ``replace`` takes the source's,
    ``append`` unions positionally, ``rename`` adds ``<table>_<source>``.
    The conflict set grows while merging, so a later source also conflicts
    with tables copied from an earlier one. A callable policy gets
    ``(table, source)`` and returns one of the four words (H1). Rename
    collisions are detected before anything is written (D12).
    """
    result: OrderedDict[str, DataFrame] = OrderedDict(target.items())
    for src in sources:
        for name, df in src.items():
            if name not in result:
                result[name] = df
                continue
            action = policy(name, src.name) if callable(policy) else policy
            if action not in POLICIES:
                raise ValueError(f"unknown conflict policy {action!r}")
            if action == "skip":
                continue
            if action == "replace":
                result[name] = df
            elif action == "append":
                result[name] = append(result[name], df)
            else:
                new = f"{name}_{src.name}"
                if new in result:
                    raise ValueError(f"renamed table {new} already exists in the merge result")
                result[new] = df
    return TableSet(result, name=target.name)


# ---------------------------------------------------------------------------
# J4 schema diff, J5 / U5 name sets
# ---------------------------------------------------------------------------

def schema_rows(spark: SparkSession, ts: TableSet) -> DataFrame:
    """(table_name, pos, column_name, type) for every column - driver metadata only."""
    rows = [(name, i, f.name, f.dataType.simpleString()) for name, df in ts.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, pos int, column_name string, type string")


def schema_diff_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """J4 over column rows: full outer join of per-table canonical schemas.

    status: only_first / only_second / different / identical; schema texts are
    the ordered ``name type`` lists; sorted by table name (D11).
    """

    def canon(cols: DataFrame, tag: str) -> DataFrame:
        s = F.struct("pos", F.concat_ws(" ", "column_name", "type").alias("c"))
        return cols.groupBy("table_name").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["c"]), ", ").alias(f"{tag}_schema"),
            F.count(F.lit(1)).alias(f"{tag}_columns"),
        )

    a, b = canon(first, "first"), canon(second, "second")
    j = a.join(b, "table_name", "full_outer")
    status = (
        F.when(F.col("second_schema").isNull(), "only_first")
        .when(F.col("first_schema").isNull(), "only_second")
        .when(F.col("first_schema") != F.col("second_schema"), "different")
        .otherwise("identical")
    )
    return j.withColumn("status", status).orderBy("table_name")


def schema_diff(a: TableSet, b: TableSet) -> DataFrame:
    spark = next(iter(a.values())).sparkSession
    return schema_diff_rows(schema_rows(spark, a), schema_rows(spark, b))


def only_in_first(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key is absent from ``b`` (anti join)."""
    return a.join(b.select(*on), list(on), "left_anti")


def conflicting(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``a`` whose key also exists in ``b`` (semi join)."""
    return a.join(b.select(*on), list(on), "left_semi")


def missing(requested: DataFrame, available: DataFrame, on: str = "name") -> DataFrame:
    """Requested names with nothing available (restore pre-check)."""
    return requested.join(available.select(on), [on], "left_anti")


# ---------------------------------------------------------------------------
# J6 row sync
# ---------------------------------------------------------------------------

def check_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    """Raise on a key that occurs more than once (nulls are values); one hash aggregate over the keys alone."""
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).take(1)
    if dup:
        raise ValueError(f"duplicate key {dup[0].asDict()} in {what}")


def sync_changes(src: DataFrame, tgt: DataFrame, keys: Sequence[str], mode: str = "full", verify_keys: bool = True) -> DataFrame:
    """Per key, what turns ``tgt`` into ``src``.

    Output: keys, ``action`` (insert / update / delete / same), ``new_row`` and
    ``old_row`` structs of the non-key columns. Keys and values compare
    null-safely. A key that repeats on either side is an error, found before
    anything is joined; ``verify_keys=False`` is for keys that the caller
    knows to be unique. One shuffle per side for the full outer join on the
    keys. ``mode='structure'`` yields no row changes.
    """
    if mode not in ("structure", "data", "full"):
        raise ValueError(f"bad sync mode {mode}")
    keys = list(keys)
    if verify_keys and mode != "structure":
        check_unique(src, keys, "the source")
        check_unique(tgt, keys, "the target")

    def side(df: DataFrame, tag: str, row: str) -> DataFrame:
        vals = [c for c in df.columns if c not in keys]
        return df.select(*[F.col(f"`{k}`").alias(f"{tag}{i}") for i, k in enumerate(keys)], F.struct(*[F.col(f"`{v}`") for v in vals]).alias(row))

    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_s{i}").eqNullSafe(F.col(f"_t{i}"))
    j = side(src, "_s", "new_row").join(side(tgt, "_t", "old_row"), on, "full_outer")
    action = (
        F.when(F.col("old_row").isNull(), "insert")
        .when(F.col("new_row").isNull(), "delete")
        .when(F.col("new_row").eqNullSafe(F.col("old_row")), "same")
        .otherwise("update")
    )
    named = [F.when(F.col("new_row").isNull(), F.col(f"_t{i}")).otherwise(F.col(f"_s{i}")).alias(k) for i, k in enumerate(keys)]
    out = j.select(*named, action.alias("action"), "new_row", "old_row")
    return out.limit(0) if mode == "structure" else out


def sync_counts(changes: DataFrame) -> DataFrame:
    """Rows inserted / updated / deleted / unchanged."""
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def sync_apply(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the sync: every row whose action is not delete, new values."""
    return changes.where(F.col("action") != "delete").select(*keys, "new_row.*")


def table_changes(a: TableSet, b: TableSet) -> dict:
    """Structure part of a sync: tables to create, modify or skip (by schema)."""
    diff = {r.table_name: r.status for r in schema_diff(a, b).select("table_name", "status").collect()}
    return {
        "created": sorted(t for t, s in diff.items() if s == "only_first"),
        "modified": sorted(t for t, s in diff.items() if s == "different"),
        "skipped": sorted(t for t, s in diff.items() if s == "identical"),
    }
