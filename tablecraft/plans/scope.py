"""Which rows of a dump stay, and in which table of which namespace.

USE (and ``search_path``) puts the tables named after it into a namespace, per file. DROP, TRUNCATE and DELETE without a
condition take away all rows before them, in the order of files and statements, and a table that is created again has
its new columns. Only the last such statement of a table matters, so that is one number per table. The namespace in
force at a statement is looked up by blocks of statements: a block has the namespace at its start and the USE
statements inside it, so a row meets one block row in an equi-join, however many USE statements a file has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ddl import Scope, TableDef, parse_create_table, scope_of
from ..sources.inserts import DOT

#: Statements of a block.
BLOCK = 64
Position = tuple[str, int]


def with_namespace(raw: DataFrame, block: int = BLOCK) -> DataFrame:
    """``raw`` (as of ``decode_raw``) with ``_use``: the namespace that is in force at each statement, null for none."""
    blocked = raw.withColumn("_block", F.floor(F.col("_stmt_no") / block))
    uses = blocked.where("_kind = 'use'").select("_file", "_block", F.struct(F.col("_stmt_no").alias("at"), _entered(F.col("_stmt")).alias("ns")).alias("use"))
    inside = uses.groupBy("_file", "_block").agg(F.sort_array(F.collect_list("use")).alias("uses"))  # at most a block's statements
    blocks = blocked.select("_file", "_block").distinct().join(inside, ["_file", "_block"], "left")
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.last(F.element_at("uses", -1)["ns"], ignorenulls=True).over(before))
    here = F.try_element_at(F.filter("uses", lambda u: u["at"] < F.col("_stmt_no")), F.lit(-1))["ns"]
    met = blocked.join(blocks, ["_file", "_block"])
    return met.withColumn("_use", F.nullif(F.coalesce(here, "start"), F.lit(""))).drop("_block", "uses", "start")


def _entered(stmt: Column) -> Column:
    """The namespace that a USE statement names ('' for none), as the statement text has it."""
    name = F.regexp_extract(stmt, r"(?is)^\s*(?:USE\s+|SET\s+(?:SESSION\s+|LOCAL\s+)?search_path\s*(?:=|TO)\s*|SELECT\s+pg_catalog\.set_config\(\s*'search_path'\s*,\s*)(`(?:[^`]|``)+`|\"(?:[^\"]|\"\")+\"|'[^']*'|[\w$]+)", 1)
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    plain = F.when(name.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`"))).when(name.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(name.startswith("'"), inner).otherwise(name)
    return F.when(F.lower(plain) == "pg_catalog", F.lit("")).otherwise(plain)


@dataclass
class Source:
    """Rows of a target: those written as ``table`` (in the namespace ``use``, if not None) after position ``after``."""

    table: str
    use: str | None
    after: Position | None


@dataclass
class Target:
    name: str
    schema: object
    definition: TableDef | None
    sources: list[Source] = field(default_factory=list)

    def rows(self, raw: DataFrame) -> DataFrame:
        keep = F.lit(False)
        for s in self.sources:
            one = F.col("_table") == s.table
            if "_use" in raw.columns and DOT not in s.table:
                one = one & F.col("_use").eqNullSafe(F.lit(s.use))
            if s.after is not None:
                one = one & (F.struct("_file", "_stmt_no") > F.struct(F.lit(s.after[0]), F.lit(s.after[1]).cast("long")))
            keep = keep | one
        return raw.where(F.col("_table").isin([s.table for s in self.sources]) & keep)


@dataclass
class Scopes:
    """Definitions in force at the end of a dump, and the last position that took away rows, by (namespace, name)."""

    definitions: dict[tuple[str | None, str], TableDef]
    cleared: dict[tuple[str | None, str], Position]
    dropped: dict[str, Position]

    def after(self, key: tuple[str | None, str]) -> Position | None:
        return max((p for p in (self.cleared.get(key), self.dropped.get(key[0])) if p is not None), default=None)

    def find(self, ns: str | None, name: str) -> tuple[str | None, str] | None:
        """The table that a written name means."""
        if (ns, name) in self.definitions:
            return ns, name
        if ns is not None:
            return (None, name) if (None, name) in self.definitions else None
        named = [k for k in self.definitions if k[1] == name]
        return named[0] if len(named) == 1 else None


def resolve(rows: list, dialect: str) -> Scopes:
    """From scope statements: rows of (kind, use, stmt, at), ``at`` the position of the last one with that text."""
    out = Scopes({}, {}, {})
    for r in sorted(rows, key=lambda r: tuple(r["at"])):
        scope: Scope = scope_of(r["stmt"])
        at, use = tuple(r["at"]), r["use"]
        keys = [(ns if ns is not None else use, name) for ns, name in scope.names]
        if scope.kind == "create":
            new, key = parse_create_table(r["stmt"], dialect), keys[0]
            old = out.definitions.get(key)
            if old is not None and old.schema != new.schema and "IF NOT EXISTS" not in r["stmt"].upper():
                raise ValueError(f"table {new.name} is defined twice with different columns")
            out.definitions.setdefault(key, new)
        elif scope.kind == "like":
            ns, name = (scope.columns[-2] if len(scope.columns) > 1 else use), scope.columns[-1]
            if (like := out.find(ns, name)) is not None:
                out.definitions.setdefault(keys[0], out.definitions[like])
        elif scope.kind == "key":
            for key in filter(None, (out.find(*k) for k in keys)):
                out.definitions[key].primary_key = scope.columns
        elif scope.kind == "drop_all":
            ns = scope.names[0][1]
            out.dropped[ns] = at
            for key in [k for k in out.definitions if k[0] == ns]:
                del out.definitions[key]
        else:
            for key in keys:
                known = out.find(*key) or key
                out.cleared[key] = out.cleared[known] = at
                if scope.kind == "drop":
                    out.definitions.pop(known, None)
    return out
