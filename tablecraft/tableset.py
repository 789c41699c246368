"""TableSet: an ordered, named set of DataFrames (a "database").

S1 scan, S2 paging, P3 subset, K7 save. Nothing here runs a job except
``save`` and ``page_bounds``; everything else only builds plans.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import fs


class TableSet(Mapping):
    """Ordered ``{table name -> DataFrame}`` with a namespace name."""

    def __init__(self, tables: Mapping[str, DataFrame] | Iterable[tuple[str, DataFrame]], name: str = "default"):
        self._tables: OrderedDict[str, DataFrame] = OrderedDict(tables.items() if isinstance(tables, Mapping) else tables)
        self.name = name

    # -- loaders -----------------------------------------------------------
    @classmethod
    def from_dir(cls, spark: SparkSession, path: str, names: Iterable[str] | None = None, name: str = "default") -> "TableSet":
        """One table per ``<name>.parquet`` entry of ``path``."""
        if names is None:
            seen = set()
            for p, _ in fs.list_files(path, recursive=True):
                parts = p.split("/")
                for part in parts:
                    if part.endswith(".parquet"):
                        seen.add(part[: -len(".parquet")])
                        break
            names = sorted(seen)
        return cls(((n, spark.read.parquet(f"{path.rstrip('/')}/{n}.parquet")) for n in names), name=name)

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> "TableSet":
        rows = spark.sql(f"SHOW TABLES IN {quote_spark(database)}").collect()
        names = [r.tableName for r in rows if not r.isTemporary]
        return cls(((n, spark.table(f"{quote_spark(database)}.{quote_spark(n)}")) for n in names), name=database)

    # -- mapping protocol ----------------------------------------------------
    def __getitem__(self, key: str) -> DataFrame:
        return self._tables[key]

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def names(self) -> list[str]:
        return list(self._tables)

    # -- set-level helpers -----------------------------------------------------
    def select(self, names: Iterable[str] | None) -> "TableSet":
        """Subset in the caller's order; ``None`` keeps all. Unknown names raise."""
        if names is None:
            return self
        names = list(names)
        missing = [n for n in names if n not in self._tables]
        if missing:
            raise KeyError(f"tables not found in {self.name}: {missing}")
        return TableSet(((n, self._tables[n]) for n in names), name=self.name)

    def with_table(self, name: str, df: DataFrame) -> "TableSet":
        out = OrderedDict(self._tables)
        out[name] = df
        return TableSet(out, name=self.name)

    def without(self, name: str) -> "TableSet":
        out = OrderedDict(self._tables)
        out.pop(name, None)
        return TableSet(out, name=self.name)

    def renamed(self, name: str) -> "TableSet":
        return TableSet(self._tables, name=name)

    def catalog(self, spark: SparkSession) -> DataFrame:
        """Table names as a DataFrame(ns, name, pos) - driver-side metadata only."""
        rows = [(self.name, n, i) for i, n in enumerate(self._tables)]
        return spark.createDataFrame(rows, "ns string, name string, pos int")

    def register(self, prefix: str = "") -> "TableSet":
        """Expose every table to ``spark.sql`` as a temporary view ``<prefix><name>``."""
        for n, df in self._tables.items():
            df.createOrReplaceTempView(f"{prefix}{n}")
        return self

    def save_to_catalog(self, namespace: str, if_exists: str = "error") -> "TableSet":
        """K7 for every table, into the session catalog; with ``error`` nothing is written if any table is there."""
        spark = next(iter(self._tables.values())).sparkSession
        if if_exists == "error" and (there := [n for n in self._tables if spark.catalog.tableExists(f"{quote_spark(namespace)}.{quote_spark(n)}")]):
            raise FileExistsError(f"tables exist in {namespace}: {there}")
        return TableSet({n: save_catalog_table(df, namespace, n, if_exists) for n, df in self._tables.items()}, name=namespace)

    def save(self, root: str, mode: str = "errorifexists") -> None:
        """K7 for every table: ``<root>/<table>.parquet``."""
        for n, df in self._tables.items():
            save_table(df, f"{root.rstrip('/')}/{n}.parquet", mode=mode)


def quote_spark(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# ---------------------------------------------------------------------------
# S2 / O4 paging
# ---------------------------------------------------------------------------
PAGE_SIZE = 50  # fixed value: rows per page when browsing


def page(df: DataFrame, order_by: list[str | Column], size: int = PAGE_SIZE, page_no: int = 0) -> DataFrame:
    """Rows ``[page_no*size, (page_no+1)*size)`` in a deterministic order.

    ``order_by`` must be a unique key; Spark turns sort + offset + limit into a
    per-partition top-k (TakeOrderedAndProject), so no full sort happens.
    """
    if size <= 0:
        raise ValueError("page size must be positive")
    return df.orderBy(*order_by).offset(page_no * size).limit(size)


def page_bounds(total: int, size: int = PAGE_SIZE, page_no: int = 0) -> dict:
    """Pager text numbers: 1-based first/last row on the page and last page index (D3)."""
    last_page = max(math.ceil(total / size) - 1, 0)
    start = page_no * size + 1 if total else 0
    end = min((page_no + 1) * size, total)
    return {"start": start, "end": end, "total": total, "last_page": last_page, "text": f"{start}-{end} of {total}"}


# ---------------------------------------------------------------------------
# K7
# ---------------------------------------------------------------------------
def save_table(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Write a table; ``mode`` is ``errorifexists`` (default) or ``overwrite`` (drop first)."""
    if mode not in ("errorifexists", "error", "overwrite", "append", "ignore"):
        raise ValueError(f"bad mode {mode}")
    df.write.mode(mode).format(fmt).save(path)


def save_catalog_table(df: DataFrame, namespace: str, name: str, if_exists: str = "error", fmt: str = "parquet") -> DataFrame:
    """K7 into the session catalog: a table of ``namespace``, which is created if need be; returns the table.

    ``replace`` writes the rows into a new table first and then swaps names, so the present table may be read by ``df``,
    and stays as it is if the write fails; ``append`` adds rows by column name; ``skip`` keeps a present table.
    """
    if if_exists not in ("error", "replace", "append", "skip"):
        raise ValueError("if_exists is 'error', 'replace', 'append' or 'skip'")
    spark = df.sparkSession
    full = lambda n: f"{quote_spark(namespace)}.{quote_spark(n)}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quote_spark(namespace)}")
    there = spark.catalog.tableExists(full(name))
    if there and if_exists == "error":
        raise FileExistsError(f"table {namespace}.{name} exists")
    if not there:
        df.write.format(fmt).saveAsTable(full(name))
    elif if_exists == "append":
        df.select(*spark.table(full(name)).columns).write.insertInto(full(name))
    elif if_exists == "replace":
        tag = uuid.uuid4().hex[:12]
        new, old = f"{name}__new_{tag}", f"{name}__old_{tag}"
        try:
            df.write.format(fmt).saveAsTable(full(new))
        except BaseException:
            spark.sql(f"DROP TABLE IF EXISTS {full(new)}")
            raise
        spark.sql(f"ALTER TABLE {full(name)} RENAME TO {full(old)}")
        try:
            spark.sql(f"ALTER TABLE {full(new)} RENAME TO {full(name)}")
        except BaseException:
            spark.sql(f"ALTER TABLE {full(old)} RENAME TO {full(name)}")
            raise
        spark.sql(f"DROP TABLE {full(old)}")
    return spark.table(full(name))


# ---------------------------------------------------------------------------
# Section 3.1: plain SQL text
# ---------------------------------------------------------------------------
_READ_PREFIXES = ("SELECT", "SHOW", "DESCRIBE", "EXPLAIN")


def is_read(text: str, cte_as_read: bool = False) -> bool:
    """P8 on one statement: reads start with SELECT / SHOW / DESCRIBE / EXPLAIN (and WITH if asked)."""
    u = text.strip().upper()
    return u.startswith(_READ_PREFIXES) or (cte_as_read and u.startswith("WITH"))


def run_sql(spark: SparkSession, text: str, cte_as_read: bool = True) -> tuple[str, DataFrame]:
    """Run one SQL statement through Catalyst: ``("read", rows)`` for a read, ``("write", result)``
    for anything else (DDL / DML run eagerly, as ``spark.sql`` does). Nothing is collected here."""
    df = spark.sql(text)
    return ("read" if is_read(text, cte_as_read) else "write"), df
