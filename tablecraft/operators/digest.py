"""J6 by block digests: what turns one table into another, shuffling only the ranges that differ.

Rows are dealt to the leaves of a tree by a hash of their key. A node's digest is its number of rows and two mergeable
sums of row hashes, so both sides shuffle one small row per node. Level by level, only rows below nodes that differ are
digested further; the rows of differing leaves are compared exactly (``bulk.sync_changes``). The driver sees nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staging_path
from .bulk import sync_changes

#: Bits of a node's number by level: 1024 nodes, then up to a million leaves.
LEVELS = (10, 20)


def _hash(seed: int, cols: Sequence[str]) -> Column:
    """A hash of values that tells nulls apart."""
    parts = [x for c in cols for x in (F.isnull(F.col(f"`{c}`")), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *parts)


def digests(df: DataFrame, keys: Sequence[str], bits: int, columns: Sequence[str]) -> DataFrame:
    """node, rows, d1, d2: one row per node that holds rows."""
    rows = df.select(F.shiftrightunsigned(_hash(1, keys), 64 - bits).alias("node"), _hash(2, columns).alias("h1"), _hash(3, columns).alias("h2"))
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h1").alias("d1"), F.sum(F.col("h2").cast("decimal(20,0)")).alias("d2"))


def _below(df: DataFrame, keys: Sequence[str], nodes: DataFrame | None, bits: int) -> DataFrame:
    """Rows below the given nodes (at most 2**bits of them)."""
    if nodes is None:
        return df
    named = df.withColumn("_node", F.shiftrightunsigned(_hash(1, keys), 64 - bits))
    at = nodes.select(F.col("node").alias("_node"))
    return named.join(F.broadcast(at) if bits <= 20 else at, "_node", "left_semi").drop("_node")


def differing(src: DataFrame, tgt: DataFrame, keys: Sequence[str], levels: Sequence[int] = LEVELS) -> DataFrame:
    """The leaves (column node, of the last level) in which the tables differ, staged."""
    nodes, before, columns = None, 0, sorted(src.columns)
    if columns != sorted(tgt.columns):
        raise ValueError("the tables have different columns")
    for bits in levels:
        a, b = (digests(_below(df, keys, nodes, before), keys, bits, columns).select("node", F.struct("rows", "d1", "d2").alias(side)) for df, side in ((src, "a"), (tgt, "b")))
        found = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        path = staging_path(src.sparkSession, "digest")
        found.write.parquet(path)
        nodes, before = src.sparkSession.read.schema(found.schema).parquet(path), bits
    return nodes


def sync_by_digest(src: DataFrame, tgt: DataFrame, keys: Sequence[str], levels: Sequence[int] = LEVELS) -> DataFrame:
    """As ``sync_changes`` without the rows that are the same. A key that repeats is an error where its leaf differs."""
    nodes = differing(src, tgt, keys, levels)
    changes = sync_changes(_below(src, keys, nodes, levels[-1]), _below(tgt.select(*src.columns), keys, nodes, levels[-1]), keys)
    return changes.where("action <> 'same'")
