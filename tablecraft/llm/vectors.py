"""What the two vector searches share: valid vectors, shards, and queries meeting every shard in blocks.

Candidates are dealt to shards of about SHARD_ROWS rows by a hash of their id, which spreads equal vectors evenly.
The stated query set meets all rows: queries are copied to the shards, at most QUERY_ROWS of them to a group, so
that a task holds one shard and one such block whatever the size of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS = 8192, 16_384


def finite(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def one_per_id(queries: DataFrame) -> DataFrame:
    """Queries (id, v) with ids told apart: the smallest vector of each id."""
    return queries.groupBy("id").agg(F.min("v").alias("v"))


def blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def sharded(candidates: DataFrame, shards: int, groups: int) -> DataFrame:
    """Candidates (id, v) with dim, shard and each group of queries that they have to meet.

    Rows are dealt by id and vector, so that rows that repeat an id are spread as well.
    """
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    return candidates.select(F.size("v").alias("dim"), shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "id", "v")


def part_of(groups: int) -> Column:
    """The group of a query."""
    return F.pmod(F.xxhash64("id", F.lit("part")), F.lit(groups)).cast("int")


def meet(queries: DataFrame, candidates: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], score: str) -> DataFrame:
    """What ``search(queries, candidates)`` finds in each (dim, shard, part): query_id, vec_id, score."""
    keys = ["dim", "shard", "part"]
    schema = f"query_id long, vec_id long, score {score}"

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64 if score == "long" else float)})
        return search(q, c)

    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
