"""Exact top-k by inner product with a KD-tree per shard.

Each shard's vectors are split at the median of the dimension in which they spread most, down to leaves of LEAF
rows; every node keeps the tight box of its vectors and its smallest id. A query walks a tree best-first: the
inner product with a box is at most the sum over dimensions of max(q * low, q * high), and the walk ends at the
first box that cannot beat the k-th result so far (on equality: whose smallest id is not smaller).

The k-th result is propagated between shards: every query first searches one home shard, and enters all others
with that shard's k-th score and id as its floor. Results of all shards are merged by a window with the k best.

Scores are exact: components are integers, sums run in doubles while they stay below 2**53 and in Python's
integers beyond, clipped to the range of a long.

Defined results: vectors that are null, empty or hold null or non-finite components, and null ids, take no part;
vectors meet only vectors of the same length; rows with the query's id are its own; rows that repeat an id are
candidates each; a repeated query id counts once, with its smallest vector; components beyond the range of a long
after scaling are clipped to it; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import read, stage

LEAF = 128
#: Below every score that a long holds.
LOWEST = -(2**63) - 1
MOST_ID = 2**63


def _clip(score: int) -> int:
    return min(max(int(score), -(2**63)), 2**63 - 1)


class Tree:
    """A KD-tree over the rows of ``points`` (integers) with their ids."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.points, self.ids = points[order], ids[order]
        rows = np.arange(len(ids))
        self.low, self.high, self.least, self.children, self.rows = [], [], [], [], []
        stack = [(rows, None)]
        while stack:
            rows, parent = stack.pop()
            here = self.points[rows]
            me, low, high = len(self.low), here.min(0), here.max(0)
            self.low.append(low)
            self.high.append(high)
            self.least.append(int(self.ids[rows].min()))
            self.children.append([])
            self.rows.append(rows if len(rows) <= leaf else None)
            if parent is not None:
                self.children[parent].append(me)
            if len(rows) > leaf:
                spread = high.astype(float) - low.astype(float)
                rows = rows[np.argsort(here[:, int(np.argmax(spread))], kind="stable")]
                half = len(rows) // 2
                stack += [(np.sort(rows[half:]), me), (np.sort(rows[:half]), me)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.largest = max(abs(int(points.max())), abs(int(points.min())))
        self.floats = (self.points.astype(float), self.low.astype(float), self.high.astype(float))
        self.leaves = {i: (self.floats[0][r], self.ids[r]) for i, r in enumerate(self.rows) if r is not None}

    def search(self, query: np.ndarray, own: int, k: int, floor: tuple[int, int] = (LOWEST, MOST_ID)) -> list[tuple[int, int]]:
        """The k best (score, id) that beat ``floor`` (a score and the id up to which it is beaten on a tie)."""
        exact = len(query) * self.largest * max(abs(int(query.max())), abs(int(query.min()))) < 2**53
        if exact:
            q = query.astype(float)
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            bounds = (self.floats[2] @ up + self.floats[1] @ down).tolist()
        else:
            q = query.astype(object)
            bounds = [_clip(x) for x in np.maximum(self.low.astype(object) * q, self.high.astype(object) * q).sum(1)]
        kept: list[tuple[int, int]] = []  # a heap of (score, -id)
        score, last = floor
        queue = [(-bounds[0], self.least[0], 0)]
        while queue:
            bound, least, node = heapq.heappop(queue)
            if -bound < score or (-bound == score and least > last):
                break
            if self.rows[node] is None:
                for child in self.children[node]:
                    if bounds[child] >= score:
                        heapq.heappush(queue, (-bounds[child], self.least[child], child))
                continue
            if exact:
                points, ids = self.leaves[node]
                scores = points @ q
            else:
                ids = self.ids[self.rows[node]]
                scores = np.array([_clip(x) for x in self.points[self.rows[node]].astype(object) @ q], dtype=object)
            for i in np.nonzero(scores >= score)[0]:
                found = (int(scores[i]), -int(ids[i]))
                if found > (score, -last) and ids[i] != own:
                    (heapq.heappushpop if len(kept) == k else heapq.heappush)(kept, found)
                    if len(kept) == k:
                        score, last = kept[0][0], -kept[0][1]
        return [(s, -i) for s, i in kept]


def _search(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(np.stack(candidates["v"].to_numpy()), candidates["id"].to_numpy())
        out = []
        for own, v, known, s, i in zip(queries["id"], queries["v"], queries["floored"], queries["floor_score"], queries["floor_id"], strict=True):
            floor = (int(s), int(i)) if known else (LOWEST, MOST_ID)
            out += [(own, i, s) for s, i in tree.search(np.asarray(v), own, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = vectors.SHARD_ROWS, query_rows: int = vectors.QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query.

    Both tables: id (long) and v (array of long).
    """
    usable = F.col("id").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    candidates, queries = stage(candidates.where(usable), "kd-rows"), stage(vectors.one_per_id(queries.where(usable)), "kd-queries")
    shards, parts = vectors.blocks(candidates.count(), shard_rows), vectors.blocks(queries.count(), query_rows)
    rows = vectors.sharded(candidates, shards, parts)
    home = F.pmod(F.xxhash64("id", F.lit("home")), F.lit(shards)).cast("int")
    asked = queries.select(F.size("v").alias("dim"), vectors.part_of(parts).alias("part"), "id", "v", home.alias("home"))
    # floors without nulls, which pandas would turn into doubles
    none = [F.lit(False).alias("floored"), F.lit(0).cast("long").alias("floor_score"), F.lit(0).cast("long").alias("floor_id")]
    first = stage(vectors.meet(asked.select("dim", F.col("home").alias("shard"), "part", "id", "v", *none), rows, _search(k), "long"), "kd-home")
    kth = vectors.best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    floors = [F.col("floor_id").isNotNull().alias("floored"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("floor_score", "floor_id")]]
    again = asked.join(kth, "id", "left").select("dim", F.explode(others).alias("shard"), "part", "id", "v", *floors)
    return vectors.best(first.unionByName(vectors.meet(again, rows, _search(k), "long")), k)


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def op2_kdtree(spark, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings").where(vectors.finite(F.col("embedding")))
    rows = rows.select(F.col("vec_id").alias("id"), scaled(F.col("embedding")).alias("v"))
    return search(rows, rows.where("id % 50 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
