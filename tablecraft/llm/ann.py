"""Approximate nearest neighbours by collision counting.

Each shard projects its unit vectors on PROJECTIONS random lines and keeps one sorted array for each. A query
opens a window around its own projection on every line. Virtual rehashing widens all windows by GROWTH, and only
what the wider windows newly cover is counted. A vector that lies in THRESHOLD of the windows is verified with
its exact cosine. The search of a shard ends when, at the k-th best distance found so far, a vector would lie in
a window with a probability that exceeds THRESHOLD by MARGIN standard deviations of the count, or when the
windows cover the shard. There is no limit on windows, candidates or verified vectors.

All rows are indexed; only the projections' directions are random (fixed seed). Shards and the merge of their
results are those of ``vectors``; as every shard contributes its own k nearest, recall grows with shards.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no
part; vectors meet only vectors of the same length; rows with the query's id are its own; rows that repeat an id
are candidates each; a repeated query id counts once, with its smallest vector; ties go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import read, stage

PROJECTIONS, THRESHOLD, MARGIN = 60, 0.6, 1.0
#: Half the width of the first windows, and the factor by which they grow.
WIDTH, GROWTH = 0.06, 1.5
SEED = 17


def _exponents(rows: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(rows).max(axis=1))[1]


def normal(rows: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two to components below 1: cosines stay the same to the last bit."""
    return np.ldexp(rows, -_exponents(rows)[:, None])


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=1))


class Index:
    """Sorted projections of one shard's vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = normal(rows), ids
        self.lengths = lengths(self.rows)
        self.lines = np.random.default_rng(SEED).standard_normal((rows.shape[1], PROJECTIONS))
        at = (self.rows / self.lengths[:, None]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.sort(at, axis=0).T)
        self.need = math.ceil(THRESHOLD * PROJECTIONS)
        enough = THRESHOLD + MARGIN * math.sqrt(THRESHOLD * (1 - THRESHOLD) / PROJECTIONS)
        self.reach = math.sqrt(2) * _inverse_erf(enough)

    def search(self, queries: np.ndarray, owns: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query id, id, cosine) of the k nearest found for each query."""
        queries = normal(queries)
        sizes = lengths(queries)
        at = (queries / sizes[:, None]) @ self.lines
        n, half, steps = len(self.ids), WIDTH, []
        while not steps or (steps[-1][1] - steps[-1][0]).min() < n:
            edges = [np.stack([np.searchsorted(s, at[:, j] - half, "left"), np.searchsorted(s, at[:, j] + half, "right")]) for j, s in enumerate(self.sorted)]
            steps.append((*np.stack(edges, axis=1), half))
            half *= GROWTH
        out = []
        for i, own in enumerate(owns):
            out += [(own, *x) for x in self._one(queries[i], sizes[i], own, k, [(s[0][:, i].tolist(), s[1][:, i].tolist(), s[2]) for s in steps])]
        return out

    def _one(self, q: np.ndarray, size: float, own: int, k: int, steps: list) -> list[tuple[int, float]]:
        n, order = len(self.ids), self.order
        counts, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        found = np.zeros(0, np.int64)
        cosines = np.zeros(0)
        left = right = None
        for lefts, rights, half in steps:
            if left is None:
                new = [order[j, a:b] for j, (a, b) in enumerate(zip(lefts, rights))]
            else:
                new = [order[j, a:b] for j, (a, b) in enumerate(zip(lefts, left)) if a < b] + [order[j, a:b] for j, (a, b) in enumerate(zip(right, rights)) if a < b]
            left, right = lefts, rights
            if not new:
                continue
            counts += np.bincount(np.concatenate(new), minlength=n)
            rows = np.nonzero((counts >= self.need) & ~seen)[0]
            if len(rows):
                seen[rows] = True
                rows = rows[self.ids[rows] != own]
                found = np.concatenate([found, rows])
                cosines = np.concatenate([cosines, (self.rows[rows] * q).sum(axis=1) / (self.lengths[rows] * size)])
                top = np.lexsort((self.ids[found], -cosines))[:k]
                found, cosines = found[top], cosines[top]
            if len(found) >= k and half >= self.reach * math.sqrt(max(0.0, 2 - 2 * cosines[k - 1])):
                break
        return [(int(self.ids[r]), float(c)) for r, c in zip(found, cosines)]


def _inverse_erf(p: float) -> float:
    low, high = 0.0, 6.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid) < p else (low, mid)
    return low


def _search(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        index = Index(np.stack(candidates["v"].to_numpy()), candidates["id"].to_numpy())
        out = index.search(np.stack(queries["v"].to_numpy()), queries["id"].to_numpy(), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": np.int64, "vec_id": np.int64, "score": float})

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = vectors.SHARD_ROWS, query_rows: int = vectors.QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that are found for each query.

    Both tables: id (long) and v (array of double).
    """
    usable = F.col("id").isNotNull() & vectors.finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    candidates, queries = stage(candidates.where(usable), "ann-rows"), stage(vectors.one_per_id(queries.where(usable)), "ann-queries")
    shards, parts = vectors.blocks(candidates.count(), shard_rows), vectors.blocks(queries.count(), query_rows)
    asked = queries.select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), vectors.part_of(parts).alias("part"), "id", "v")
    return vectors.best(vectors.meet(asked, vectors.sharded(candidates, shards, parts), _search(k), "double"), k)


def op9_ann(spark, sf_dir: str) -> DataFrame:
    """The five nearest found for every fiftieth vector."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return search(rows, rows.where("id % 50 = 0"))
