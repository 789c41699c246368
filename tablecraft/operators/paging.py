"""S2 for deep pages: a table in key order with the row count of every range, so that a page opens one or two ranges."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tableset import PAGE_SIZE


@dataclass
class PageIndex:
    """A copy of a table under ``path`` in ranges of ``keys``; ``ends`` are the running row counts of the ranges."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: T.StructType
    ranges: list[int]
    ends: list[int]

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def opened(self, start: int, stop: int) -> list[int]:
        """Positions of the ranges that hold rows [start, stop)."""
        stop = min(stop, self.total)
        return list(range(bisect_right(self.ends, start), bisect_right(self.ends, stop - 1) + 1)) if start < stop else []

    def page(self, page_no: int, size: int = PAGE_SIZE) -> DataFrame:
        """Rows ``[page_no * size, (page_no + 1) * size)`` in the order of the keys."""
        if size <= 0 or page_no < 0:
            raise ValueError("page size must be positive and the page number not negative")
        at = self.opened(page_no * size, (page_no + 1) * size)
        if not at:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/_range={self.ranges[i]}" for i in at])
        before = self.ends[at[0] - 1] if at[0] else 0
        return rows.orderBy(*self.keys).offset(page_no * size - before).limit(size)


def page_index(df: DataFrame, keys: Sequence[str], path: str, ranges: int | None = None) -> PageIndex:
    """Write ``df`` in ranges of ``keys`` (which must be unique) under ``path``; one count per range reaches the driver."""
    spark, keys = df.sparkSession, list(keys)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path.rstrip("/")
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    placed = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType())])
    counts = sorted((r["_range"], r["count"]) for r in spark.read.schema(placed).parquet(path).groupBy("_range").count().collect())
    return PageIndex(spark, path, keys, df.schema, [k for k, _ in counts], list(accumulate(c for _, c in counts)))
