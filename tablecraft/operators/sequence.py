"""Global sequence numbers in key order without an unpartitioned window.

Rows are range-partitioned and sorted by the key, pinned with a reliable
checkpoint (so the partition boundaries cannot move between the counting
job and the numbering job), counted per partition, and numbered as
``offset[partition] + index in partition``. Only one number per partition
reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW = (1 << 33) - 1


def with_sequence(df: DataFrame, order_by: list[str | Column] | str, out: str = "seq", partitions: int | None = None) -> DataFrame:
    """Adds ``out`` = 0-based rank of each row in ``order_by`` order.

    Ties are in the order of a hash of the whole row, so they are the same in every run, and rows of one key that are
    very many go to several partitions. (Columns that hold maps do not enter the hash.)
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [*keys, F.xxhash64(*hashed)] if hashed else keys
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pinned = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    part = F.shiftright(F.col("_mid"), 33)
    counts = dict(pinned.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    width = max(counts) + 1 if counts else 1
    sizes = [counts.get(i, 0) for i in range(width)]
    offsets = [0] + list(accumulate(sizes))[:-1]
    table = F.array(*[F.lit(o).cast("long") for o in offsets])
    seq = F.element_at(table, (part + 1).cast("int")) + F.col("_mid").bitwiseAND(F.lit(_LOW))
    return pinned.withColumn(out, seq).drop("_mid")
