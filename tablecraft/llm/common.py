"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.session import staging_path

#: Rows of a lookup table that may be broadcast; beyond it the lookup becomes a salted equi-join.
BROADCAST_ROWS = 50_000
#: Copies of a lookup table in the salted join, and so the number of tasks that share a hot key.
SALTS = 32
#: Bytes of a table that may be broadcast after they were measured.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    It cuts the lineage and lets several plans read one result. The files outlive any executor;
    ``staging_path`` has them removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = staging_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove the files of a staged table whose last reader is done."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs started inside pass at most ``size`` to Python at once, which bounds the memory of a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, lengthened by underscores until no column in ``taken`` has it (case is ignored)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def lookup(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of ``big`` with a staged lookup table that has one row for each key.

    Broadcast if the table has at most BROADCAST_ROWS rows. Otherwise an equi-join in which every row of
    ``big`` takes one of SALTS salts and ``small`` has a copy for each, so that a hot key is shared out.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys)
    salt = fresh([*big.columns, *small.columns], "_salt")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in keys]), F.lit(SALTS)).cast("int")
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn(salt, spread).join(copies, [*keys, salt]).drop(salt)


def within_bytes(table: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table of scalar columns has at most ``limit`` bytes (16 a row and column, and its texts)."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns), F.lit(16 * len(table.columns)))
    return (table.agg(F.sum(width.cast("long"))).first()[0] or 0) <= limit


def measured_lookup(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """As ``lookup``, broadcasting by the measured bytes of ``small``, a staged table of scalar columns."""
    if within_bytes(small):
        return big.join(F.broadcast(small), keys)
    salt = fresh([*big.columns, *small.columns], "_salt")
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if c not in keys]), F.lit(SALTS)).cast("int")
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn(salt, spread).join(copies, [*keys, salt]).drop(salt)
