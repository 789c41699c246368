"""Structured Streaming jobs (T1 incremental load, T2 latest metrics, T3 on streams).

T1: new dump files arriving in a folder are picked up by a file stream
(``binaryFile`` with only path and length selected, so file contents are
never read by the stream itself); each micro-batch loads exactly those
files with the batch loader and writes ``<out>/batch=<id>`` with overwrite,
so a replayed micro-batch after a failure rewrites the same folder
(idempotent). The checkpoint replaces the reference's byte offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.health import health_levels
from ..plans.load import load_dump
from ..session import staging_path
from ..sources import fs


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_load(spark: SparkSession, src_dir: str, table: str, schema: T.StructType, out: str, checkpoint: str,
                dialect: str = "mysql", available_now: bool = True, max_files: int = 100,
                glob: str = "*", on_error: str = "fail", rejects: str | None = None) -> StreamingQuery:
    """Incremental, resumable, batch-atomic load of dump files into parquet.

    A statement that does not load fails the query before the micro-batch writes
    anything. With ``on_error='skip'`` failed batches are left out and every
    rejected statement is written to ``<rejects>/batch=<id>`` (default
    ``<out>-rejects``). Files whose names start with ``_`` or ``.`` are hidden
    to Spark's file stream.
    """
    rejects = (rejects or f"{out.rstrip('/')}-rejects").rstrip("/")
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .load(src_dir)
        .select("path", "length")
    )

    def load_batch(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # file names of this micro-batch only
        if not paths:
            return
        paths = [p for p in paths if p.rsplit("/", 1)[-1] not in ("metadata.json",)]
        res = load_dump(spark, paths, dialect, tables=[table], schemas={table: schema}, on_error=on_error)
        if on_error == "skip":
            res.rejects.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        res.tables[table].write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    w = files.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def latest_metrics(stream: DataFrame, key: str = "server", ts: str = "ts", watermark: str | None = "10 minutes") -> DataFrame:
    """Latest sample per key. ``max_by(struct, ts)`` is a streaming-safe aggregate;
    the watermark (ours, not the reference's) bounds the state for append/update output."""
    s = stream
    if watermark:
        s = s.withWatermark(ts, watermark)
    cols = [c for c in stream.columns if c != key]
    return s.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(ts)).alias("latest")).select(key, "latest.*")


def run_to_table(df: DataFrame, path: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Drive a streaming frame to completion (availableNow) into Parquet at ``path`` and return that table.

    Append mode uses the file sink; complete mode overwrites the table with each micro-batch's whole result.
    """
    w = df.writeStream.outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    if mode == "append":
        w.format("parquet").option("path", path).start().awaitTermination()
    else:
        w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_latest(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, key: str, ts: str, buckets: int = 16) -> None:
    """One micro-batch into a table of the newest row per key; doing it again changes nothing.

    Keys are dealt to buckets. A micro-batch writes one version that holds the buckets it touches, made of their last
    older version and the batch; a version counts once its ``_SUCCESS`` is there. Versions that no bucket needs any more
    are removed, but for the one before, which doing the batch again needs.
    """
    path = path.rstrip("/")
    cols = [c for c in batch.columns if c != key]
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")
    newest = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts), F.xxhash64(*cols))).alias("_row")).select(key, "_row.*").select(*batch.columns)
    held = staging_path(spark, "latest-batch")
    newest(batch).withColumn("_bucket", bucket).write.parquet(held)
    own = spark.read.parquet(held)
    touched = {r[0] for r in own.select("_bucket").distinct().collect()}  # at most ``buckets``
    if not touched:
        return
    present = _newest(path, batch_id)
    rows = own.select(*batch.columns)
    if old := [f"{path}/version={v}/bucket={b}" for b, v in present.items() if b in touched]:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*old))
    newest(rows).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
    needed = set(_newest(path).values()) | set(present.values())
    for v in _versions(path):
        if v not in needed and v < batch_id:
            fs.delete_dir(f"{path}/version={v}")


def _versions(path: str) -> list[int]:
    dirs = fs.list_dirs(path) if fs.exists(path) else []
    return sorted(int(d.rsplit("=", 1)[1]) for d in dirs if "version=" in d and fs.exists(f"{d}/_SUCCESS"))


def _newest(path: str, before: int | None = None) -> dict[int, int]:
    """The newest version (older than ``before``) of each bucket."""
    out = {}
    for v in _versions(path):
        if before is None or v < before:
            out |= {int(d.rsplit("=", 1)[1]): v for d in fs.list_dirs(f"{path}/version={v}") if "bucket=" in d}
    return out


def read_latest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table that ``upsert_latest`` keeps."""
    path = path.rstrip("/")
    newest = [f"{path}/version={v}/bucket={b}" for b, v in _newest(path).items()]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def run_latest_to_table(stream: DataFrame, path: str, checkpoint: str, key: str = "server", ts: str = "ts", buckets: int = 16) -> DataFrame:
    """T2 into a table: every micro-batch changes the keys that it holds only."""
    spark = stream.sparkSession
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w.foreachBatch(lambda batch, batch_id: upsert_latest(spark, batch, batch_id, path, key, ts, buckets)).start().awaitTermination()
    return read_latest(spark, path, stream.schema)


def stream_health(stream: DataFrame, lag: str = "lag_seconds") -> DataFrame:
    """T3 on a stream: stateless level / health columns per arriving row."""
    return health_levels(stream, lag)
