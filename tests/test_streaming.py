import os
import tempfile

from pyspark.sql import functions as F

from tablecraft.plans.dump import write_dump
from tablecraft.streaming import jobs
from tablecraft.tableset import TableSet


def test_stream_load_resumes_and_only_loads_new_files(spark, sf):
    o = spark.read.parquet(os.path.join(sf, "orders.parquet"))
    first, second = o.where(F.col("o_orderkey") % 2 == 0), o.where(F.col("o_orderkey") % 2 == 1)
    root = tempfile.mkdtemp(prefix="stream-")
    incoming, out, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    write_dump(TableSet({"orders": first}), f"{incoming}/a", "mysql", parts=2)
    jobs.stream_load(spark, incoming, "orders", o.schema, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == first.count()
    # a second dump arrives; the restarted query picks up only the new part files
    write_dump(TableSet({"orders": second}), f"{incoming}/b", "mysql", parts=2)
    jobs.stream_load(spark, incoming, "orders", o.schema, out, ckpt).awaitTermination()
    back = spark.read.parquet(out).drop("batch")
    assert back.count() == o.count() and back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0


def test_latest_metrics_stream_matches_batch(spark, sf):
    path = os.path.join(sf, "events.parquet")
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    s = s.select((F.col("user_id") % 3).alias("server"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = jobs.run_to_table(jobs.latest_metrics(s, "server", "ts"), tempfile.mkdtemp(prefix="out-") + "/t", "complete", tempfile.mkdtemp(prefix="ck-"))
    batch = spark.read.parquet(path).groupBy((F.col("user_id") % 3).alias("server")).agg(F.max_by("event_id", "ts").alias("event_id"))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in batch.collect())
