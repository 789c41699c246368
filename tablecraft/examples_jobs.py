"""Queries over jobs: progress, totals, ledgers, catalog tables, digests, pages, streams into keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import formats as fmt
from .functions.ddl import rename_table
from .functions.dialect import create_table_sql, sql_literal
from .operators import digest, paging, retention, stats
from .plans import backup
from .plans.dump import write_dump
from .plans.journal import load_journaled, read_journaled
from .plans.load import load_dump
from .plans.progress import ProgressTable
from .plans.textsink import write_text
from .session import staging_path
from .sources import fs
from .streaming import jobs as streams
from .tableset import TableSet

SHOP, REF = ["customer", "orders", "lineitem"], ["region", "nation", "part", "supplier"]
SYNC_KEYS = ["o_orderkey", "o_orderpriority"]


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def q_index_sizes(spark, sf_dir):
    """Customers as indexes on their nations, regions as namespaces."""
    c, n = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation")
    first = 1_000_000  # ids of indexes follow those of tables
    tables = n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("namespace_id"), F.lit(0).cast("long").alias("size"))
    named = c.select((F.col("c_custkey") + first).alias("id"), F.col("c_name").alias("name"), F.lit(-1).cast("long").alias("namespace_id"), F.round(F.col("c_acctbal") * 100).cast("long").alias("size"))
    indexes = c.select((F.col("c_custkey") + first).alias("index_id"), F.col("c_nationkey").cast("long").alias("table_id"))
    spaces = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    return stats.index_sizes(indexes, tables.unionByName(named), spaces, "EUROPE")


def q_rename_lookup(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return stats.rename_lookup(o, {"F": "finished", "O": "open"}, "o_orderstatus")


def q_job_totals(spark, sf_dir):
    """Totals of a backup over its manifest."""
    root = staging_path(spark, "totals")
    backup.create_backup([TableSet.from_dir(spark, sf_dir, SHOP, name="shop"), TableSet.from_dir(spark, sf_dir, REF, name="ref")], root)
    files = backup.read_backups(spark, root).select(F.explode("files").alias("f")).select("f.*")
    return stats.job_totals(files).select("files", "tables", "rows", (F.col("bytes") > 0).alias("has_bytes"))


def q_progress_rows(spark, sf_dir):
    """What a dump and its load report, table by table."""
    table = ProgressTable(spark, staging_path(spark, "progress"))
    out = staging_path(spark, "progress-dump") + "/dump"
    write_dump(TableSet.from_dir(spark, sf_dir, SHOP + REF), out, "mysql", progress=table)
    load_dump(spark, out, "mysql", progress=table)
    return table.read().select("job", "phase", "table_name", "total", "rows")


def q_catalog_roundtrip(spark, sf_dir):
    """Tables of the session catalog; orders is replaced by rows that are read from itself."""
    ns = f"tablecraft_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {ns} LOCATION '{staging_path(spark, 'catalog')}'")
    TableSet.from_dir(spark, sf_dir, SHOP).save_to_catalog(ns)
    held = TableSet.from_catalog(spark, ns)
    o = held["orders"]
    TableSet({"orders": o.where("o_orderstatus = 'F'").unionByName(o.where("o_totalprice > 1000"))}).save_to_catalog(ns, if_exists="replace")
    return stats.row_counts(TableSet.from_catalog(spark, ns)).select("name", "row_count")


def _sync_sides(spark, sf_dir):
    from .examples import sync_src, sync_tgt

    return sync_src(spark, sf_dir), sync_tgt(spark, sf_dir)


def q_sync_by_digest(spark, sf_dir):
    src, tgt = _sync_sides(spark, sf_dir)
    ch = digest.sync_by_digest(src, tgt, SYNC_KEYS, levels=(4, 10))
    return ch.select(*SYNC_KEYS, "action", F.col("new_row.o_totalprice").alias("new_price"), F.col("old_row.o_totalprice").alias("old_price"))


def q_load_resumed(spark, sf_dir):
    """A load in small steps that is stopped after each, over plain and compressed files, and then left one file twice."""
    o = _read(spark, sf_dir, "orders")
    src, out, ledger = (staging_path(spark, f"resumed-{x}") for x in ("dump", "out", "ledger"))
    write_dump(TableSet({"orders": o.where("o_custkey % 2 = 0")}), f"{src}/a", "mysql", batch=100)
    write_dump(TableSet({"orders": o.where("o_custkey % 2 = 1")}), f"{src}/b", "mysql", batch=100, codec="zstd")
    size = max(s for _, s in fs.list_files(src))
    step = dict(schemas={"orders": o.schema}, out=out, ledger=ledger, batch=10, step_bytes=size - 1, step_batches=8, most_steps=2)
    while not load_journaled(spark, src, **step):
        pass
    load_journaled(spark, src, **step)  # nothing is left to do
    return read_journaled(spark, "orders", o.schema, out, ledger)


def q_page_at(spark, sf_dir):
    """A page deep in lineitem: one range of many is read."""
    index = paging.page_index(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], staging_path(spark, "pages") + "/index", ranges=20)
    return index.page(100, 50)


def q_stream_latest_upsert(spark, sf_dir):
    """The newest event per user after two micro-batches, one of them done again."""
    e = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    src, out = staging_path(spark, "latest-in"), staging_path(spark, "latest-out")
    halves = [e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")]
    for i, half in enumerate(halves):
        half.write.parquet(f"{src}/{i}")
    stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    streams.run_latest_to_table(stream, out, staging_path(spark, "latest-ckpt"), "user_id", "ts")
    streams.upsert_latest(spark, halves[1], 1_000_000, out, "user_id", "ts")
    streams.upsert_latest(spark, halves[1], 1_000_000, out, "user_id", "ts")
    return streams.read_latest(spark, out, e.schema)


def q_replication_lag(spark, sf_dir):
    """Users as replicas (odd ones) and primaries; errors never replayed anything."""
    e = _read(spark, sf_dir, "events")
    replay = F.when(F.col("event_type") != "error", F.col("ts"))
    return e.select("event_id", fmt.replication_lag(F.col("user_id") % 2 == 1, replay, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).alias("lag_seconds"))


def q_schedules_json(spark, sf_dir):
    """Nations as schedules: written as a JSON document by each region, read back."""
    n = _read(spark, sf_dir, "nation")
    due = F.when(F.col("n_nationkey") > 5, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n_nationkey") * 60))
    rows = n.select("n_regionkey", F.struct(F.col("n_name").alias("id"), F.lit("shop").alias("database"), (F.col("n_nationkey") % 2 == 0).alias("enabled"), F.lit("daily").alias("interval"), F.col("n_nationkey").cast("int").alias("retain_count"), due.alias("next_run")).alias("s"))
    docs = rows.groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list("s").alias("schedules"))).alias("value"))
    out = staging_path(spark, "schedules")
    docs.repartitionByRange("n_regionkey").write.partitionBy("n_regionkey").text(out)  # a file for each region
    return retention.read_schedules(spark, out).select("id", "database", "enabled", "interval", "retain_count", F.unix_seconds("next_run").alias("next_run"))


def q_ddl_defaults(spark, sf_dir):
    """Definitions with defaults and lengths, written (K4), renamed (F21) and read back by a load of all customers."""
    c = _read(spark, sf_dir, "customer")
    out = staging_path(spark, "ddl-defaults")
    ddl = create_table_sql(c.select("c_custkey", "c_name", "c_mktsegment").schema, "customer", "mysql", ["c_custkey"], {"c_mktsegment": "'NONE, (yet)'"}, {"c_mktsegment": 20})
    fs.write_bytes(f"{out}/00.sql", rename_table(ddl, "customer", "people").encode())
    write_text(c.select(F.concat(F.lit("INSERT INTO people (c_custkey, c_name) VALUES ("), F.col("c_custkey"), F.lit(", "), sql_literal(F.col("c_name"), c.schema["c_name"].dataType, "mysql"), F.lit(");")).alias("stmt")), f"{out}/data")
    return load_dump(spark, out, "mysql").tables["people"]


QUERIES = {
    "replication_lag": q_replication_lag, "schedules_json": q_schedules_json, "ddl_defaults": q_ddl_defaults,
    "index_sizes": q_index_sizes, "rename_lookup": q_rename_lookup, "job_totals": q_job_totals, "progress_rows": q_progress_rows, "catalog_roundtrip": q_catalog_roundtrip,
    "sync_by_digest": q_sync_by_digest, "load_resumed": q_load_resumed, "page_at": q_page_at, "stream_latest_upsert": q_stream_latest_upsert,
}

_COUNT = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in SHOP + REF)
_TOTAL = " + ".join(f"(SELECT count(*) FROM {t})" for t in SHOP + REF)

SQL = {
    "replication_lag": """SELECT event_id, CASE WHEN user_id % 2 = 1 AND event_type <> 'error' THEN date_diff('microsecond', ts, TIMESTAMP '2030-01-01 00:00:00') / 1e6 ELSE 0.0::DOUBLE END AS lag_seconds FROM events""",
    "schedules_json": """SELECT n_name AS id, 'shop' AS database, n_nationkey % 2 = 0 AS enabled, 'daily' AS interval, CAST(n_nationkey AS INTEGER) AS retain_count,
                                CASE WHEN n_nationkey > 5 THEN CAST(1700000000 + n_nationkey * 60 AS BIGINT) END AS next_run FROM nation""",
    "ddl_defaults": "SELECT c_custkey, c_name, 'NONE, (yet)' AS c_mktsegment FROM customer",
    "index_sizes": """SELECT n_name AS table_name, c_name AS index_name, CAST(round(c_acctbal * 100) AS BIGINT) AS size
                      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'""",
    "rename_lookup": "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS target FROM orders",
    "job_totals": f"SELECT CAST(2 AS BIGINT) AS files, CAST(7 AS BIGINT) AS tables, CAST({_TOTAL} AS BIGINT) AS rows, true AS has_bytes",
    "progress_rows": f"SELECT job, 'table' AS phase, name AS table_name, CAST(7 AS BIGINT) AS total, n AS rows FROM ({_COUNT}), (VALUES ('dump'), ('load')) j(job)",
    "catalog_roundtrip": """SELECT 'customer' AS name, count(*) AS row_count FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem
                            UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus = 'F') + count(*) FILTER (o_totalprice > 1000) FROM orders""",
    "load_resumed": "SELECT * FROM orders",
    "page_at": "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET 5000",
    "stream_latest_upsert": "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id",
}
