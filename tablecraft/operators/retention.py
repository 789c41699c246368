"""W1 backup retention, P9 due schedules and F13 next-run arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import fs


def retention_plan(backups: DataFrame, retain: int | DataFrame, id_col: str = "id", ts_col: str = "timestamp",
                   dbs_col: str = "databases") -> DataFrame:
    """Per database keep the newest N backups; a set expires only when every
    database in it is beyond its own N (D20). N <= 0 keeps everything.

    ``retain`` is one N for all databases or a frame (database, retain).

    Plan: the N-th newest (timestamp, id) per database comes from a
    ``row_number <= N`` filter, which Spark executes as a partial
    WindowGroupLimit before the shuffle, so a database with a third of all
    backups still ships at most N rows per map task. Every backup is then
    compared with its database's threshold, and the set verdict is a
    ``bool_and`` per backup id. The backups are dealt by id first, so that what
    a task sorts and groups is a share of them however few files they are in,
    and the verdict needs no further shuffle.
    """
    n = int(backups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = backups.select(id_col, ts_col, dbs_col).repartition(n, id_col, ts_col)
    ex = dealt.select(id_col, ts_col, F.explode(F.array_distinct(F.col(dbs_col))).alias("database"))
    if isinstance(retain, int):
        limit = retain
        ex = ex.withColumn("retain", F.lit(retain))
    else:
        limit = retain.agg(F.max("retain")).first()[0] or 0  # one scalar
        ex = ex.join(F.broadcast(retain.select("database", F.col("retain").cast("int").alias("retain"))), "database", "left").withColumn(
            "retain", F.coalesce(F.col("retain"), F.lit(0))
        )
    key = F.struct(F.col(ts_col), F.col(id_col))
    if limit > 0:
        w = Window.partitionBy("database").orderBy(F.col(ts_col).desc(), F.col(id_col).desc())
        top = ex.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).where(F.col("rn") <= F.col("retain"))
        thr = top.groupBy("database").agg(F.min(F.struct(ts_col, id_col)).alias("thr"), F.count(F.lit(1)).alias("kept"))
        j = ex.join(F.broadcast(thr), "database", "left")  # a row per database
        expired = (F.col("retain") > 0) & (F.col("kept") >= F.col("retain")) & (key < F.col("thr"))
    else:
        j = ex
        expired = F.lit(False)
    per = j.select(id_col, ts_col, F.coalesce(expired, F.lit(False)).alias("expired"))
    out = per.groupBy(id_col, ts_col).agg(F.bool_and("expired").alias("expire"))
    return out.select(id_col, ts_col, F.when(F.col("expire"), "delete").otherwise("keep").alias("action"))


# Schedule intervals and their steps in hours (monthly is calendar based).
INTERVAL_HOURS = {"hourly": 1, "daily": 24, "weekly": 168}


def add_month_normalized(ts: Column) -> Column:
    """One calendar month later with day overflow carried forward (Jan 31 -> Mar 2/3),
    i.e. first of the month + 1 month + (day - 1) days, time of day kept."""
    first = F.date_trunc("month", ts)
    tod = ts - F.date_trunc("day", ts)
    return first + F.make_ym_interval(F.lit(0), F.lit(1)) + F.make_dt_interval(F.dayofmonth(ts) - 1) + tod


def next_run(ts: Column, interval: Column) -> Column:
    """+1h, +24h, +168h, +1 month (normalised); anything else +24h."""
    out = ts + F.make_dt_interval(F.lit(1))
    for name, hours in INTERVAL_HOURS.items():
        out = F.when(interval == name, ts + F.make_dt_interval(F.lit(0), F.lit(hours))).otherwise(out)
    return F.when(interval == "monthly", add_month_normalized(ts)).otherwise(out)


def due_schedules(df: DataFrame, now: Column, enabled: str = "enabled", next_col: str = "next_run",
                  interval: str = "interval") -> DataFrame:
    """Enabled schedules whose next run is set and before ``now``, with the following run."""
    due = df.where(F.col(enabled) & F.col(next_col).isNotNull() & (F.col(next_col) < now))
    return due.withColumn("following_run", next_run(F.col(next_col), F.col(interval)))


# schedules as a JSON document {"schedules": [...]}; fields that are empty may be left out.
SCHEDULE_SCHEMA = (
    "id string, database string, enabled boolean, interval string, compression string, retain_count int, "
    "last_run timestamp, next_run timestamp, profile string, created_at timestamp, updated_at timestamp"
)


def read_schedules(spark: SparkSession, path: str) -> DataFrame:
    """one row per schedule of the JSON files at ``path``; no file, no schedules. Unreadable JSON is an error.

    A time that was never set (year 1) is null, as one that is left out.
    """
    if not fs.exists(path):
        return spark.createDataFrame([], SCHEDULE_SCHEMA)
    files = [p for p, _ in fs.list_files(path)]
    if not files:
        return spark.createDataFrame([], SCHEDULE_SCHEMA)
    doc = spark.read.schema(f"schedules array<struct<{SCHEDULE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).option("mode", "FAILFAST").json(files)
    rows = doc.select(F.explode("schedules").alias("s")).select("s.*")
    return rows.withColumns({c: F.when(F.year(c) > 1, F.col(c)) for c in ("last_run", "next_run")})


def schedules_json(df: DataFrame) -> DataFrame:
    """one JSON text per schedule (column value); null fields are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
