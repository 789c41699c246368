"""Digests, ledgers, progress, catalog tables, pages, keyed stream tables, small catalog operators."""
import os
import random
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F
from test_loading import AB, put, rows

from tablecraft.operators import bulk, digest, paging, stats
from tablecraft.plans import journal
from tablecraft.plans.dump import write_dump
from tablecraft.plans.journal import load_journaled, read_journaled, read_ledger
from tablecraft.plans.load import load_dump
from tablecraft.plans.progress import ProgressTable, StreamProgress
from tablecraft.sources import fs
from tablecraft.streaming import jobs
from tablecraft.tableset import TableSet, save_catalog_table


def fresh(name):
    return tempfile.mkdtemp(prefix=name) + "/x"


def test_sync_by_digest_equals_sync(spark):
    rng = random.Random(1)
    ddl = "k1 int, k2 string, v double, w string"
    left = [(i, rng.choice([None, "a"]), rng.choice([None, 1.0, 0.0]), rng.choice([None, "x", ""])) for i in range(300)]
    right = [r if rng.random() < 0.95 else (r[0], r[1], 2.0, r[3]) for r in left if rng.random() < 0.97] + [(None, None, None, None)]
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl).repartition(3)
    want = sorted(bulk.sync_changes(a, b, ["k1", "k2"]).where("action <> 'same'").collect(), key=str)
    for levels in ((2, 6), (12,)):
        assert sorted(digest.sync_by_digest(a, b, ["k1", "k2"], levels).collect(), key=str) == want
    assert digest.sync_by_digest(a, a, ["k1", "k2"]).count() == 0 and digest.differing(a.limit(0), a.limit(0), ["k1"]).count() == 0
    # a value and a null change places
    x, y = spark.createDataFrame([(1, None, 2)], "k int, a int, b int"), spark.createDataFrame([(1, 2, None)], "k int, a int, b int")
    assert [r["action"] for r in digest.sync_by_digest(x, y, ["k"]).collect()] == ["update"]
    with pytest.raises(ValueError, match="different columns"):
        digest.sync_by_digest(x, y.drop("b"), ["k"])
    with pytest.raises(ValueError, match="duplicate key"):
        digest.sync_by_digest(x.union(x), y, ["k"])


def test_only_differing_leaves_are_compared(spark):
    a = spark.range(10_000).withColumn("v", F.col("id") * 2)
    b = a.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    assert digest.differing(a, b, ["id"]).count() == 1
    assert digest._below(a, ["id"], digest.differing(a, b, ["id"], (6, 12)), 12).count() < 20


def test_ledger(spark):
    src, out, ledger = tempfile.mkdtemp(prefix="ledger-"), fresh("out"), fresh("led")
    for name, lo, n in (("a.sql", 0, 5), ("b.sql", 100, 40), ("c.sql", 200, 3)):
        with open(os.path.join(src, name), "w") as f:
            f.write("".join(f"INSERT INTO t VALUES ({lo + i},'x');\n" for i in range(n)))
    options = dict(schemas={"t": AB}, out=out, ledger=ledger, batch=2, step_bytes=300, step_batches=6)
    want = sorted([(x, "x") for x in [*range(5), *range(100, 140), *range(200, 203)]])
    seen = 0
    while not load_journaled(spark, src, **options, most_steps=1):
        got = rows(read_journaled(spark, "t", AB, out, ledger))
        assert len(got) > seen and len(set(got)) == len(got)
        seen = len(got)
    assert rows(read_journaled(spark, "t", AB, out, ledger)) == want
    assert sorted(r["first_batch"] for r in read_ledger(spark, ledger).collect() if r["first_batch"] is not None) == [0, 6, 12, 18]
    # a step that stopped before its entry is done again over what it left; one with an entry is not
    entry = next(p for p, _ in fs.list_files(ledger))
    os.remove(entry)
    assert load_journaled(spark, src, **options) and rows(read_journaled(spark, "t", AB, out, ledger)) == want
    with open(os.path.join(src, "d.sql"), "w") as f:
        f.write("INSERT INTO t VALUES (999,'x');")
    assert load_journaled(spark, src, **options) and rows(read_journaled(spark, "t", AB, out, ledger)) == [*want, (999, "x")]
    with open(os.path.join(src, "a.sql"), "a") as f:
        f.write("INSERT INTO t VALUES (1,'x');")
    with pytest.raises(ValueError, match="changed"):
        load_journaled(spark, src, **options)


def test_progress(spark):
    table = ProgressTable(spark, fresh("progress"))
    assert table.read().count() == 0
    load_dump(spark, put("INSERT INTO t VALUES (1,'a'),(2,'b');"), "mysql", schemas={"t": AB}, progress=table)
    write_dump(TableSet({"t": spark.range(3)}), fresh("d"), "mysql", progress=table)
    assert sorted((r["job"], r["rows"], r["done"], r["total"]) for r in table.read().collect()) == [("dump", 3, 1, 1), ("load", 2, 1, 1)]
    events = []
    listener = StreamProgress(events.append, "watched")
    spark.streams.addListener(listener)
    src = fresh("stream")
    spark.range(5).write.parquet(src)
    q = spark.readStream.schema("id long").parquet(src).writeStream.queryName("watched").format("memory").trigger(availableNow=True).start()
    q.awaitTermination()
    for _ in range(50):
        if any(e.phase == "batch" for e in events):
            break
        import time
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(e.rows for e in events if e.phase == "batch") == 5 and events[0].phase == "started"


def test_catalog_tables(spark):
    ns = f"t_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {ns} LOCATION '{fresh('cat')}'")
    t = save_catalog_table(spark.range(3), ns, "odd_name")
    with pytest.raises(FileExistsError):
        save_catalog_table(spark.range(1), ns, "odd_name")
    assert save_catalog_table(t.union(t), ns, "odd_name", "replace").count() == 6
    assert save_catalog_table(spark.range(2), ns, "odd_name", "append").count() == 8
    assert save_catalog_table(spark.range(2), ns, "odd_name", "skip").count() == 8
    bad = spark.table(f"{ns}.`odd_name`").select(F.raise_error(F.lit("no")).alias("id"))
    with pytest.raises(Exception, match="no"):
        save_catalog_table(bad, ns, "odd_name", "replace")
    assert TableSet.from_catalog(spark, ns).names() == ["odd_name"] and TableSet.from_catalog(spark, ns)["odd_name"].count() == 8
    with pytest.raises(FileExistsError):
        TableSet({"new": spark.range(1), "odd_name": spark.range(1)}).save_to_catalog(ns)
    assert TableSet.from_catalog(spark, ns).names() == ["odd_name"]
    spark.sql(f"DROP DATABASE {ns} CASCADE")


def test_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.col("id").alias("v"))
    index = paging.page_index(df, ["k"], fresh("idx"), ranges=8)
    assert index.total == 1000 and len(index.ranges) > 4
    for no, size in ((0, 50), (7, 50), (3, 300), (19, 50), (20, 50), (0, 5000)):
        assert [r["k"] for r in index.page(no, size).collect()] == list(range(1000))[no * size : (no + 1) * size]
    assert len(index.opened(400, 410)) <= 2 and index.opened(5000, 6000) == []
    assert paging.page_index(df.limit(0), ["k"], fresh("idx")).page(0).count() == 0


def test_newest_row_per_key(spark):
    ddl = "k string, ts int, v int"
    out = fresh("latest")
    batches = [[("a", 1, 1), ("b", 1, 2), (None, 1, 3)], [("a", 2, 4), ("a", 0, 5), ("c", 1, 6)], [("b", 0, 7)], []]
    for i, b in enumerate(batches):
        for _ in range(2):
            jobs.upsert_latest(spark, spark.createDataFrame(b, ddl), i, out, "k", "ts", buckets=3)
    schema = spark.createDataFrame([], ddl).schema
    assert sorted(map(tuple, jobs.read_latest(spark, out, schema).collect()), key=str) == sorted([("a", 2, 4), ("b", 1, 2), (None, 1, 3), ("c", 1, 6)], key=str)
    assert jobs.read_latest(spark, fresh("none"), schema).count() == 0


def test_catalog_operators(spark):
    classes = spark.createDataFrame([(1, "t", 10, 0), (2, "i", 11, 5), (3, "j", 10, 9), (4, "u", 11, 0)], "id int, name string, namespace_id int, size int")
    got = stats.index_sizes(spark.createDataFrame([(2, 1), (3, 1), (3, 4)], "index_id int, table_id int"), classes, spark.createDataFrame([(10, "public"), (11, "x")], "id int, name string"))
    assert [tuple(r) for r in got.collect()] == [("t", "j", 9), ("t", "i", 5)]
    names = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert [r["target"] for r in stats.rename_lookup(names, {"a": "z"}).collect()] == ["z", "b", None] == [r["target"] for r in stats.rename_lookup(names, {"a": "z", "q": "r"}).collect()]
    assert [r["target"] for r in stats.rename_lookup(names, {}).collect()] == ["a", "b", None]
    files = spark.createDataFrame([(10, 2, 5), (1, 1, None)], "size long, tables int, rows long")
    assert stats.job_totals(files).collect()[0].asDict() == {"files": 2, "tables": 3, "rows": 5, "bytes": 11}
    assert stats.job_totals(files.limit(0)).collect()[0].asDict() == {"files": 0, "tables": 0, "rows": 0, "bytes": 0}


def test_definitions_and_schedules(spark):
    from tablecraft.functions.ddl import parse_create_table, rename_table
    from tablecraft.functions.dialect import create_table_sql
    from tablecraft.functions.formats import replication_lag
    from tablecraft.operators import retention

    for dialect in ("mysql", "postgres"):
        text = create_table_sql(AB, "t", dialect, ["a"], {"b": "'x, (y'", "a": "-1"}, {"b": 9})
        d = parse_create_table(text, dialect)
        assert (d.defaults, d.lengths, d.primary_key) == ({"b": "'x, (y'", "a": "-1"}, {"b": 9}, ["a"])
    assert rename_table("CREATE TABLE `d`.`t` (t int)", "t", "u`v") == "CREATE TABLE `d`.`u``v` (t int)"
    assert rename_table("create table if not exists t (t int)", "t", "u") == "create table if not exists u (t int)"
    assert rename_table("CREATE TABLE x (t int)", "t", "u") == "CREATE TABLE x (t int)"
    path = fresh("sched") + ".json"
    assert retention.read_schedules(spark, path).count() == 0
    fs.write_bytes(path, b'{"schedules": [{"id": "a", "enabled": true, "next_run": "0001-01-01T00:00:00Z", "last_run": "2024-01-02T03:04:05Z"}, {"id": "b"}]}')
    got = {r["id"]: (r["enabled"], r["next_run"] is None, r["last_run"] is None) for r in retention.read_schedules(spark, path).collect()}
    assert got == {"a": (True, True, False), "b": (None, True, True)}
    assert [r["value"] for r in retention.schedules_json(spark.createDataFrame([("a", None)], "id string, profile string")).collect()] == ['{"id":"a"}']
    lag = spark.sql("SELECT * FROM VALUES (true, timestamp_ntz'2024-01-01 00:00:00'), (true, null), (false, null) t(r, at)").select(replication_lag(F.col("r"), F.col("at"), F.expr("timestamp_ntz'2024-01-01 00:01:00'")).alias("s"))
    assert sorted(r["s"] for r in lag.collect()) == [0.0, 0.0, 60.0]


def test_ledger_gaps_and_drops(spark):
    """Whichever entry is missing its rows come back, and a DROP in a later file of a step takes nothing away."""
    src, out, ledger = tempfile.mkdtemp(prefix="gaps-"), fresh("out"), fresh("led")
    put = lambda name, text: open(os.path.join(src, name), "w").write(text)
    put("a.sql", "INSERT INTO t VALUES (1,'x');\n")
    put("b.sql", "DROP TABLE IF EXISTS t;\nINSERT INTO t VALUES (2,'x');\n")
    put("c.sql", "".join(f"INSERT INTO t VALUES ({i},'x');\n" for i in range(100, 130)))
    options = dict(schemas={"t": AB}, out=out, ledger=ledger, batch=2, step_bytes=300, step_batches=6)
    want = sorted([(1, "x"), (2, "x")] + [(i, "x") for i in range(100, 130)])
    assert load_journaled(spark, src, **options) and rows(read_journaled(spark, "t", AB, out, ledger)) == want
    for path, _ in fs.list_files(ledger):
        os.remove(path)
        assert load_journaled(spark, src, **options) and rows(read_journaled(spark, "t", AB, out, ledger)) == want


def test_ranges_read_their_own_bytes(spark, monkeypatch):
    """A file's ranges are found once, over all calls, and a range of a plain file reads no more than its bytes."""
    src, out, ledger = tempfile.mkdtemp(prefix="ranges-"), fresh("out"), fresh("led")
    texts = [f"INSERT INTO t VALUES ({i},'{'a;--b' * (i % 4)}'); /* {i}; */\n" for i in range(45)] + [" -- end\n"]
    with open(path := os.path.join(src, "b.sql"), "w") as f:
        f.write("".join(texts))
    whole, read = [], []
    found, dumped = journal.read_statements, journal.load_dump
    monkeypatch.setattr(journal, "read_statements", lambda *a, **b: whole.append(a) or found(*a, **b))
    monkeypatch.setattr(journal, "load_dump", lambda *a, **b: read.append(b.get("ranges")) or dumped(*a, **b))
    options = dict(schemas={"t": AB}, out=out, ledger=ledger, batch=2, step_bytes=300, most_steps=1)
    want = sorted((i, "a;--b" * (i % 4)) for i in range(45))
    while not load_journaled(spark, src, **options, step_batches=6):
        pass
    assert rows(read_journaled(spark, "t", AB, out, ledger)) == want and len(whole) == 1
    bytes_ = [(lo, hi) for ((p, lo, hi, _),) in read]
    assert bytes_[0][0] == 0 and bytes_[-1][1] == os.path.getsize(path) and all(a[1] == b[0] for a, b in zip(bytes_, bytes_[1:])) and len(bytes_) == 4
    # entries are lost and the steps are of another size
    for entry, _ in fs.list_files(ledger)[1:3]:
        os.remove(entry)
    while not load_journaled(spark, src, **options, step_batches=4):
        pass
    assert rows(read_journaled(spark, "t", AB, out, ledger)) == want and len(whole) == 2
