import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tablecraft.functions import formats as fmt
from tablecraft.operators import bulk, retention, stats
from tablecraft.operators.sequence import with_sequence
from tablecraft.sources.jdbc import jdbc_options
from tablecraft.tableset import TableSet, page_bounds


def test_month_rule_normalises(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 31, 10, 30),), (dt.datetime(2024, 1, 31, 0, 0),), (dt.datetime(2024, 12, 15, 1, 2, 3),)], "ts timestamp_ntz")
    got = [r[0] for r in df.select(retention.next_run(F.col("ts"), F.lit("monthly"))).collect()]
    assert got == [dt.datetime(2025, 3, 3, 10, 30), dt.datetime(2024, 3, 2, 0, 0), dt.datetime(2025, 1, 15, 1, 2, 3)]
    other = df.select(retention.next_run(F.col("ts"), F.lit("weekly")), retention.next_run(F.col("ts"), F.lit("?"))).first()
    assert other[0] == dt.datetime(2025, 2, 7, 10, 30) and other[1] == dt.datetime(2025, 2, 1, 10, 30)


def test_retention_sets_expire_only_when_all_databases_do(spark):
    rows = [(f"b{i}", dt.datetime(2024, 1, i + 1), ["a"] if i < 5 else ["a", "b"]) for i in range(8)]
    df = spark.createDataFrame(rows, "id string, timestamp timestamp, databases array<string>")
    plan = {r.id: r.action for r in retention.retention_plan(df, 2).collect()}
    # a keeps b7, b6; b keeps b7, b6 too; b5 is beyond N in both -> delete
    assert [k for k, v in sorted(plan.items()) if v == "keep"] == ["b6", "b7"]
    assert {r.action for r in retention.retention_plan(df, 0).collect()} == {"keep"}


def test_merge_policies_and_collisions(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([("y", 2)], "v string, id int")
    t = TableSet({"t": a}, name="main")
    s = TableSet({"t": b.select("id", "v"), "u": a}, name="src")
    assert bulk.merge(t, [s], "skip")["t"].count() == 1
    assert sorted(bulk.merge(t, [s], "append")["t"].collect()) == [(1, "x"), (2, "y")]
    assert set(bulk.merge(t, [s], "rename").names()) == {"t", "u", "t_src"}
    assert bulk.merge(t, [s], lambda table, src: "replace")["t"].first().id == 2
    with pytest.raises(ValueError):
        bulk.merge(TableSet({"t": a, "t_src": a}, "m"), [s], "rename")
    with pytest.raises(Exception):
        bulk.append(a, spark.createDataFrame([(1,)], "id int")).collect()


def test_sync_and_duplicate_keys(spark):
    src = spark.createDataFrame([(1, "a"), (2, None), (4, "d")], "k int, v string")
    tgt = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    ch = bulk.sync_changes(src, tgt, ["k"])
    assert {r.k: r.action for r in ch.collect()} == {1: "same", 2: "update", 3: "delete", 4: "insert"}
    assert sorted(bulk.sync_apply(ch, ["k"]).collect()) == sorted(src.collect())
    with pytest.raises(ValueError):
        bulk.sync_changes(src.union(src), tgt, ["k"], verify_keys=True)


def test_sequence_is_dense_and_ordered(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = with_sequence(df, "k", partitions=5).collect()
    assert sorted((r.seq, r.k) for r in rows) == [(i, i) for i in range(1000)]


def test_formats(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 * 1024**3,)], "b long")
    r = df.select(fmt.format_size(F.col("b")), fmt.format_bytes(F.col("b")), fmt.format_uptime(F.col("b"))).collect()
    assert [x[0] for x in r] == ["0 B", "1023 B", "1.50 KB", "5.00 GB"]
    assert [x[1] for x in r] == ["0 B", "1023 B", "1.5 KB", "5.0 GB"]
    assert r[2][2] == "25m" and r[0][2] == "0m"
    one = spark.createDataFrame([("16/B374D848", "16/B374D840", "/x/db.sql.zst", " 12abc")], "a string, b string, p string, t string")
    v = one.select(fmt.lsn_diff(F.col("a"), F.col("b")).cast("long"), fmt.database_from_path(F.col("p")), fmt.text_to_long(F.col("t"))).first()
    assert tuple(v) == (8, "db", 12)


def test_stats_helpers(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "name string, size long")
    assert {r.pct for r in stats.share_of_max(df, "size").collect()} == {0.0}
    assert stats.exists(df, F.col("name") == "b") and not stats.exists(df, F.col("name") == "z")
    assert page_bounds(100, 50, 1)["text"] == "51-100 of 100" and page_bounds(100, 50)["last_page"] == 1


def test_jdbc_options():
    o = jdbc_options("postgres", "public.orders", host="db", database="shop", partition_column="o_orderkey", lower_bound=0, upper_bound=100, num_partitions=4)
    assert o["url"] == "jdbc:postgresql://db:5432/shop" and o["numPartitions"] == "4"
    with pytest.raises(ValueError):
        jdbc_options("mysql", "t", partition_column="id")


def test_base_tables_and_column_keys(spark):
    cat = spark.createDataFrame(
        [("public", "b", "BASE TABLE", "nextval('b_id_seq')"), ("public", "a", "BASE TABLE", None), ("public", "v", "VIEW", "0"), ("other", "c", "BASE TABLE", "1")],
        "table_schema string, table_name string, table_type string, dflt string",
    )
    assert [r.table_name for r in stats.base_tables(cat).collect()] == ["a", "b"]
    keys = {r.table_name: r.k for r in cat.select("table_name", fmt.column_key(F.col("dflt")).alias("k")).collect()}
    assert keys == {"b": "PRI", "a": "", "v": "MUL", "c": "MUL"}


def test_uptime_seconds(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 1, 1, 600000))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(fmt.uptime_seconds(F.col("a"), F.col("b"))).first()[0] == 62


def test_run_sql_classifies(spark):
    from tablecraft.tableset import is_read, run_sql

    assert is_read("  select 1") and is_read("WITH x AS (SELECT 1) SELECT * FROM x", cte_as_read=True)
    assert not is_read("WITH x AS (SELECT 1) SELECT * FROM x") and not is_read("insert into t values (1)")
    kind, df = run_sql(spark, "SELECT 41 + 1 AS v")
    assert kind == "read" and df.first().v == 42


def test_backup_is_atomic_and_restores(spark, sf, tmp_path):
    from tablecraft.plans import backup
    from tablecraft.sources import fs

    o = spark.read.parquet(f"{sf}/orders.parquet")
    good = TableSet({"orders": o}, name="shop")
    bad = TableSet({"broken": o.select(F.raise_error(F.lit("boom")).alias("x"))}, name="broken")
    root = str(tmp_path / "backups")
    with pytest.raises(Exception):
        backup.create_backup([good, bad], root)
    assert fs.list_dirs(root) == []  # the half-written set was removed
    man = backup.create_backup([good], root, description="ok")
    assert [r.id for r in backup.read_backups(spark, root).collect()] == [man["id"]]
    back = backup.restore_backup(spark, root, man["id"], rename={"shop": "copy"})["copy"]["orders"]
    assert back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0
    with pytest.raises(KeyError):
        backup.restore_backup(spark, root, man["id"], databases=["nope"])


def test_table_changes(spark):
    a = TableSet({"t": spark.createDataFrame([(1,)], "id int"), "new": spark.createDataFrame([(1,)], "x int"),
                  "same": spark.createDataFrame([(1,)], "y int")}, name="a")
    b = TableSet({"t": spark.createDataFrame([(1,)], "id long"), "same": spark.createDataFrame([(2,)], "y int")}, name="b")
    assert bulk.table_changes(a, b) == {"created": ["new"], "modified": ["t"], "skipped": ["same"]}


def test_retention_deals_backups_before_it_sorts_them(spark):
    rows = [(i, i % 7, ["a", "b"][: 1 + i % 2]) for i in range(40)] + [(3, 3, ["a"]), (None, 3, ["b"])]
    df = spark.createDataFrame(rows, "id long, timestamp long, databases array<string>").coalesce(1)
    per = spark.createDataFrame([("a", 2), ("b", 3)], "database string, retain int")
    for retain in (2, per):
        plan = retention.retention_plan(df, retain)
        got = sorted((r.id if r.id is not None else -1, r.timestamp, r.action) for r in plan.collect())
        n = {"a": 2, "b": 2 if retain == 2 else 3}
        at = lambda r: (r[1], -1 if r[0] is None else r[0])
        newest = {d: sorted({at(r) for r in rows if d in r[2]}, reverse=True)[n[d] - 1] for d in "ab"}
        want = {}
        for r in rows:
            want.setdefault(at(r), []).extend(at(r) < newest[d] for d in r[2])
        assert got == sorted((k[1], k[0], "delete" if all(v) else "keep") for k, v in want.items())
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"hashpartitioning\(id#.*?\), (\w+)", text)) == {"REPARTITION_BY_NUM"}
