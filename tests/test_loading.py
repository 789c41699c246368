"""Loads lose nothing silently: foreign statement forms, rejects, odd names and bytes, empty dumps, file systems."""
import os
import tempfile

import pyarrow.fs as pafs
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.ddl import parse_create_table
from tablecraft.operators import bulk, health
from tablecraft.plans import backup
from tablecraft.plans.dump import render_inserts_ordered, write_dump
from tablecraft.plans.load import load_dump
from tablecraft.sources import fs
from tablecraft.sources.inserts import parse_insert, table_name
from tablecraft.tableset import TableSet

AB = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def put(text, name="dump.sql"):
    d = tempfile.mkdtemp(prefix="load-")
    with open(os.path.join(d, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return d


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_statement_forms():
    got = parse_insert("INSERT INTO public.t VALUES (1, E'a\\n\\'b', 'x'::text, '2020-01-01'::timestamp without time zone, 3::numeric(10,2)) ON CONFLICT DO NOTHING;", "postgres")
    assert got == (None, [["1", "a\n'b", "x", "2020-01-01", "3"]])
    assert parse_insert("REPLACE INTO `d`.`t` VALUE (1, _binary 'a\\'b', 0xDEAD) ON DUPLICATE KEY UPDATE a = 1", "mysql")[1] == [["1", "a'b", "\x01xDEAD"]]
    assert table_name('"s"."b""c"') == 'b"c' and table_name("x . `y``z`") == "y`z"


def test_no_form_of_insert_vanishes(spark):
    text = """INSERT INTO public.t VALUES (1,'a');
INSERT INTO "public"."t" (b, a) VALUES ('b', 2);
INSERT IGNORE INTO db.t VALUES (3,'c');
REPLACE INTO t VALUES (4,'d');
INSERT INTO `t` VALUES (5, X'65');
"""
    assert rows(load_dump(spark, put(text), "mysql", schemas={"t": AB}).tables["t"]) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_unloaded_statements_are_rejects(spark):
    text = "INSERT INTO t VALUES (1,'a');\nINSERT INTO t VALUES (2,;\nINSERT INTO u VALUES (3);\nUPDATE t SET a = 1;\nSET x = 1;\nINSERT INTO t VALUES ('no','b');\n"
    with pytest.raises(ValueError, match="batch 0"):
        load_dump(spark, put(text), "mysql", schemas={"t": AB})
    res = load_dump(spark, put(text), "mysql", schemas={"t": AB}, batch=1, on_error="skip")
    assert rows(res.tables["t"]) == [(1, "a")]
    got = {r["stmt_no"]: (r["table"], r["batch_id"], r["stmt"].strip()) for r in res.rejects.collect()}
    assert got == {1: ("t", 1, "INSERT INTO t VALUES (2,;"), 2: (None, 2, "INSERT INTO u VALUES (3);"), 3: (None, 3, "UPDATE t SET a = 1;"), 5: ("t", 5, "INSERT INTO t VALUES ('no','b');")}
    assert res.totals().collect()[0].asDict()["errors"] == 4
    # INSERTs of tables that were not asked for are no rejects
    only = load_dump(spark, put("INSERT INTO t VALUES (1,'a');\nINSERT INTO u VALUES (3);\n"), "mysql", tables=["t"], schemas={"t": AB})
    assert rows(only.tables["t"]) == [(1, "a")]


def test_tables_named_by_numbers_stay_apart(spark):
    one = T.StructType([T.StructField("a", T.LongType())])
    t = load_dump(spark, put("INSERT INTO `1` VALUES (1);\nINSERT INTO `01` VALUES (2);\n"), "mysql", schemas={"1": one, "01": one}).tables
    assert rows(t["1"]) == [(1,)] and rows(t["01"]) == [(2,)]


def test_bytes_are_never_replaced(spark):
    d = put(b"INSERT INTO t VALUES (1,'caf\xe9');\n")
    with pytest.raises(Exception, match="not utf-8"):
        load_dump(spark, d, "mysql", schemas={"t": AB})
    assert rows(load_dump(spark, d, "mysql", schemas={"t": AB}, encoding="latin-1").tables["t"]) == [(1, "caf\u00e9")]


def test_no_dump_file_is_skipped_by_name(spark):
    assert rows(load_dump(spark, put("INSERT INTO t VALUES (1,'a');", "_data.sql"), "mysql", schemas={"t": AB}).tables["t"]) == [(1, "a")]


def test_hex_and_binary_values(spark):
    s = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.BinaryType())])
    my = load_dump(spark, put("INSERT INTO t VALUES (X'0141', '\\\\x41');\nINSERT INTO t VALUES ('\\\\x41', 0x41);"), "mysql", schemas={"t": s}).tables["t"]
    assert rows(my) == [("\x01A", b"\\x41"), ("\\x41", b"A")]
    pg = load_dump(spark, put("INSERT INTO t VALUES ('\\x41', '\\x41');"), "postgres", schemas={"t": s}).tables["t"]
    assert rows(pg) == [("\\x41", b"A")]


def test_create_table_texts():
    t = parse_create_table("""CREATE TABLE IF NOT EXISTS `db`.`t x` (`id` bigint unsigned NOT NULL AUTO_INCREMENT, `ok` tinyint(1) DEFAULT '1', `n` int(11), `p` decimal(10,2) DEFAULT '0.00',
      `e` enum('a,b','c)') COMMENT 'x, (y', `at` datetime(6), `raw` varbinary(16), PRIMARY KEY (`id`), KEY `k` (`n`), CONSTRAINT `f` FOREIGN KEY (`n`) REFERENCES u (`id`)) ENGINE=InnoDB""")
    assert t.name == "t x" and t.primary_key == ["id"] and t.defaults == {"ok": "'1'", "p": "'0.00'"}
    assert [f.dataType.simpleString() for f in t.schema] == ["decimal(20,0)", "boolean", "int", "decimal(10,2)", "string", "timestamp_ntz", "binary"]
    p = parse_create_table("CREATE TABLE public.t (id integer DEFAULT nextval('s'::regclass) PRIMARY KEY, v character varying(5) DEFAULT 'x'::character varying, d double precision, a text[], z timestamp with time zone)", "postgres")
    assert [f.dataType.simpleString() for f in p.schema] == ["int", "string", "double", "string", "timestamp"] and p.primary_key == ["id"] and "id" not in p.defaults
    assert parse_create_table("INSERT INTO t VALUES (1)") is None


def test_wide_rows_keep_statements_small(spark):
    df = spark.range(40).select(F.col("id"), F.repeat(F.lit("x"), 100_000).alias("b"))
    st = render_inserts_ordered(df, "t", "id", "mysql", 1000, max_bytes=1 << 20).collect()
    assert sum(r["rows"] for r in st) == 40 and max(len(r["stmt"]) for r in st) < 2 << 20
    out = tempfile.mkdtemp(prefix="wide-") + "/d"
    write_dump(TableSet({"t": df}), out, "mysql", order_by={"t": "id"})
    assert load_dump(spark, out, "mysql").tables["t"].exceptAll(df).count() == 0


def test_backups(spark):
    root = tempfile.mkdtemp(prefix="backups-")
    assert backup.read_backups(spark, root + "/none").collect() == [] and backup.read_backups(spark, root).collect() == []
    man = backup.create_backup([TableSet({"t": spark.range(1000).withColumn("v", F.col("id") * 2)}, name="db")], root)
    assert backup.restore_backup(spark, root, man["id"])["db"]["t"].count() == 1000
    part = next(p for p, _ in fs.list_files(f"{root}/{man['id']}") if "/data/part-" in p)
    data = fs.read_bytes(part)
    fs.write_bytes(part, data.replace(b"(10, 20)", b"(10, 20"))
    with pytest.raises(ValueError):
        backup.restore_backup(spark, root, man["id"])
    backup.delete_backup(root, man["id"])
    assert backup.read_backups(spark, root).collect() == []
    with pytest.raises(KeyError):
        backup.delete_backup(root, man["id"])


def test_paths_keep_their_file_system(monkeypatch, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.sql").write_text("SELECT 1;")
    local = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    opened = []

    class Stub:
        @staticmethod
        def from_uri(uri):
            opened.append(uri)
            return local, uri.split("://", 1)[1]

    monkeypatch.setattr(fs.pafs, "FileSystem", Stub)
    assert fs.list_files("s3a://d") == [("s3://d/x.sql", 9)]
    assert fs.read_range("s3://d/x.sql", 0, 6) == b"SELECT" and opened[-1] == "s3://d/x.sql"
    assert fs._normal("hdfs:/a/b") == "hdfs:///a/b" and fs.prefix_of("/a/b") == ""


def test_staging_needs_a_shared_folder():
    from tablecraft import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake())


def test_sync_is_null_safe_and_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, None, "x"), (None, 2, "y"), (3, 3, None)], "k1 int, k2 int, v string")
    assert {r["action"] for r in bulk.sync_changes(a, a, ["k1", "k2"]).collect()} == {"same"}
    with pytest.raises(ValueError, match="duplicate key"):
        bulk.sync_changes(a.union(a), a, ["k1", "k2"])


def test_writes_check_all_targets_and_swap(spark):
    root = tempfile.mkdtemp(prefix="clone-")
    ts = TableSet({"a": spark.range(3), "b": spark.range(5)})
    bulk.copy_into(spark.range(1), root, "b")
    with pytest.raises(FileExistsError):
        bulk.clone(ts, root)
    assert not os.path.exists(f"{root}/a.parquet")
    out = bulk.clone(ts, root, if_exists="replace")
    again = bulk.write_tables({"b": out["b"].union(out["b"])}, root, if_exists="replace")
    assert again["b"].count() == 10


def test_newest_snapshot_decides(spark):
    def snap(server, ts, **kv):
        return [Row(server=server, ts=ts, name=k, value=str(v)) for k, v in kv.items()]

    data = snap(1, 1, Slave_IO_Running="Yes", Slave_SQL_Running="Yes", Seconds_Behind_Master=9) + snap(1, 2, Slave_IO_Running="No", Slave_SQL_Running="Yes", Seconds_Behind_Master=500)
    data += snap(2, 1, replicas=2) + snap(3, 1, in_recovery="t", replay_lag_seconds=5) + snap(4, 1, wsrep_cluster_size=3, wsrep_ready="ON", wsrep_connected="ON") + snap(4, 2, uptime=1)
    got = {r["server"]: (r["type"], r["role"], r["is_primary"], r["is_healthy"], r["lag_seconds"]) for r in health.cluster_health(spark.createDataFrame(data)).collect()}
    assert got == {1: ("replication", "replica", False, False, 500.0), 2: ("replication", "master", True, True, 0.0), 3: ("postgres_streaming", "standby", False, True, 5.0), 4: ("standalone", "standalone", True, True, 0.0)}


def test_rejects_never_broadcast_the_dump(spark):
    src = put("".join(f"INSERT INTO t VALUES ({'x' if i % 50 == 7 else i},'b{i}');\n" for i in range(500)).replace("(x,", "('x',"))
    res = load_dump(spark, src, schemas={"t": AB}, batch=1, on_error="skip")
    got = res.rejects.select("stmt_no", "stmt")
    assert sorted((r.stmt_no, r.stmt.strip()) for r in got.collect()) == [(i, f"INSERT INTO t VALUES ('x','b{i}');") for i in range(7, 500, 50)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
