"""What a dump leaves in its tables: namespaces, dropped and created tables, defaults, repeated keys, executable comments."""
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_loading import AB, put, rows

from tablecraft.functions.ddl import moves, parse_create_table, scope_of
from tablecraft.operators.upsert import last_writes
from tablecraft.plans import scope
from tablecraft.plans.load import load_dump
from tablecraft.sources.inserts import constant, decode_raw, parse_upsert


def load(spark, text, dialect="mysql", **options):
    return {n: rows(df) for n, df in load_dump(spark, put(text), dialect, **options).tables.items()}


def test_two_databases_stay_apart(spark):
    text = "CREATE DATABASE a; USE a; CREATE TABLE t (x int); INSERT INTO t VALUES (1); USE `b`; CREATE TABLE t (x int, y text); INSERT INTO t VALUES (2,'b'); INSERT INTO a.t VALUES (3); USE a; INSERT t VALUES (4);"
    assert load(spark, text) == {"a.t": [(1,), (3,), (4,)], "b.t": [(2, "b")]}
    assert load(spark, text, tables=["b.t"]) == {"b.t": [(2, "b")]}
    # one namespace needs no names, and a table that it does not have is no other's
    one = "CREATE TABLE a.t (x int); INSERT INTO a.t VALUES (1); INSERT INTO b.t VALUES (2);"
    with pytest.raises(ValueError, match="no schema for table t"):
        load(spark, one)
    assert load(spark, one, on_error="skip", batch=1) == {"t": [(1,)]}
    assert load(spark, "CREATE TABLE t (x int); INSERT INTO public.t VALUES (1); SET search_path = s, pg_catalog; CREATE TABLE t (x text); INSERT INTO t VALUES ('2');", "postgres") == {"t": [(1,)], "s.t": [("2",)]}


def test_namespaces_by_blocks(spark):
    rng, ns, want, text = random.Random(2), None, [], []
    for i in range(60):
        if rng.random() < 0.3:
            ns = rng.choice(["a", "b", "pg_catalog"])
            text.append(f"SET search_path TO {ns};")
        else:
            text.append(f"INSERT INTO t VALUES ({i});")
            want.append((i, None if ns == "pg_catalog" else ns))
    from tablecraft.sources.statements import read_statements
    raw = decode_raw(read_statements(spark, put("".join(text)), "postgres"), "postgres")
    for block in (1, 3, 1000):
        got = scope.with_namespace(raw, block).where("_kind IS NULL").select(F.col("_vals")[0].cast("int"), "_use")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_dropped_and_created_again(spark):
    text = """CREATE TABLE t (x int); INSERT INTO t VALUES (1); DROP TABLE IF EXISTS t, other; CREATE TABLE t (y text, z int);
    INSERT INTO t VALUES ('two', 2); CREATE TABLE u LIKE t; INSERT INTO u VALUES ('u', 0); TRUNCATE TABLE t; INSERT INTO t VALUES ('three', 3);
    CREATE TABLE gone (x int); INSERT INTO gone VALUES (1); DROP TABLE gone; CREATE TABLE d (x int); INSERT INTO d VALUES (1); DELETE FROM d;"""
    assert load(spark, text) == {"t": [("three", 3)], "u": [("u", 0)], "d": []}
    assert load(spark, "INSERT INTO t VALUES (1,'a'); TRUNCATE t; INSERT INTO t VALUES (2,'b');", schemas={"t": AB}) == {"t": [(2, "b")]}
    assert load(spark, "CREATE TABLE a.t (x int); INSERT INTO a.t VALUES (1); DROP DATABASE a; CREATE TABLE a.t (x int); INSERT INTO a.t VALUES (2);") == {"t": [(2,)]}
    with pytest.raises(ValueError, match="defined twice"):
        load(spark, "CREATE TABLE t (x int); CREATE TABLE t (y int); INSERT INTO t VALUES (1);")
    with pytest.raises(ValueError, match="RENAME is not loaded"):
        load(spark, "CREATE TABLE t (x int); INSERT INTO t VALUES (1); RENAME TABLE t TO u;")


def test_defaults(spark):
    ddl = "CREATE TABLE t (id int NOT NULL AUTO_INCREMENT, n int DEFAULT 7, v varchar(9) DEFAULT 'it''s', w text, b bit(4) DEFAULT b'101', r int NOT NULL, at datetime DEFAULT CURRENT_TIMESTAMP, PRIMARY KEY (id));"
    text = ddl + "INSERT INTO t (ID, r, AT, W) VALUES (1, 2, NULL, 'x'); INSERT INTO t VALUES (2, DEFAULT, default, DEFAULT, 1, 5, NULL); INSERT INTO t (id, r, at, n) VALUES (3, 0b11, NULL, b'11');"
    assert load(spark, text)["t"] == [(1, 7, "it's", "x", b"\x05", 2, None), (2, 7, "it's", None, b"1", 5, None), (3, 3, "it's", None, b"\x05", 3, None)]
    for bad, why in (("INSERT INTO t (id, r) VALUES (1, 2);", "at is filled by the server"), ("INSERT INTO t (id, at) VALUES (1, NULL);", "r has no default"), ("INSERT INTO t VALUES (DEFAULT,1,'',NULL,1,1,NULL);", "id is filled")):
        with pytest.raises(ValueError, match=why):
            load(spark, ddl + bad)
    with pytest.raises(ValueError, match="no known default"):
        load(spark, "INSERT INTO t VALUES (DEFAULT, 'x');", schemas={"t": AB})
    assert load(spark, "INSERT INTO t (b) VALUES ('x');", schemas={"t": AB}) == {"t": [(None, "x")]}
    assert constant("'a'::text", "postgres") == (True, "a") and constant("now()", "postgres") == (False, None)


def test_upserts(spark):
    ddl = "CREATE TABLE t (id int PRIMARY KEY, v text, n int);"
    assert load(spark, ddl + "REPLACE INTO t VALUES (1,'old',1),(2,'x',2); REPLACE INTO t VALUES (1,'new',3); REPLACE t (id, v) VALUES (2, 'y');")["t"] == [(1, "new", 3), (2, "y", None)]
    assert load(spark, ddl + "INSERT IGNORE INTO t VALUES (1,'first',1); INSERT IGNORE INTO t VALUES (1,'second',2),(2,'b',0);")["t"] == [(1, "first", 1), (2, "b", 0)]
    text = "INSERT INTO t VALUES (1,'a',1); INSERT INTO t VALUES (1,'b',2) ON DUPLICATE KEY UPDATE v = VALUES(v); INSERT INTO t VALUES (1,'c',3) AS new ON DUPLICATE KEY UPDATE N = new.N;"
    assert load(spark, ddl + text)["t"] == [(1, "b", 3)]
    pg = "CREATE TABLE public.t (id int, v text); ALTER TABLE ONLY public.t ADD CONSTRAINT t_pkey PRIMARY KEY (id); INSERT INTO public.t VALUES (1,'a') ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v; INSERT INTO public.t VALUES (1,'b') ON CONFLICT (id) DO UPDATE SET v = EXCLUDED.v; INSERT INTO public.t VALUES (1,'c') ON CONFLICT DO NOTHING;"
    assert load(spark, pg, "postgres") == {"t": [(1, "b")]}
    for bad in ("INSERT INTO t VALUES (1,'b',0);", "INSERT INTO t VALUES (1,'b',0) ON DUPLICATE KEY UPDATE n = n + 1;"):
        with pytest.raises(ValueError, match="there already"):
            load(spark, ddl + "REPLACE INTO t VALUES (1,'a',1);" + bad)
    # a computed update is no matter where its key is new; without a key all rows load
    assert load(spark, ddl + "INSERT INTO t VALUES (1,'b',0) ON DUPLICATE KEY UPDATE n = n + 1;")["t"] == [(1, "b", 0)]
    assert load(spark, "REPLACE INTO t VALUES (1,'a'); REPLACE INTO t VALUES (1,'a');", schemas={"t": AB})["t"] == [(1, "a")] * 2


def test_last_writes_by_hand(spark):
    rng = random.Random(4)
    ops = [(rng.randrange(6), rng.choice(["r", "g", "u"]), i, rng.randrange(100), rng.choice([None, "v", "w"]), rng.choice([["a"], ["b"], ["a", "b"], []])) for i in range(200)]
    held = {}
    for k, mode, _, a, b, sets in ops:
        if k not in held or mode == "r":
            held[k] = [a, b]
        elif mode == "u":
            held[k] = [a if "a" in sets else held[k][0], b if "b" in sets else held[k][1]]
    df = spark.createDataFrame(ops, "k int, mode string, at int, a int, b string, sets array<string>").repartition(5)
    got = last_writes(df, ["k"], ["k", "a", "b"], F.col("at"), sets=F.col("sets")).collect()
    assert {r["k"]: [r["a"], r["b"]] for r in got} == held and {r["first_error"] for r in got} == {None}
    strict = spark.createDataFrame([(1, "r", 0), (1, "i", 1), (1, "i", 2), (2, "i", 0), (2, "g", 1)], "k int, mode string, at int")
    assert sorted(tuple(r) for r in last_writes(strict, ["k"], ["k"], F.col("at")).collect()) == [(1, 1), (2, None)]


def test_executable_comments(spark):
    text = "/*!40101 SET NAMES utf8 */;\n/*!50001 CREATE TABLE t (x int) */;INSERT INTO t VALUES (1);/*!50001 INSERT INTO t VALUES (2) */;/*M! INSERT INTO t VALUES (3)*/; /* INSERT INTO t VALUES (4) */;/*!40000 ALTER TABLE t DISABLE KEYS */;"
    assert load(spark, text) == {"t": [(1,), (2,), (3,)]}
    for chunk in (7, 40):
        assert rows(load_dump(spark, put(text.replace(";", ";\n")), "mysql", chunk_bytes=chunk).tables["t"]) == [(1,), (2,), (3,)]
    assert load(spark, "CREATE TABLE t (x int); INSERT INTO t /*!1*/ VALUES (1);", "postgres") == {"t": [(1,)]}


def test_scope_statements():
    assert scope_of("DROP TABLE IF EXISTS `x`, a.`y;z` CASCADE;").names == [(None, "x"), ("a", "y;z")]
    assert scope_of("truncate table only public.t restart identity cascade").names == [("public", "t")]
    assert scope_of("DELETE FROM t WHERE a = 1") is None and scope_of("DROP VIEW v") is None and scope_of("USER x") is None
    assert moves("ALTER TABLE a.t RENAME TO u") and not moves("ALTER TABLE t RENAME INDEX a TO b") and not moves("ALTER TABLE t ADD x int")
    d = parse_create_table("CREATE TABLE s.t (a serial, b int NOT NULL, c int GENERATED ALWAYS AS (b + 1) STORED, d int NOT NULL DEFAULT 1)", "postgres")
    assert (d.namespace, d.filled, d.required) == ("s", {"a", "c"}, {"b"})
    ins = parse_upsert("INSERT INTO t VALUES (1) ON CONFLICT (a, b) DO UPDATE SET b = excluded.b WHERE t.b < 1", "postgres")
    assert (ins.mode, ins.target) == ("x", ["a", "b"])


def test_namespaces_are_looked_up_once(spark):
    src = put("CREATE TABLE a.t (x bigint);\nCREATE TABLE b.t (y bigint);\n" + "".join(f"USE {'ab'[i % 2]};\nINSERT INTO t VALUES ({i});\n" for i in range(300)))
    tables = load_dump(spark, src).tables
    for k, name in enumerate(("a.t", "b.t")):
        assert rows(tables[name]) == [(i,) for i in range(k, 300, 2)]
        assert "Join" not in tables[name]._jdf.queryExecution().executedPlan().toString()
