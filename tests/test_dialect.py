import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.dialect import create_table_sql, escape_mysql, looks_binary, quote_ident, sql_literal
from tablecraft.plans.dump import render_inserts, write_dump
from tablecraft.plans.load import load_dump
from tablecraft.plans.textsink import write_text
from tablecraft.sources import fs
from tablecraft.sources.inserts import parse_insert
from tablecraft.sources.statements import read_statements
from tablecraft.tableset import TableSet

EDGE_TEXT = [None, "", "'", '"', "\\", "tail\\", "a\nb", "a\rb", "a\tb", "nul\x00x", "sub\x1ax", ";", "--", "#", "/* */", "NULL", "emoji \U0001F600"]

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("s", T.StringType()),
    T.StructField("b", T.BinaryType()),
    T.StructField("l", T.LongType()),
    T.StructField("d", T.DoubleType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("flag", T.BooleanType()),
    T.StructField("day", T.DateType()),
    T.StructField("arr", T.ArrayType(T.IntegerType())),
])


def edge_frame(spark):
    nums = [0.1, 1e7, 1e21, 1e-5, -0.0, None, 123.456]
    longs = [-(2**63), 2**63 - 1, 0, None]
    rows = []
    for i, s in enumerate(EDGE_TEXT):
        rows.append((
            i, s, (s or "").encode("utf-8") + b"\x00\x01" if s is not None else None,
            longs[i % len(longs)], nums[i % len(nums)],
            dt.datetime(2024, 1, 31, 12, 0, 0, 123456 if i % 2 else 0), i % 3 == 0 if i % 5 else None,
            dt.date(2024, 2, 29), [i, None, -i] if i % 4 else None,
        ))
    return spark.createDataFrame(rows, SCHEMA)


def test_mysql_escape_order(spark):
    df = spark.createDataFrame([("a\\'b\n\x00\x1a\"",)], "s string")
    assert df.select(escape_mysql(F.col("s"))).first()[0] == "a\\\\\\'b\\n\\0\\Z\\\""


def test_literals(spark):
    df = spark.createDataFrame([(None, 5, True, bytearray(b"\x01\xff"), dt.datetime(2024, 1, 1, 1, 2, 3))], "s string, i int, f boolean, b binary, t timestamp_ntz")
    r = df.select(
        sql_literal(F.col("s"), T.StringType()).alias("s"),
        sql_literal(F.col("i"), T.IntegerType()).alias("i"),
        sql_literal(F.col("f"), T.BooleanType(), "mysql").alias("f1"),
        sql_literal(F.col("f"), T.BooleanType(), "postgres").alias("f2"),
        sql_literal(F.col("b"), T.BinaryType(), "mysql").alias("b1"),
        sql_literal(F.col("b"), T.BinaryType(), "postgres").alias("b2"),
        sql_literal(F.col("t"), T.TimestampNTZType()).alias("t"),
        looks_binary(F.col("b")).alias("lb"),
    ).first()
    assert (r.s, r.i, r.f1, r.f2, r.b1, r.b2, r.t, r.lb) == ("NULL", "5", "1", "true", "X'01FF'", "'\\x01FF'", "'2024-01-01 01:02:03'", True)


def test_identifiers_and_ddl():
    assert quote_ident("a`b", "mysql") == "`a``b`"
    assert quote_ident('a"b', "postgres") == '"a""b"'
    ddl = create_table_sql(SCHEMA, "t", "postgres", ["id"])
    assert ddl.startswith('CREATE TABLE "t" (') and 'PRIMARY KEY ("id")' in ddl


def test_parse_insert():
    cols, rows = parse_insert("INSERT INTO `t` (`a`, `b`) VALUES\n(1, 'x\\'y'),\n(NULL, X'0A');")
    assert cols == ["a", "b"] and rows == [["1", "x'y"], [None, "\x01x0A"]]
    cols, rows = parse_insert("insert into \"t\" values (1, 'it''s', true);", "postgres")
    assert cols is None and rows == [["1", "it's", "true"]]


def test_edge_roundtrip_all_dialects_and_codecs(spark):
    df = edge_frame(spark)
    for dialect in ("mysql", "postgres"):
        for codec in (None, "gzip", "zstd", "xz"):
            out = tempfile.mkdtemp(prefix="edge-") + "/dump"
            write_dump(TableSet({"edge": df.repartition(3)}), out, dialect, codec=codec, batch=4)
            back = load_dump(spark, out, dialect, chunk_bytes=97).tables["edge"]
            if dialect == "postgres":  # NUL cannot live in Postgres text; compare the rest
                assert back.count() == df.count()
            else:
                assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0, (dialect, codec)


def test_partition_local_batches(spark):
    df = spark.range(0, 2500, numPartitions=3).withColumnRenamed("id", "k")
    st = render_inserts(df, "t", "mysql", 1000).collect()
    assert sum(r.rows for r in st) == 2500 and max(r.rows for r in st) <= 1000


def test_bad_batches_are_dropped_whole(spark):
    df = spark.range(0, 100).select(F.col("id"), F.when(F.col("id") == 42, F.lit("x")).otherwise(F.col("id").cast("string")).alias("v"))
    out = tempfile.mkdtemp(prefix="bad-") + "/dump"
    write_dump(TableSet({"t": df}), out, "mysql", batch=10, order_by={"t": "id"}, parts=1)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.LongType())])
    res = load_dump(spark, out, "mysql", schemas={"t": schema}, batch=2, on_error="skip")
    ids = sorted(r.id for r in res.tables["t"].collect())
    assert ids == [i for i in range(100) if not 40 <= i < 60]
    assert res.rejects.count() == 1
    import pytest

    with pytest.raises(ValueError):
        load_dump(spark, out, "mysql", schemas={"t": schema}, batch=2)


FOREIGN_DUMP = r"""-- MySQL-style dump of database `shop`
/*!40101 SET @OLD_CHARACTER_SET_CLIENT=@@CHARACTER_SET_CLIENT */;
/*!40101 SET NAMES utf8mb4 */;
DROP TABLE IF EXISTS `t`;
CREATE TABLE `t` (
  `id` bigint NOT NULL,
  `name` varchar(20) DEFAULT NULL, -- trailing comment; with a semicolon
  `price` double DEFAULT NULL,
  `made` datetime DEFAULT NULL,
  PRIMARY KEY (`id`)
);
LOCK TABLES `t` WRITE;
INSERT INTO `t` (`price`, `id`, `name`, `made`) VALUES (1.5,1,'it\'s; -- not a comment','2024-01-31 10:00:00'),(NULL,2,'line\nbreak',NULL),
(-2e3,3,'back\\slash "q"','2024-02-29 23:59:59.5');
INSERT INTO `t` VALUES (4,'four',4,'2024-03-01 00:00:00');
UNLOCK TABLES;
# done
"""


def test_load_foreign_style_dump(spark):
    d = tempfile.mkdtemp(prefix="foreign-")
    with open(os.path.join(d, "shop.sql"), "w") as f:
        f.write(FOREIGN_DUMP)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("price", T.DoubleType()), T.StructField("made", T.TimestampNTZType())])
    res = load_dump(spark, d, "mysql", schemas={"t": schema}, chunk_bytes=64)
    rows = sorted(tuple(r) for r in res.tables["t"].collect())
    assert rows == [
        (1, "it's; -- not a comment", 1.5, dt.datetime(2024, 1, 31, 10, 0)),
        (2, "line\nbreak", None, None),
        (3, 'back\\slash "q"', -2000.0, dt.datetime(2024, 2, 29, 23, 59, 59, 500000)),
        (4, "four", 4.0, dt.datetime(2024, 3, 1)),
    ]
    assert res.outcomes.where("failed").count() == 0


def test_wide_rows_cut_statements_by_bytes(spark):
    wide = spark.range(0, 40, numPartitions=2).select(F.col("id"), F.expr("repeat('x', 100000)").alias("doc"))
    st = render_inserts(wide, "t", "mysql", batch=1000, max_bytes=300000).collect()
    assert sum(r.rows for r in st) == 40
    assert max(len(r.stmt) for r in st) < 300000 + 200000  # never more than the cap plus one row
    assert max(r.rows for r in st) <= 3


def test_compressed_text_of_empty_partitions(spark):
    """A partition without rows writes no file and is no error."""
    df = spark.createDataFrame([("a",), ("b",)], "stmt string").repartition(1)
    mixed = df.unionByName(df.where("stmt = 'none'"))  # the second partition is empty
    for codec in ("zstd", "xz"):
        out = tempfile.mkdtemp(prefix="empty-") + "/x"
        write_text(mixed, out, codec)
        assert len(fs.list_files(out)) == 1
        assert "".join(r.stmt for r in read_statements(spark, out).collect()) == "a\nb\n"
        write_text(df.where("stmt = 'none'"), out + "2", codec)
        assert not fs.exists(out + "2") or fs.list_files(out + "2") == []
