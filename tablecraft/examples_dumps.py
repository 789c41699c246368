"""Queries over dumps as other writers make them: several databases, defaults, repeated keys, tables made anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dialect import insert_prefix, sql_literal
from .plans.dump import render_inserts_ordered
from .plans.load import load_dump
from .plans.textsink import write_text
from .session import staging_path
from .sources import fs
from .sources.statements import read_statements, read_statements_lines


def _read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _values(df: DataFrame, cols: list[str]):
    """The tuple of literals of a row."""
    return F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(F.col(c), df.schema[c].dataType, "mysql") for c in cols]), F.lit(")"))


def q_load_two_databases(spark, sf_dir):
    """One table name in two databases with other columns; every row is written after its own USE."""
    o = _read(spark, sf_dir, "orders")
    out = staging_path(spark, "databases")
    fs.write_bytes(f"{out}/00.sql", b"CREATE TABLE even.orders (o_orderkey bigint, o_custkey bigint, o_totalprice double);\nCREATE TABLE odd.orders (o_totalprice double, o_orderkey bigint);\n")
    even = F.concat(F.lit("USE `even`;\nINSERT INTO orders VALUES "), _values(o, ["o_orderkey", "o_custkey", "o_totalprice"]), F.lit(";"))
    odd = F.concat(F.lit("USE odd;\nINSERT INTO `orders` VALUES "), _values(o, ["o_totalprice", "o_orderkey"]), F.lit(";"))
    write_text(o.select(F.when(F.col("o_custkey") % 2 == 0, even).otherwise(odd).alias("stmt")), f"{out}/data")
    t = load_dump(spark, out, "mysql").tables
    cols = ["o_orderkey", "o_custkey", "o_totalprice"]
    return t["even.orders"].select(F.lit("even").alias("database"), *cols).unionByName(t["odd.orders"].withColumn("o_custkey", F.lit(None).cast("long")).select(F.lit("odd").alias("database"), *cols))


def q_load_defaults(spark, sf_dir):
    """Columns that are left out or given as DEFAULT have the defaults of the dump's CREATE TABLE."""
    e = _read(spark, sf_dir, "events")
    out = staging_path(spark, "defaults")
    fs.write_bytes(f"{out}/00.sql", b"CREATE TABLE events (event_id bigint NOT NULL, user_id bigint, event_type varchar(20) DEFAULT 'it''s a view', value double DEFAULT -1.5, flags bit(8) DEFAULT b'101', note text);\n")
    left_out = F.concat(F.lit("INSERT INTO events (value, event_id, user_id) VALUES "), _values(e, ["value", "event_id", "user_id"]), F.lit(";"))
    given = F.concat(F.lit("INSERT INTO events VALUES ("), F.concat_ws(", ", F.col("event_id"), F.col("user_id"), sql_literal(F.col("event_type"), e.schema["event_type"].dataType, "mysql")), F.lit(", DEFAULT, X'00', DEFAULT);"))
    write_text(e.select(F.when(F.col("event_type") == "view", left_out).otherwise(given).alias("stmt")), f"{out}/data")
    t = load_dump(spark, out, "mysql").tables["events"]
    return t.select("event_id", "user_id", "event_type", "value", F.hex("flags").alias("flags"), "note")


def q_load_upserts(spark, sf_dir):
    """One row per customer after all orders were written in order: replaced, kept, or the price alone set anew."""
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    out = staging_path(spark, "upserts")
    fs.write_bytes(f"{out}/00.sql", b"CREATE TABLE latest (o_orderkey bigint, o_custkey bigint, o_totalprice double, PRIMARY KEY (o_custkey));\n")
    way = F.col("o_custkey") % 3
    verb = F.when(way == 0, "REPLACE INTO").when(way == 1, "INSERT IGNORE INTO").otherwise("INSERT INTO")
    tail = F.when(way == 2, " ON DUPLICATE KEY UPDATE o_totalprice = VALUES(o_totalprice);").otherwise(";")
    stmt = F.concat(verb, F.lit(" latest VALUES "), _values(o, o.columns), tail)
    # part files hold ranges of keys, so files and statements are in the order of the keys
    write_text(o.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(stmt.alias("stmt")), f"{out}/data")
    return load_dump(spark, out, "mysql").tables["latest"]


def q_load_recreated(spark, sf_dir):
    """All customers, dropped and created with other columns, loaded again, truncated, and those with money loaded."""
    c = _read(spark, sf_dir, "customer")
    out = staging_path(spark, "recreated")
    put = lambda df, cols: df.select(F.concat(F.lit("INSERT INTO customer VALUES "), _values(df, cols), F.lit(";")).alias("stmt"))
    fs.write_bytes(f"{out}/10.sql", b"CREATE TABLE customer (c_custkey bigint, c_name text);\n")
    write_text(put(c, ["c_custkey", "c_name"]), f"{out}/11")
    fs.write_bytes(f"{out}/20.sql", b"DROP TABLE IF EXISTS customer;\nCREATE TABLE customer (c_acctbal double, c_custkey bigint, c_name text);\n")
    write_text(put(c, ["c_acctbal", "c_custkey", "c_name"]), f"{out}/21")
    fs.write_bytes(f"{out}/30.sql", b"/*!40000 TRUNCATE TABLE `customer` */;\n")
    write_text(put(c.where("c_acctbal > 0"), ["c_acctbal", "c_custkey", "c_name"]), f"{out}/31")
    return load_dump(spark, out, "mysql").tables["customer"]


def q_load_skip_bad_batches(spark, sf_dir):
    """Statements of 10 events in batches of 5: a statement that does not load takes its whole batch with it."""
    e = _read(spark, sf_dir, "events")
    corrupt = e.withColumn("value", F.when(F.col("value") > 300, F.lit("bad")).otherwise(F.col("value").cast("string")))
    out = staging_path(spark, "badload")
    stm = render_inserts_ordered(corrupt, "events", "event_id", "mysql", 10)
    # a file for every 50 statements, in order
    files = stm.withColumn("file", F.floor(F.col("batch_id") / 50)).repartitionByRange("file").sortWithinPartitions("file", "batch_id")
    files.select("file", F.regexp_replace("stmt", r"\n$", "").alias("stmt")).write.partitionBy("file").text(out)
    return load_dump(spark, out, "mysql", schemas={"events": e.schema}, batch=5, on_error="skip").tables["events"]


def _page_statements(spark, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit(insert_prefix("pages", p.columns, "mysql")), _values(p, p.columns), F.lit(";")).alias("stmt"))


def _trimmed(stmts: DataFrame) -> DataFrame:
    return stmts.select(F.regexp_replace("stmt", r"^\s+|\s+$", "").alias("stmt")).where("stmt <> ''")


def q_dump_statements_one_line(spark, sf_dir):
    """Files without a line feed, cut at any byte."""
    out = staging_path(spark, "one-line")
    _page_statements(spark, sf_dir).select(F.replace("stmt", F.lit("\n"), F.lit(" ")).alias("stmt")).write.option("lineSep", " ").text(out)
    return _trimmed(read_statements(spark, out, "mysql", chunk_bytes=1 << 14))


def q_dump_statements_parts(codec):
    def build(spark, sf_dir):
        """Compressed files of many frames or streams, read by many tasks."""
        out = staging_path(spark, "parts")
        write_text(_page_statements(spark, sf_dir), out, codec, part_bytes=1 << 14)
        return _trimmed(read_statements(spark, out, "mysql", chunk_bytes=1 << 14))
    return build


def q_line_mode_chunks(spark, sf_dir):
    """Line mode over chunks: statements of several lines, with delimiters inside strings and two DELIMITER lines each."""
    p = _read(spark, sf_dir, "pages")
    body = F.concat(F.lit("INSERT INTO t VALUES\n("), _values(p, ["page_id", "url"]), F.lit(",\n'a;\n//\n')"))
    text = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("DELIMITER //\n"), body, F.lit(" //\n-- done //\nDELIMITER ;"))).otherwise(F.concat(body, F.lit(";")))
    out = staging_path(spark, "line-chunks")
    write_text(p.select(text.alias("stmt")), out)
    return read_statements_lines(spark, out, chunk_bytes=1 << 13).select("stmt")


QUERIES = {
    "dump_statements_one_line": q_dump_statements_one_line,
    "dump_statements_zst_parts": q_dump_statements_parts("zstd"),
    "dump_statements_xz_parts": q_dump_statements_parts("xz"),
    "line_mode_chunks": q_line_mode_chunks,
    "load_two_databases": q_load_two_databases,
    "load_defaults": q_load_defaults,
    "load_upserts": q_load_upserts,
    "load_recreated": q_load_recreated,
    "load_skip_bad_batches": q_load_skip_bad_batches,
}

SQL = {
    "load_two_databases": "SELECT CASE o_custkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS database, o_orderkey, CASE o_custkey % 2 WHEN 0 THEN o_custkey END AS o_custkey, o_totalprice FROM orders",
    "load_defaults": """SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'it''s a view' ELSE event_type END AS event_type,
                               CASE event_type WHEN 'view' THEN value ELSE -1.5 END AS value, CASE event_type WHEN 'view' THEN '05' ELSE '00' END AS flags, CAST(NULL AS VARCHAR) AS note FROM events""",
    "load_upserts": """SELECT CASE o_custkey % 3 WHEN 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS o_orderkey, o_custkey,
                              CASE o_custkey % 3 WHEN 1 THEN arg_min(o_totalprice, o_orderkey) ELSE arg_max(o_totalprice, o_orderkey) END AS o_totalprice
                       FROM orders GROUP BY o_custkey""",
    "load_recreated": "SELECT c_acctbal, c_custkey, c_name FROM customer WHERE c_acctbal > 0",
    "load_skip_bad_batches": """WITH t AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS b FROM events)
                                SELECT * EXCLUDE (b) FROM t WHERE b NOT IN (SELECT b FROM t WHERE value > 300)""",
}
