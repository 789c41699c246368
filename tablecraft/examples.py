"""Registered example queries: one per operator key of the survey.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame computed over
the whole input tables (or frames Spark derives from them). The derived
frames follow FIXTURES.md section C, re-expressed with attribute predicates.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bulk, stats
from .session import staging_path
from .tableset import TableSet, page

SHOP = ["customer", "orders", "lineitem"]
REF = ["region", "nation", "part", "supplier"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shop(spark, sf_dir) -> TableSet:
    return TableSet.from_dir(spark, sf_dir, SHOP, name="shop")


def ref(spark, sf_dir) -> TableSet:
    return TableSet.from_dir(spark, sf_dir, REF, name="ref")


# -- derived frames ----------------------------------------------------------

SHIFT = 100_000_000  # added to some keys of a second version of a table


def orders_a(spark, sf_dir):
    return load(spark, sf_dir, "orders")


def orders_b(spark, sf_dir):
    """All orders again: every third key shifted, every second customer's price changed."""
    o = load(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + SHIFT).otherwise(F.col("o_orderkey"))
    return o.withColumns({"o_orderkey": key, "o_totalprice": F.col("o_totalprice") + F.col("o_custkey") % 2})


SYNC_KEYS = ["o_orderkey", "o_orderpriority"]


def sync_tgt(spark, sf_dir):
    """All orders; the second key column is null for urgent ones."""
    return load(spark, sf_dir, "orders").withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))


def sync_src(spark, sf_dir):
    """The same with every seventh key shifted and the prices of finished orders changed."""
    key = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") + SHIFT).otherwise(F.col("o_orderkey"))
    price = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return sync_tgt(spark, sf_dir).withColumns({"o_orderkey": key, "o_totalprice": price})


def metric_samples(spark, sf_dir):
    """events as cache samples: server = user_id % 5, view = hit, error = read."""
    e = load(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).cast("int").alias("server"),
        "ts",
        (F.col("event_type") == "view").cast("int").alias("hit"),
        (F.col("event_type") == "error").cast("int").alias("read"),
    )


def sessions(spark, sf_dir):
    """events as sessions: state active for clicks, duration value * 10 ms."""
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "click", "active").otherwise("idle").alias("state"),
        (F.col("value") * 10).alias("ms"),
    )


def status_rows(spark, sf_dir):
    """Long-form status counters per server from the metric samples."""
    s = metric_samples(spark, sf_dir)
    per = s.groupBy("server").agg(
        F.max("ts").alias("ts"),
        F.sum(F.col("hit") + F.col("read")).alias("requests"),
        F.sum("read").alias("reads"),
    )
    return per.select(
        "server",
        "ts",
        F.explode(
            F.array(
                F.struct(F.lit("Innodb_buffer_pool_read_requests").alias("name"), F.col("requests").cast("string").alias("value")),
                F.struct(F.lit("Innodb_buffer_pool_reads").alias("name"), F.concat(F.col("reads").cast("string"), F.lit(" pages")).alias("value")),
            )
        ).alias("kv"),
    ).select("server", "ts", "kv.name", "kv.value")


# -- S / P / U / J keys ----------------------------------------------------------

def q_scan_table(spark, sf_dir):
    ts = TableSet.from_dir(spark, sf_dir, ["orders"])
    df = ts["orders"]
    return df.select(*df.columns)


def q_page_rows(spark, sf_dir):
    return page(load(spark, sf_dir, "orders"), ["o_orderkey"], size=50, page_no=3)


def q_copy_where(spark, sf_dir):
    return bulk.copy_table(load(spark, sf_dir, "lineitem"), where="l_quantity > 25 AND l_returnflag = 'R'")


def q_clone_table(spark, sf_dir):
    return shop_rows(bulk.clone(shop(spark, sf_dir), staging_path(spark, "clone"), data=True))


def shop_rows(ts: TableSet) -> DataFrame:
    """All rows of the shop's tables in common columns."""
    pick = {"customer": ("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "lineitem": ("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")}
    out = None
    for t, (a, b, c, d) in pick.items():
        rows = ts[t].select(F.lit(t).alias("name"), F.col(a).cast("long").alias("k1"), F.col(b).cast("long").alias("k2"), F.col(c).alias("amount"), F.col(d).alias("word"))
        out = rows if out is None else out.unionByName(rows)
    return out


def q_clone_structure(spark, sf_dir):
    """Structure copies, read back, beside the row counts of what they were copied from."""
    src = shop(spark, sf_dir)
    copies = bulk.clone(src, staging_path(spark, "structure"), data=False)
    copied, whole = stats.row_counts(copies), stats.row_counts(src)
    columns = bulk.schema_rows(spark, copies).groupBy(F.col("table_name").alias("name")).agg(F.count(F.lit(1)).alias("columns"))
    return whole.select("name", F.col("row_count").alias("source_rows")).join(copied.select("name", F.col("row_count").alias("copied_rows")), "name").join(columns, "name")


def q_copy_renamed(spark, sf_dir):
    root = staging_path(spark, "renamed")
    bulk.copy_into(load(spark, sf_dir, "nation"), root, "dear_lines")
    return bulk.copy_into(load(spark, sf_dir, "lineitem"), root, "dear_lines", "l_extendedprice > 30000", if_exists="replace")


def q_merge_two_sources(spark, sf_dir):
    """A fold over two sources: the second one also meets the table that the first one added."""
    target = TableSet({"orders": orders_a(spark, sf_dir)}, name="shop")
    first = TableSet({"orders": orders_b(spark, sf_dir), "nation": load(spark, sf_dir, "nation")}, name="archive")
    second = TableSet({"nation": load(spark, sf_dir, "nation"), "orders": orders_b(spark, sf_dir)}, name="backup")
    return stats.row_counts(bulk.merge(target, [first, second], "append")).select("name", "row_count")


def q_merge_into_target(spark, sf_dir):
    """Append into the table that is read: staged, then swapped."""
    root = staging_path(spark, "target")
    target = bulk.clone(TableSet({"orders": orders_a(spark, sf_dir)}), root)
    merged = bulk.merge(target, [TableSet({"orders": orders_b(spark, sf_dir)}, name="archive")], "append")
    return bulk.write_tables(dict(merged.items()), root, if_exists="replace")["orders"]


def q_like_filter(spark, sf_dir):
    return stats.like_filter(load(spark, sf_dir, "part"), "p_name", "%red%").select("p_partkey", "p_name", "p_type")


def q_exists_check(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = load(spark, sf_dir, "customer").where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("n_nationkey"))
    return stats.has_match(n, c, ["n_nationkey"], out="has_rich_customers")


def q_user_namespaces(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    system = spark.createDataFrame([(x,) for x in ["information_schema", "mysql", "performance_schema", "sys", "postgres", "template0", "template1"]], "name string")
    names = n.unionByName(system.select(F.upper("name").alias("name")))
    return names.select(
        "name",
        stats.is_system_namespace(F.col("name"), "mysql").alias("system_mysql"),
        stats.is_system_namespace(F.col("name"), "postgres").alias("system_postgres"),
    ).where(~F.col("system_mysql"))


def q_merge(policy):
    def build(spark, sf_dir):
        target = TableSet({"orders": orders_a(spark, sf_dir)}, name="shop")
        source = TableSet({"orders": orders_b(spark, sf_dir)}, name="archive")
        merged = bulk.merge(target, [source], policy)
        if policy != "rename":
            return merged["orders"]
        parts = [df.select(F.lit(n).alias("table_name"), *df.columns) for n, df in merged.items()]
        return parts[0].unionByName(parts[1])
    return build


def _schema_sets(spark, sf_dir):
    a = TableSet.from_dir(spark, sf_dir, ["customer", "orders", "lineitem", "nation"], name="first")
    c = load(spark, sf_dir, "customer")
    b = TableSet(
        {
            "customer": c.withColumn("c_acctbal", F.col("c_acctbal").cast("string")),
            "orders": load(spark, sf_dir, "orders").drop("o_orderpriority"),
            "nation": load(spark, sf_dir, "nation"),
            "part": load(spark, sf_dir, "part"),
        },
        name="second",
    )
    return a, b


def q_schema_diff(spark, sf_dir):
    a, b = _schema_sets(spark, sf_dir)
    return bulk.schema_diff(a, b).select("table_name", "status", "first_columns", "second_columns")


def q_only_in_first(spark, sf_dir):
    return bulk.only_in_first(orders_a(spark, sf_dir), orders_b(spark, sf_dir), ["o_orderkey"])


def q_conflicting(spark, sf_dir):
    return bulk.conflicting(orders_a(spark, sf_dir), orders_b(spark, sf_dir), ["o_orderkey"])


def q_sync_changes(spark, sf_dir):
    ch = bulk.sync_changes(sync_src(spark, sf_dir), sync_tgt(spark, sf_dir), SYNC_KEYS)
    return ch.select(*SYNC_KEYS, "action", F.col("new_row.o_totalprice").alias("new_price"), F.col("old_row.o_totalprice").alias("old_price"))


def q_sync_counts(spark, sf_dir):
    return bulk.sync_counts(bulk.sync_changes(sync_src(spark, sf_dir), sync_tgt(spark, sf_dir), SYNC_KEYS))


def q_sync_apply(spark, sf_dir):
    ch = bulk.sync_changes(sync_src(spark, sf_dir), sync_tgt(spark, sf_dir), SYNC_KEYS)
    return bulk.sync_apply(ch, SYNC_KEYS)


# -- A keys ----------------------------------------------------------------------

def q_table_stats_total(spark, sf_dir):
    return stats.table_stats(shop(spark, sf_dir), total=True)


def q_row_counts(spark, sf_dir):
    return stats.row_counts(TableSet.from_dir(spark, sf_dir, SHOP + REF))


def _sizes(spark, sf_dir):
    return stats.table_sizes([shop(spark, sf_dir), ref(spark, sf_dir)])


def q_database_size(spark, sf_dir):
    s = _sizes(spark, sf_dir)
    return stats.database_size(s, "shop").select(F.lit("shop").alias("ns"), "size").unionByName(
        stats.database_size(s, "missing").select(F.lit("missing").alias("ns"), "size")
    )


def q_database_sizes(spark, sf_dir):
    return stats.database_sizes(_sizes(spark, sf_dir))


def q_database_stats(spark, sf_dir):
    return stats.database_stats(_sizes(spark, sf_dir))


def q_hit_ratio(spark, sf_dir):
    return stats.hit_ratio(metric_samples(spark, sf_dir), "hit", "read", by=["server"])


def q_kv_hit_ratio(spark, sf_dir):
    return stats.kv_hit_ratio(status_rows(spark, sf_dir), "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads")


def q_slow_count(spark, sf_dir):
    return stats.slow_count(sessions(spark, sf_dir), "ms", 1000)


def q_active_count(spark, sf_dir):
    return stats.active_count(sessions(spark, sf_dir), "state")


def q_usage_levels(spark, sf_dir):
    per_user = sessions(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(F.col("state") == "active").alias("active"), F.count(F.lit(1)).alias("max")
    )
    return stats.usage_levels(per_user)


def q_size_vs_max(spark, sf_dir):
    s = _sizes(spark, sf_dir).select("ns", "name", (F.col("data_size") + F.col("index_size")).alias("size"))
    return stats.share_of_max(s, "size")


def q_top5_more(spark, sf_dir):
    per_user = load(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("total_value"))
    return stats.top_n_more(per_user, "total_value", 5, tie=["user_id"])


def q_tables_with_stats(spark, sf_dir):
    tables = TableSet.from_dir(spark, sf_dir, SHOP + REF, name="db").catalog(spark)
    tables = tables.unionByName(TableSet.from_dir(spark, sf_dir, ["orders"], name="archive").catalog(spark))
    cat = tables.select("ns", "name", F.lit("public").alias("table_schema"), F.col("name").alias("table_name"), F.lit("BASE TABLE").alias("table_type"))
    # a view over the orders table is listed by the catalog but is no base table
    view = cat.where(F.col("name") == "orders").withColumn("table_type", F.lit("VIEW")).withColumn("name", F.lit("orders_view")).withColumn("table_name", F.col("name"))
    base = stats.base_tables(cat.unionByName(view))
    counts = stats.row_counts(shop(spark, sf_dir)).select(F.lit("db").alias("ns"), "name", F.col("row_count").alias("rows"))
    return stats.tables_with_stats(base.select("ns", "name"), counts)


def q_four_way_join_sizes(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    per_cust = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n"))
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (
        per_cust.join(c, per_cust.o_custkey == c.c_custkey, "inner")
        .join(n, c.c_nationkey == n.n_nationkey, "inner")
        .join(r, n.n_regionkey == r.r_regionkey, "inner")
    )
    out = j.groupBy(F.col("r_name").alias("table_name"), F.col("n_name").alias("index_name")).agg(
        F.round(F.sum("spent"), 2).alias("size"), F.sum("n").alias("orders")
    )
    return out.orderBy(F.desc("size"), "table_name", "index_name")


def q_array_member_join(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem")
    # an order's line numbers: an array that is short by nature, as a table's key columns are
    keys = l.groupBy(F.col("l_orderkey").alias("table")).agg(F.array_sort(F.collect_set("l_linenumber"), lambda a, b: b - a).alias("keys"))
    attrs = l.select(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("attnum"), "l_extendedprice")
    j = stats.primary_key_columns(keys, attrs, on="table")
    return j.select(F.col("table").alias("l_orderkey"), "pos", F.col("attnum").alias("l_linenumber"), "l_extendedprice")


# Privilege lists cycled over customers for the grant examples.
PRIVILEGE_LISTS = ["SELECT", "select, insert", "ALL", " index ", "ALTER,UPDATE", "DELETE, Index, all"]


def _customer_privileges(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    lists = F.array(*[F.lit(x) for x in PRIVILEGE_LISTS])
    return c.select("c_custkey", F.col("c_mktsegment").alias("grantee"), F.element_at(lists, (F.col("c_custkey") % len(PRIVILEGE_LISTS) + 1).cast("int")).alias("privileges"))


def q_privilege_map(spark, sf_dir):
    return stats.map_privileges(_customer_privileges(spark, sf_dir)).select("c_custkey", "grantee", "pos", "privilege_in", "privilege")


def q_grant_report(spark, sf_dir):
    tg = stats.map_privileges(_customer_privileges(spark, sf_dir)).select(
        "grantee", "privilege", F.lit("public").alias("schema_name"), F.lit("orders").alias("table_name")
    ).distinct()
    n = load(spark, sf_dir, "nation")
    r = load(spark, sf_dir, "region")
    dg = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("grantee"), F.lower("r_name").alias("database"))
    return stats.grant_report(tg, dg)


REGISTRY = {
    "scan_table": q_scan_table,
    "page_rows": q_page_rows,
    "copy_where": q_copy_where,
    "clone_table": q_clone_table,
    "clone_structure": q_clone_structure,
    "copy_renamed": q_copy_renamed,
    "merge_two_sources": q_merge_two_sources,
    "merge_into_target": q_merge_into_target,
    "like_filter": q_like_filter,
    "exists_check": q_exists_check,
    "user_namespaces": q_user_namespaces,
    "merge_skip": q_merge("skip"),
    "merge_replace": q_merge("replace"),
    "merge_append": q_merge("append"),
    "merge_rename": q_merge("rename"),
    "schema_diff": q_schema_diff,
    "only_in_first": q_only_in_first,
    "conflicting": q_conflicting,
    "sync_changes": q_sync_changes,
    "sync_counts": q_sync_counts,
    "sync_apply": q_sync_apply,
    "table_stats_total": q_table_stats_total,
    "row_counts": q_row_counts,
    "database_size": q_database_size,
    "database_sizes": q_database_sizes,
    "database_stats": q_database_stats,
    "hit_ratio": q_hit_ratio,
    "kv_hit_ratio": q_kv_hit_ratio,
    "slow_count": q_slow_count,
    "active_count": q_active_count,
    "usage_levels": q_usage_levels,
    "size_vs_max": q_size_vs_max,
    "top5_more": q_top5_more,
    "tables_with_stats": q_tables_with_stats,
    "four_way_join_sizes": q_four_way_join_sizes,
    "array_member_join": q_array_member_join,
    "privilege_map": q_privilege_map,
    "grant_report": q_grant_report,
}


# -- dump / load keys --------------------------------------------------------------
from pyspark.sql import types as T  # noqa: E402

from .functions.dialect import insert_prefix, row_tuple, sql_literal  # noqa: E402
from .operators.statements import batch_outcomes, classify_statements, filter_statements  # noqa: E402
from .plans.dump import render_inserts_ordered, write_dump  # noqa: E402
from .plans.load import load_dump  # noqa: E402
from .plans.textsink import write_text  # noqa: E402
from .sources.statements import read_statements, read_statements_lines  # noqa: E402

ORDER_TEXT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
WS_TRIM = r"^\s+|\s+$"


def _trim_ws(c):
    return F.regexp_replace(c, WS_TRIM, "")


def q_sql_literals(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    t = F.nullif(F.col("event_type"), F.lit("error"))
    return e.select(
        "event_id",
        sql_literal(t, T.StringType(), "mysql").alias("type_mysql"),
        sql_literal(F.col("props"), T.StringType(), "mysql").alias("props_mysql"),
        sql_literal(F.col("props"), T.StringType(), "postgres").alias("props_pg"),
        sql_literal(F.col("ts"), T.TimestampNTZType(), "mysql").alias("ts_lit"),
        sql_literal(F.col("user_id"), T.LongType(), "mysql").alias("user_lit"),
    )


def q_sql_literals_pages(spark, sf_dir):
    p = load(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        sql_literal(F.col("url"), T.StringType(), "mysql").alias("url_mysql"),
        sql_literal(F.col("html"), T.StringType(), "mysql").alias("html_mysql"),
        sql_literal(F.col("html"), T.StringType(), "postgres").alias("html_pg"),
    )


def q_insert_batches(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(*ORDER_TEXT_COLS)
    return render_inserts_ordered(o, "orders", "o_orderkey", "mysql", 1000).select("batch_id", "rows", "stmt")


def q_dump_lines_orders(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(*ORDER_TEXT_COLS)
    out = staging_path(spark, "dump-lines") + "/dump"
    write_dump(TableSet({"orders": o}), out, "mysql")
    st = read_statements(spark, out, "mysql")
    ins = st.where(_trim_ws(F.col("stmt")).startswith("INSERT"))
    lines = ins.select(F.explode(F.split("stmt", "\n")).alias("line")).where(F.col("line").startswith("("))
    return lines.select(F.regexp_replace("line", r"[,;]$", "").alias("line"))


def _page_statements(spark, sf_dir, dialect):
    p = load(spark, sf_dir, "pages")
    prefix = insert_prefix("pages", p.columns, dialect)
    return p.select("page_id", F.concat(F.lit(prefix), row_tuple(p.schema, dialect), F.lit(";")).alias("stmt"))


def _statement_file(spark, sf_dir, dialect, extra=None):
    stm = _page_statements(spark, sf_dir, dialect).select("stmt")
    if extra is not None:
        stm = extra.unionByName(stm)
    out = staging_path(spark, "stmts")
    write_text(stm, out, None)
    return out


def q_dump_statements(dialect):
    def build(spark, sf_dir):
        path = _statement_file(spark, sf_dir, dialect)
        st = read_statements(spark, path, dialect)
        t = _trim_ws(F.col("stmt"))
        return st.select(t.alias("stmt")).where(F.col("stmt") != "")
    return build


def q_dump_statements_line(spark, sf_dir):
    path = _statement_file(spark, sf_dir, "mysql")
    return read_statements_lines(spark, path).select("stmt")


def q_stmt_filter(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    extra = n.select(F.concat(F.lit("CREATE DATABASE IF NOT EXISTS `"), F.lower("n_name"), F.lit("`;\nuse `"), F.lower("n_name"), F.lit("`;\n;\n\n;")).alias("stmt"))
    path = _statement_file(spark, sf_dir, "mysql", extra)
    st = filter_statements(read_statements(spark, path, "mysql", chunk_bytes=1 << 16), rename=True)
    return st.select(_trim_ws(F.col("stmt")).alias("stmt"))


# Statement text per event type for the classification example.
CLASSIFY_TEXT = {
    "click": "SELECT * FROM orders WHERE o_custkey = ",
    "view": "  show tables -- ",
    "purchase": "WITH x AS (SELECT 1) SELECT * FROM x, orders WHERE o_orderkey = ",
    "signup": "update customer SET c_acctbal = 0 WHERE c_custkey = ",
    "error": "explain SELECT ",
}


def q_stmt_classify(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    txt = F.lit(None).cast("string")
    for k, v in CLASSIFY_TEXT.items():
        txt = F.when(F.col("event_type") == k, F.lit(v)).otherwise(txt)
    st = e.select("event_id", F.concat(txt, F.col("user_id").cast("string")).alias("stmt"))
    plain = classify_statements(st).withColumnRenamed("kind", "plain")
    return classify_statements(plain, cte_as_read=True).select("event_id", F.col("plain").alias("kind"), F.col("kind").alias("kind_cte"))


def _roundtrip(table, dialect, codec, chunk=1 << 16):
    def build(spark, sf_dir):
        df = load(spark, sf_dir, table)
        out = staging_path(spark, f"rt-{table}") + "/dump"
        write_dump(TableSet({table: df}), out, dialect, codec=codec)
        return load_dump(spark, out, dialect, chunk_bytes=chunk).tables[table]
    return build


def q_dump_resume(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    out = staging_path(spark, "resume") + "/dump"
    write_dump(TableSet({"orders": o}), out, "mysql", order_by={"orders": "o_orderkey"}, batch=100)
    data_dir = f"{out}/000001_orders/data"
    # every data file holds only INSERTs, in key order: resume each at its middle statement
    st = filter_statements(read_statements(spark, data_dir, "mysql", chunk_bytes=1 << 16))
    half = F.broadcast(st.groupBy("file").agg(F.floor(F.count(F.lit(1)) / 2).alias("half")))  # one number per file, never the statements
    at = st.join(half, "file").where(F.col("stmt_no") >= F.col("half")).groupBy("file").agg(F.min("byte_start").alias("at"))
    resume = {r["file"]: r["at"] for r in at.collect()}  # one number per file
    from .sources.inserts import decode_inserts

    resumed = decode_inserts(read_statements(spark, data_dir, "mysql", start_byte=resume, chunk_bytes=1 << 16), "orders", o.schema, "mysql")
    first = decode_inserts(st.join(half, "file").where(F.col("stmt_no") < F.col("half")), "orders", o.schema, "mysql")
    return first.unionByName(resumed)  # what was loaded before the stop, and the rest


def q_dump_table_subset(spark, sf_dir):
    ts = TableSet.from_dir(spark, sf_dir, SHOP + REF)
    st = write_dump(ts, staging_path(spark, "subset") + "/dump", "mysql", tables=["orders", "customer"])
    return spark.createDataFrame([(t.table, t.rows) for t in st.tables], "table_name string, rows long")


def q_export_stats(spark, sf_dir):
    st = write_dump(shop(spark, sf_dir), staging_path(spark, "export") + "/dump", "postgres", codec="gzip")
    return spark.createDataFrame([(t.table, t.rows) for t in st.tables], "table_name string, rows long")


def q_load_batch_outcomes(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("stmt_no"), (F.col("event_type") == "error").alias("bad"))
    return batch_outcomes(e, seq="stmt_no", bad="bad", size=100)


def _corrupt_dump(spark, sf_dir, batch):
    e = load(spark, sf_dir, "events")
    corrupt = e.withColumn("value", F.when(F.col("value") > 300, F.lit("bad")).otherwise(F.col("value").cast("string")))
    out = staging_path(spark, "rejects") + "/dump"
    write_dump(TableSet({"events": corrupt}), out, "mysql", batch=batch, order_by={"events": "event_id"})
    return e, out


def q_load_rejects(spark, sf_dir):
    """One statement per event: every one that does not load is a reject with its text."""
    e, out = _corrupt_dump(spark, sf_dir, 1)
    res = load_dump(spark, out, "mysql", schemas={"events": e.schema}, batch=1, on_error="skip")
    return res.rejects.select("table", "error", F.regexp_extract("stmt", r"\((\d+),", 1).cast("long").alias("event_id"))


def q_load_fail_stops(spark, sf_dir):
    """The default stops at a statement that does not load; per event type, whether its load stopped."""
    e = load(spark, sf_dir, "events")
    types = [r["event_type"] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # five types
    rows = []
    for t in types:
        part = e.where(F.col("event_type") == t)
        out = staging_path(spark, "stops") + "/dump"
        write_dump(TableSet({"events": part.withColumn("user_id", F.when(F.col("event_type") == "error", F.lit("x")).otherwise(F.col("user_id").cast("string")))}), out, "mysql")
        try:
            n, stopped = load_dump(spark, out, "mysql", schemas={"events": e.schema}).tables["events"].count(), False
        except ValueError:
            n, stopped = 0, True
        rows.append((t, n, stopped))
    return spark.createDataFrame(rows, "event_type string, rows long, stopped boolean")


def _foreign(spark, sf_dir, head, prefix, dialect, table, cols):
    """A dump in another writer's style: its own DDL, one statement per row."""
    df = load(spark, sf_dir, table)
    from .functions.dialect import sql_literal

    values = F.concat_ws(", ", *[sql_literal(F.col(c), df.schema[c].dataType, dialect) for c in cols])
    out = staging_path(spark, "foreign")
    from .sources import fs as _fs

    _fs.write_bytes(f"{out}/00_head.sql", head.encode())
    write_text(df.select(F.concat(F.lit(prefix), F.lit(" ("), values, F.lit(");")).alias("stmt")), f"{out}/data")
    return out


def q_load_by_ddl(spark, sf_dir):
    """No schema but the dump's own CREATE TABLE."""
    head = """-- dump
CREATE TABLE `supplier` (
  `s_suppkey` bigint NOT NULL AUTO_INCREMENT,
  `s_name` varchar(25) DEFAULT NULL COMMENT 'a, (b)',
  `s_nationkey` int(11) DEFAULT '0',
  `s_acctbal` double DEFAULT NULL,
  PRIMARY KEY (`s_suppkey`),
  KEY `by_nation` (`s_nationkey`)
) ENGINE=InnoDB;
"""
    return load_dump(spark, _foreign(spark, sf_dir, head, "INSERT IGNORE INTO `supplier` VALUES", "mysql", "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]), "mysql").tables["supplier"]


def q_load_qualified(spark, sf_dir):
    """Schema-qualified names, columns in another order, a conflict clause, a cast."""
    head = """CREATE TABLE public.customer (
    c_custkey bigint DEFAULT nextval('public.seq'::regclass) NOT NULL,
    c_name character varying(25),
    c_nationkey integer,
    c_acctbal double precision,
    c_mktsegment text
);
"""
    out = _foreign(spark, sf_dir, head, "INSERT INTO public.customer (c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal) VALUES", "postgres", "customer", ["c_mktsegment", "c_custkey", "c_name", "c_nationkey", "c_acctbal"])
    return load_dump(spark, out, "postgres").tables["customer"]


def q_roundtrip_empty(spark, sf_dir):
    """A dump of an empty table, and a structure-only dump, beside a full one: row counts as loaded."""
    o, n = load(spark, sf_dir, "orders"), load(spark, sf_dir, "nation")
    out = staging_path(spark, "empty")
    write_dump(TableSet({"orders": o.where("o_orderkey < 0"), "nation": n}), f"{out}/a", "mysql")
    write_dump(TableSet({"orders": o}), f"{out}/b", "postgres", data=False)
    a, b = load_dump(spark, f"{out}/a", "mysql").tables, load_dump(spark, f"{out}/b", "postgres").tables
    return stats.row_counts(TableSet({"empty_orders": a["orders"], "nation": a["nation"], "structure_orders": b["orders"]})).select("name", "row_count")


def q_load_hex_text(spark, sf_dir):
    """Texts written as hex literals load as the texts; the same literals in a binary column as their bytes."""
    n = load(spark, sf_dir, "pages").select("page_id", "url")
    out = staging_path(spark, "hex")
    stmt = F.concat(F.lit("INSERT INTO t VALUES ("), F.col("page_id").cast("string"), F.lit(", X'"), F.hex("url"), F.lit("', 0x"), F.hex("url"), F.lit(");"))
    write_text(n.select(stmt.alias("stmt")), out)
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("raw", T.BinaryType())])
    t = load_dump(spark, out, "mysql", schemas={"t": schema}).tables["t"]
    return t.select("page_id", "url", F.hex("raw").alias("raw_hex"))


def q_typed_literals(spark, sf_dir):
    """Double, boolean, date, decimal, binary and null literals, read back from both dialects."""
    e = load(spark, sf_dir, "events").select(
        "event_id", "value", (F.col("user_id") % 2 == 0).alias("even"), F.col("ts").cast("date").alias("day"),
        F.round("value", 2).cast("decimal(18,2)").alias("amount"), F.encode("event_type", "UTF-8").alias("raw"), F.when(F.col("user_id") % 3 == 0, F.col("props")).alias("maybe"),
    )
    out = staging_path(spark, "literals")
    parts = []
    for dialect in ("mysql", "postgres"):
        write_dump(TableSet({"t": e}), f"{out}/{dialect}", dialect)
        t = load_dump(spark, f"{out}/{dialect}", dialect).tables["t"]
        parts.append(t.select(F.lit(dialect).alias("dialect"), "event_id", "value", "even", "day", "amount", F.hex("raw").alias("raw_hex"), "maybe"))
    return parts[0].unionByName(parts[1])


REGISTRY.update({
    "sql_literals": q_sql_literals,
    "sql_literals_pages": q_sql_literals_pages,
    "insert_batches": q_insert_batches,
    "dump_lines_orders": q_dump_lines_orders,
    "dump_statements": q_dump_statements("mysql"),
    "dump_statements_pg": q_dump_statements("postgres"),
    "dump_statements_line": q_dump_statements_line,
    "stmt_filter": q_stmt_filter,
    "stmt_classify": q_stmt_classify,
    "dump_roundtrip_orders": _roundtrip("orders", "mysql", None, None),
    "dump_roundtrip_gz": _roundtrip("orders", "postgres", "gzip", None),
    "dump_roundtrip_zst": _roundtrip("events", "mysql", "zstd", None),
    "dump_roundtrip_xz": _roundtrip("pages", "postgres", "xz"),
    "dump_roundtrip_pages": _roundtrip("pages", "mysql", None, 1 << 14),
    "dump_roundtrip_documents": _roundtrip("documents", "mysql", None, None),
    "dump_roundtrip_customer": _roundtrip("customer", "postgres", None, None),
    "dump_resume": q_dump_resume,
    "dump_table_subset": q_dump_table_subset,
    "export_stats": q_export_stats,
    "load_batch_outcomes": q_load_batch_outcomes,
    "load_rejects": q_load_rejects,
    "load_fail_stops": q_load_fail_stops,
    "load_by_ddl": q_load_by_ddl,
    "load_qualified": q_load_qualified,
    "roundtrip_empty": q_roundtrip_empty,
    "load_hex_text": q_load_hex_text,
    "typed_literals": q_typed_literals,
})


# -- backup / retention / schedule / health / format keys ----------------------------
from .functions import formats as fmt  # noqa: E402
from .operators import health, retention  # noqa: E402
from .plans import backup  # noqa: E402


def q_backup_manifest(spark, sf_dir):
    man = backup.create_backup([shop(spark, sf_dir), ref(spark, sf_dir)], staging_path(spark, "backups"))
    return spark.createDataFrame([(f["database"], f["filename"], f["tables"], f["rows"]) for f in man["files"]],
                                 "database string, filename string, tables int, rows long")


def q_backup_catalog(spark, sf_dir):
    root = staging_path(spark, "catalog")
    backup.create_backup([shop(spark, sf_dir)], root, description="shop only")
    backup.create_backup([ref(spark, sf_dir), shop(spark, sf_dir)], root, description="everything", codec="gzip")
    fs_bad = root + "/broken/metadata.json"
    from .sources import fs as _fs

    _fs.write_bytes(fs_bad, b"{not json")  # unreadable manifests are skipped
    cat = backup.read_backups(spark, root)
    return cat.select(
        "description",
        F.size("databases").alias("n_databases"),
        F.aggregate("files", F.lit(0).cast("long"), lambda acc, f: acc + f["rows"]).alias("total_rows"),
        "compression",
    )


def q_backup_restore_roundtrip(spark, sf_dir):
    root = staging_path(spark, "restore")
    man = backup.create_backup([shop(spark, sf_dir)], root, codec="zstd")
    restored = backup.restore_backup(spark, root, man["id"], databases=["shop"], rename={"shop": "shop_copy"})
    return shop_rows(restored["shop_copy"])


def q_restore_checks_rows(spark, sf_dir):
    """A restore compares rows with the manifest: per table set, whether a manifest off by one row is noticed."""
    import json

    from .sources import fs as _fs

    root = staging_path(spark, "checked")
    man = backup.create_backup([shop(spark, sf_dir), ref(spark, sf_dir)], root)
    rows = []
    for f in man["files"]:
        good = sum(t.count() for t in backup.restore_backup(spark, root, man["id"], databases=[f["database"]])[f["database"]].values())
        wrong = {**man, "files": [{**x, "rows": x["rows"] + (x["database"] == f["database"])} for x in man["files"]]}
        _fs.write_bytes(f"{root}/{man['id']}/metadata.json", json.dumps(wrong).encode())
        try:
            backup.restore_backup(spark, root, man["id"], databases=[f["database"]])
            noticed = False
        except ValueError:
            noticed = True
        rows.append((f["database"], good, noticed))
    return spark.createDataFrame(rows, "database string, rows long, noticed boolean")


def q_retention_apply(spark, sf_dir):
    """Four sets, the newest two of each database kept; what the catalog holds afterwards."""
    root = staging_path(spark, "retain")
    for k, sets in enumerate(([shop(spark, sf_dir)], [ref(spark, sf_dir)], [shop(spark, sf_dir), ref(spark, sf_dir)], [shop(spark, sf_dir)])):
        backup.create_backup(sets, root, description=f"set {k}")
    backup.apply_retention(spark, root, 2)
    left = backup.read_backups(spark, root)
    return left.select("description", F.aggregate("files", F.lit(0).cast("long"), lambda acc, f: acc + f["rows"]).alias("total_rows"))


def q_restore_missing(spark, sf_dir):
    root = staging_path(spark, "missing")
    man = backup.create_backup([shop(spark, sf_dir)], root)
    files = spark.createDataFrame([(f["database"],) for f in man["files"]], "database string")
    requested = load(spark, sf_dir, "nation").select(F.lower("n_name").alias("name")).unionByName(spark.createDataFrame([("shop",)], "name string"))
    return backup.missing_databases(spark, requested, files)


def _backups(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.array("event_type", F.lit("view")).alias("databases"))


def q_retention_plan(spark, sf_dir):
    return retention.retention_plan(_backups(spark, sf_dir), 3)


def q_retention_plan_per_db(spark, sf_dir):
    per = load(spark, sf_dir, "events").select("event_type").distinct().select(
        F.col("event_type").alias("database"), (F.length("event_type") - 3).alias("retain"))
    return retention.retention_plan(_backups(spark, sf_dir), per)


# Schedule intervals cycled over the example schedules.
SCHEDULE_INTERVALS = ["hourly", "daily", "weekly", "monthly", "other"]
SCHEDULE_NOW = "2024-01-15 12:00:00"


def q_due_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    iv = F.array(*[F.lit(x) for x in SCHEDULE_INTERVALS])
    sched = e.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("database"),
        (F.col("user_id") % 4 != 0).alias("enabled"),
        F.element_at(iv, (F.col("event_id") % 5 + 1).cast("int")).alias("interval"),
        F.col("ts").alias("next_run"),
    )
    due = retention.due_schedules(sched, F.lit(SCHEDULE_NOW).cast("timestamp_ntz"))
    return due.select("id", "database", "interval", "next_run", "following_run")


def q_health_levels(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    last = e.select(F.max("ts")).scalar()
    per = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    per = per.select("user_id", fmt.seconds_between(F.col("last_ts"), last).alias("lag_seconds"))
    return health.health_levels(per)


def server_aggregates(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 5).cast("int").alias("server")).agg(
        F.max("ts").alias("ts"),
        F.countDistinct("user_id").alias("users"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.max("user_id").alias("maxu"),
        F.min("user_id").alias("minu"),
        F.max("event_id").alias("maxe"),
    )


def cluster_status_rows(spark, sf_dir):
    """Long-form status rows per server: servers 0-1 galera, 2-3 replicas, 4 streaming primary."""
    a = server_aggregates(spark, sf_dir)
    s = F.col("server")

    def kv(name, value, when):
        return F.when(when, F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))

    hexs = lambda c: F.upper(F.hex(c))
    items = F.array(
        kv("wsrep_cluster_size", F.col("users"), s <= 1),
        kv("wsrep_ready", F.when(F.col("errors") < F.col("clicks"), "ON").otherwise("OFF"), s <= 1),
        kv("wsrep_connected", F.lit("ON"), s <= 1),
        kv("Slave_IO_Running", F.lit("Yes"), s.isin(2, 3)),
        kv("Slave_SQL_Running", F.when(s == 3, "No").otherwise("Yes"), s.isin(2, 3)),
        kv("Seconds_Behind_Master", F.col("errors") % 100, s.isin(2, 3)),
        kv("current_lsn", F.concat(hexs(F.col("maxu")), F.lit("/"), hexs(F.col("maxe"))), s == 4),
        kv("replay_lsn", F.concat(hexs(F.col("minu")), F.lit("/"), hexs(F.col("maxe") - F.col("errors"))), s == 4),
        kv("replay_lag_seconds", F.col("errors") % 100, s == 4),
        kv("replicas", F.lit(2), s == 4),
    )
    now = a.select("server", "ts", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("kv")).select("server", "ts", "kv.name", "kv.value")
    # an older snapshot of every server, with other values and a name that the new one lacks
    old = now.withColumns({"ts": F.col("ts") - F.expr("INTERVAL 1 DAY"), "value": F.when(F.col("name").isin("Seconds_Behind_Master", "replay_lag_seconds"), F.lit("999")).otherwise(F.lit("zzz"))})
    gone = a.where(s != 4).select("server", (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit("current_lsn").alias("name"), F.lit("0/1").alias("value"))
    return now.unionByName(old).unionByName(gone)


def q_cluster_health(spark, sf_dir):
    return health.cluster_health(cluster_status_rows(spark, sf_dir))


def q_format_sizes(spark, sf_dir):
    s = _sizes(spark, sf_dir)
    return s.select(
        "ns", "name",
        fmt.format_size(F.col("data_size")).alias("size_text"),
        fmt.format_bytes(F.col("data_size") * 1000).alias("bytes_text"),
        fmt.format_uptime(F.col("row_count") * 7).alias("uptime_text"),
    )


def q_lsn_numbers(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    lsn = F.concat(F.upper(F.hex("user_id")), F.lit("/"), F.upper(F.hex("event_id")))
    num = fmt.lsn_to_number(lsn)
    return e.select("event_id", lsn.alias("lsn"), num.cast("long").alias("lsn_number"), fmt.number_to_lsn(num).alias("lsn_back"))


def q_name_formats(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        "event_id",
        fmt.output_name(F.col("event_type"), F.col("ts")).alias("output_name"),
        fmt.backup_id(F.col("ts")).alias("backup_id"),
        fmt.database_from_path(F.concat(F.lit("/dumps/"), F.col("event_type"), F.lit(".sql.gz"))).alias("database"),
        fmt.ellipsis(F.col("props"), 8, 6, "..").alias("props_short"),
        fmt.text_to_long(F.col("props").substr(7, 4)).alias("k_value"),
    )


REGISTRY.update({
    "backup_manifest": q_backup_manifest,
    "backup_catalog": q_backup_catalog,
    "backup_restore_roundtrip": q_backup_restore_roundtrip,
    "restore_missing": q_restore_missing,
    "restore_checks_rows": q_restore_checks_rows,
    "retention_apply": q_retention_apply,
    "retention_plan": q_retention_plan,
    "retention_plan_per_db": q_retention_plan_per_db,
    "due_rows": q_due_rows,
    "health_levels": q_health_levels,
    "cluster_health": q_cluster_health,
    "format_sizes": q_format_sizes,
    "lsn_numbers": q_lsn_numbers,
    "name_formats": q_name_formats,
})


# -- streaming keys ---------------------------------------------------------------------
from .streaming import jobs as streams  # noqa: E402


def events_stream(spark, sf_dir):
    """The events table as a file stream (schema from the batch reader, no inference)."""
    path = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def q_stream_latest_metrics(spark, sf_dir):
    s = events_stream(spark, sf_dir).select(
        (F.col("user_id") % 5).cast("int").alias("server"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value"
    )
    latest = streams.latest_metrics(s, "server", "ts", watermark=None)
    out = streams.run_to_table(latest, staging_path(spark, "latest"), "complete", staging_path(spark, "ckpt-latest"))
    return out.select("server", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value")


def q_stream_health_levels(spark, sf_dir):
    s = events_stream(spark, sf_dir).select("event_id", F.col("value").alias("lag_seconds"))
    return streams.run_to_table(streams.stream_health(s), staging_path(spark, "health"), "append", staging_path(spark, "ckpt-health"))


def q_stream_load(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    incoming = staging_path(spark, "incoming")
    write_dump(TableSet({"orders": o}), incoming + "/first", "mysql", parts=3)
    out, ckpt = staging_path(spark, "stream-out"), staging_path(spark, "stream-ckpt")
    q = streams.stream_load(spark, incoming, "orders", o.schema, out, ckpt, max_files=2)
    q.awaitTermination()
    q = streams.stream_load(spark, incoming, "orders", o.schema, out, ckpt, max_files=2)  # restart: nothing new
    q.awaitTermination()
    return spark.read.parquet(out).drop("batch")


REGISTRY.update({
    "stream_latest_metrics": q_stream_latest_metrics,
    "stream_health_levels": q_stream_health_levels,
    "stream_load": q_stream_load,
})


# -- section 3.1: SQL text over a registered table set ------------------------------------
from .tableset import run_sql  # noqa: E402

QUERY_TEXT = """
    WITH o AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM shop_orders)
    SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
    FROM o JOIN shop_customer c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_mktsegment, o.o_orderstatus
"""


def q_sql_query(spark, sf_dir):
    shop(spark, sf_dir).register("shop_")
    kind, df = run_sql(spark, QUERY_TEXT)
    assert kind == "read"
    return df


REGISTRY["sql_query"] = q_sql_query


def q_uptime_report(spark, sf_dir):
    """F16 + F10: per user, whole seconds between the first and last event and their text form."""
    e = load(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    secs = fmt.uptime_seconds(F.col("first_ts"), F.col("last_ts"))
    return per.select("user_id", "first_ts", "last_ts", secs.alias("uptime_seconds"), fmt.format_uptime(secs).alias("uptime_text"))


REGISTRY["uptime_report"] = q_uptime_report


# -- dumps of other writers ------------------------------------------------------------
from . import examples_dumps, examples_jobs  # noqa: E402

REGISTRY.update(examples_dumps.QUERIES)
REGISTRY.update(examples_jobs.QUERIES)
