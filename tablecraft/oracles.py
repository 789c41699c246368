"""DuckDB twins of the registered queries (plain SQL over the parquet views).

Column names are aliased exactly like the Spark side.
"""

from __future__ import annotations

# Column kinds of the given tables, for the row-bytes measure:
# L long, I int, D double, T timestamp, S string.
KINDS = {
    "region": "IS",
    "nation": "ISI",
    "customer": "LSIDS",
    "supplier": "LSID",
    "part": "LSSSID",
    "orders": "LLSDTS",
    "lineitem": "LLLIDDDDSST",
}
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
WIDTH = {"L": 8, "D": 8, "T": 8, "I": 4}
SHOP = ["customer", "orders", "lineitem"]
REF = ["region", "nation", "part", "supplier"]


def row_bytes_sql(table: str) -> str:
    parts = []
    for col, kind in zip(COLUMNS[table], KINDS[table]):
        if kind == "S":
            parts.append(f"coalesce(strlen({col}), 0)")
        else:
            parts.append(f"(CASE WHEN {col} IS NULL THEN 0 ELSE {WIDTH[kind]} END)")
    return " + ".join(parts)


def sizes_sql(tables_by_ns: dict[str, list[str]]) -> str:
    rows = []
    for ns, tables in tables_by_ns.items():
        for t in tables:
            rows.append(
                f"SELECT '{ns}' AS ns, '{t}' AS name, count(*) AS row_count, "
                f"CAST(coalesce(sum({row_bytes_sql(t)}), 0) AS BIGINT) AS data_size, CAST(0 AS BIGINT) AS index_size FROM {t}"
            )
    return "\nUNION ALL\n".join(rows)


SIZES = sizes_sql({"shop": SHOP, "ref": REF})

ORDERS_A = "(SELECT * FROM orders)"
ORDERS_B = ("(SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, "
            "o_totalprice + o_custkey % 2 AS o_totalprice, o_orderdate, o_orderpriority FROM orders)")
SYNC_SRC = (
    "(SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus, "
    "CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders)"
)
SYNC_TGT = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders)"
SYNC_JOIN = f"""
SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey,
       CASE WHEN t.o_orderkey IS NULL THEN 'insert'
            WHEN s.o_orderkey IS NULL THEN 'delete'
            WHEN s.o_custkey IS NOT DISTINCT FROM t.o_custkey AND s.o_orderstatus IS NOT DISTINCT FROM t.o_orderstatus
                 AND s.o_totalprice IS NOT DISTINCT FROM t.o_totalprice AND s.o_orderdate IS NOT DISTINCT FROM t.o_orderdate
                 THEN 'same'
            ELSE 'update' END AS action,
       s.o_totalprice AS new_price, t.o_totalprice AS old_price,
       s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderdate, CASE WHEN s.o_orderkey IS NULL THEN t.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority
FROM {SYNC_SRC} s FULL OUTER JOIN {SYNC_TGT} t ON s.o_orderkey = t.o_orderkey AND s.o_orderpriority IS NOT DISTINCT FROM t.o_orderpriority
"""
SHOP_ALL = """
SELECT 'customer' AS name, c_custkey AS k1, CAST(c_nationkey AS BIGINT) AS k2, c_acctbal AS amount, c_mktsegment AS word FROM customer
UNION ALL SELECT 'orders', o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
UNION ALL SELECT 'lineitem', l_orderkey, CAST(l_linenumber AS BIGINT), l_extendedprice, l_returnflag FROM lineitem"""
METRICS = "(SELECT CAST(user_id % 5 AS INTEGER) AS server, ts, CAST(event_type = 'view' AS INTEGER) AS hit, CAST(event_type = 'error' AS INTEGER) AS read FROM events)"
SESSIONS = "(SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN 'active' ELSE 'idle' END AS state, value * 10 AS ms FROM events)"
from .examples import PRIVILEGE_LISTS  # noqa: E402  (shared fixed values)
PRIV_ARRAY = "[" + ", ".join(f"'{p}'" for p in PRIVILEGE_LISTS) + "]"
CUST_PRIVS = f"(SELECT c_custkey, c_mktsegment AS grantee, {PRIV_ARRAY}[CAST(c_custkey % 6 AS INTEGER) + 1] AS privileges FROM customer)"
PRIV_EXPLODED = f"""(SELECT c_custkey, grantee, CAST(g.pos - 1 AS INTEGER) AS pos, g.p AS privilege_in,
   CASE upper(trim(g.p)) WHEN 'ALL' THEN 'ALL PRIVILEGES' WHEN 'INDEX' THEN 'CREATE' WHEN 'ALTER' THEN 'ALL PRIVILEGES' ELSE upper(trim(g.p)) END AS privilege
 FROM {CUST_PRIVS} cp, (SELECT unnest(string_split(cp.privileges, ',')) AS p, generate_subscripts(string_split(cp.privileges, ','), 1) AS pos) g)"""


def _merge(policy: str) -> str:
    if policy == "skip":
        return f"SELECT * FROM {ORDERS_A}"
    if policy == "replace":
        return f"SELECT * FROM {ORDERS_B}"
    if policy == "append":
        return f"SELECT * FROM {ORDERS_A} UNION ALL SELECT * FROM {ORDERS_B}"
    return f"SELECT 'orders' AS table_name, * FROM {ORDERS_A} UNION ALL SELECT 'orders_archive' AS table_name, * FROM {ORDERS_B}"


ORACLES: dict[str, str] = {
    "scan_table": "SELECT * FROM orders",
    "page_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 150",
    "copy_where": "SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'",
    "clone_table": SHOP_ALL,
    "clone_structure": "\nUNION ALL\n".join(f"SELECT '{t}' AS name, count(*) AS source_rows, CAST(0 AS BIGINT) AS copied_rows, CAST({len(COLUMNS[t])} AS BIGINT) AS columns FROM {t}" for t in SHOP),
    "copy_renamed": "SELECT * FROM lineitem WHERE l_extendedprice > 30000",
    "merge_two_sources": "SELECT 'orders' AS name, 3 * count(*) AS row_count FROM orders UNION ALL SELECT 'nation', 2 * count(*) FROM nation",
    "merge_into_target": f"SELECT * FROM {ORDERS_A} UNION ALL SELECT * FROM {ORDERS_B}",
    "like_filter": "SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%red%'",
    "exists_check": """SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c_acctbal > 9000) AS has_rich_customers
                       FROM nation n""",
    "user_namespaces": """SELECT name, lower(name) IN ('information_schema','mysql','performance_schema','sys') AS system_mysql,
                                 lower(name) IN ('postgres','template0','template1') AS system_postgres
                          FROM (SELECT lower(n_name) AS name FROM nation UNION ALL
                                SELECT upper(x) FROM (VALUES ('information_schema'),('mysql'),('performance_schema'),('sys'),('postgres'),('template0'),('template1')) v(x))
                          WHERE NOT lower(name) IN ('information_schema','mysql','performance_schema','sys')""",
    "merge_skip": _merge("skip"),
    "merge_replace": _merge("replace"),
    "merge_append": _merge("append"),
    "merge_rename": _merge("rename"),
    "schema_diff": """
        WITH a AS (SELECT table_name, count(*) AS n,
                          string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal_position) AS s
                   FROM information_schema.columns WHERE table_name IN ('customer','orders','lineitem','nation') GROUP BY table_name),
             bc AS (SELECT table_name, column_name, ordinal_position,
                           CASE WHEN table_name = 'customer' AND column_name = 'c_acctbal' THEN 'VARCHAR' ELSE data_type END AS data_type
                    FROM information_schema.columns
                    WHERE table_name IN ('customer','orders','nation','part') AND NOT (table_name = 'orders' AND column_name = 'o_orderpriority')),
             b AS (SELECT table_name, count(*) AS n, string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal_position) AS s FROM bc GROUP BY table_name)
        SELECT coalesce(a.table_name, b.table_name) AS table_name,
               CASE WHEN b.s IS NULL THEN 'only_first' WHEN a.s IS NULL THEN 'only_second'
                    WHEN a.s <> b.s THEN 'different' ELSE 'identical' END AS status,
               a.n AS first_columns, b.n AS second_columns
        FROM a FULL OUTER JOIN b ON a.table_name = b.table_name""",
    "only_in_first": f"SELECT * FROM {ORDERS_A} a WHERE NOT EXISTS (SELECT 1 FROM {ORDERS_B} b WHERE a.o_orderkey = b.o_orderkey)",
    "conflicting": f"SELECT * FROM {ORDERS_A} a WHERE EXISTS (SELECT 1 FROM {ORDERS_B} b WHERE a.o_orderkey = b.o_orderkey)",
    "sync_changes": f"SELECT o_orderkey, o_orderpriority, action, new_price, old_price FROM ({SYNC_JOIN})",
    "sync_counts": f"SELECT action, count(*) AS rows FROM ({SYNC_JOIN}) GROUP BY action",
    "sync_apply": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM ({SYNC_JOIN}) WHERE action <> 'delete'",
    "table_stats_total": f"""
        WITH s AS ({sizes_sql({'shop': SHOP})})
        SELECT CASE WHEN grouping(name) = 1 THEN 'TOTAL' ELSE name END AS name,
               CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(data_size) AS BIGINT) AS data_size,
               CAST(sum(index_size) AS BIGINT) AS index_size, CAST(sum(data_size + index_size) AS BIGINT) AS total_size
        FROM s GROUP BY ROLLUP (name)""",
    "row_counts": "\nUNION ALL\n".join(f"SELECT '{t}' AS name, count(*) AS row_count FROM {t}" for t in SHOP + REF),
    "database_size": f"""
        WITH s AS ({SIZES})
        SELECT 'shop' AS ns, CAST(coalesce(sum(data_size + index_size), 0) AS BIGINT) AS size FROM s WHERE ns = 'shop'
        UNION ALL
        SELECT 'missing' AS ns, CAST(coalesce(sum(data_size + index_size), 0) AS BIGINT) AS size FROM s WHERE ns = 'missing'""",
    "database_sizes": f"WITH s AS ({SIZES}) SELECT ns, CAST(sum(data_size + index_size) AS BIGINT) AS size FROM s GROUP BY ns",
    "database_stats": f"""
        WITH s AS ({SIZES})
        SELECT CASE WHEN grouping(ns) = 1 THEN 'TOTAL' ELSE ns END AS ns,
               CAST(coalesce(sum(data_size + index_size), 0) AS BIGINT) AS size, count(*) AS table_count
        FROM s GROUP BY ROLLUP (ns)""",
    "hit_ratio": f"""SELECT server, coalesce(round(sum(hit) * 100.0 / nullif(sum(hit) + sum(read), 0), 2), 0) AS cache_hit_rate
                     FROM {METRICS} GROUP BY server""",
    "kv_hit_ratio": f"""SELECT server, CAST(sum(hit + read) AS BIGINT) AS read_requests, CAST(sum(read) AS BIGINT) AS reads,
                               round((1.0 - sum(read) / nullif(sum(hit + read), 0)) * 100.0, 2) AS cache_hit_rate
                        FROM {METRICS} GROUP BY server""",
    "slow_count": f"SELECT CAST(count(*) FILTER (WHERE ms > 1000) AS BIGINT) AS slow_queries FROM {SESSIONS}",
    "active_count": f"SELECT CAST(count(*) FILTER (WHERE state = 'active') AS BIGINT) AS active, count(*) AS total FROM {SESSIONS}",
    "usage_levels": f"""
        WITH u AS (SELECT user_id, count(*) FILTER (WHERE state = 'active') AS active, count(*) AS max FROM {SESSIONS} GROUP BY user_id),
             p AS (SELECT *, CASE WHEN max > 0 THEN CAST(active AS DOUBLE) / max * 100.0 END AS u FROM u)
        SELECT user_id, active, max, round(u, 2) AS usage,
               CASE WHEN u >= 90 THEN 'danger' WHEN u >= 70 THEN 'warning' ELSE 'ok' END AS level FROM p""",
    "size_vs_max": f"""
        WITH s AS (SELECT ns, name, data_size + index_size AS size FROM ({SIZES}))
        SELECT ns, name, size, CASE WHEN (SELECT max(size) FROM s) > 0 THEN round(size * 100.0 / (SELECT max(size) FROM s), 2) ELSE 0.0 END AS pct FROM s""",
    "top5_more": """
        WITH u AS (SELECT user_id, round(sum(value), 2) AS total_value FROM events GROUP BY user_id)
        SELECT user_id, total_value, CAST(greatest((SELECT count(*) FROM u) - 5, 0) AS BIGINT) AS more
        FROM u ORDER BY total_value DESC, user_id LIMIT 5""",
    "tables_with_stats": """
        WITH t AS (SELECT 'db' AS ns, x AS name FROM (VALUES ('customer'),('orders'),('lineitem'),('region'),('nation'),('part'),('supplier')) v(x)
                   UNION ALL SELECT 'archive', 'orders'),
             c AS (SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders
                   UNION ALL SELECT 'lineitem', count(*) FROM lineitem)
        SELECT t.ns, t.name, CAST(coalesce(c.rows, 0) AS BIGINT) AS rows FROM t LEFT JOIN c ON t.ns = 'db' AND t.name = c.name""",
    "four_way_join_sizes": """
        WITH pc AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT r_name AS table_name, n_name AS index_name, round(sum(spent), 2) AS size, CAST(sum(n) AS BIGINT) AS orders
        FROM pc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY r_name, n_name""",
    "array_member_join": """
        SELECT l_orderkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) - 1 AS INTEGER) AS pos,
               l_linenumber, l_extendedprice FROM lineitem""",
    "privilege_map": f"SELECT * FROM {PRIV_EXPLODED}",
    "grant_report": f"""
        WITH tg AS (SELECT DISTINCT grantee, privilege, 'public' AS schema_name, 'orders' AS table_name FROM {PRIV_EXPLODED}),
             dg AS (SELECT n_name AS grantee, lower(r_name) AS database FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT grantee, privilege, schema_name AS database, table_name, schema_name || '.' || table_name AS object FROM tg
        UNION ALL
        SELECT grantee, 'CONNECT', database, '*', database || '.*' FROM dg""",
}


# ---------------------------------------------------------------------------
# dump / load twins
# ---------------------------------------------------------------------------
def esc_mysql(x: str) -> str:
    # backslash first, then quote, double quote, LF, CR, TAB, NUL, 0x1A
    e = f"replace({x}, '\\', '\\\\')"
    e = f"replace({e}, '''', '\\''')"
    e = f"replace({e}, '\"', '\\\"')"
    e = f"replace({e}, chr(10), '\\n')"
    e = f"replace({e}, chr(13), '\\r')"
    e = f"replace({e}, chr(9), '\\t')"
    e = f"replace({e}, chr(26), '\\Z')"
    return e


def lit_str(x: str, dialect: str = "mysql") -> str:
    body = esc_mysql(x) if dialect == "mysql" else f"replace({x}, '''', '''''')"
    return f"(CASE WHEN {x} IS NULL THEN 'NULL' ELSE '''' || {body} || '''' END)"


def lit_ts(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'NULL' ELSE '''' || strftime({x}, '%Y-%m-%d %H:%M:%S') || "
            f"CASE WHEN strftime({x}, '%f') <> '000000' THEN '.' || strftime({x}, '%f') ELSE '' END || '''' END)")


def lit_num(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN 'NULL' ELSE CAST({x} AS VARCHAR) END)"


def q_ident(name: str, dialect: str) -> str:
    return f"`{name}`" if dialect == "mysql" else f'"{name}"'


def prefix_sql(table: str, cols: list[str], dialect: str) -> str:
    c = ", ".join(q_ident(x, dialect) for x in cols)
    text = f"INSERT INTO {q_ident(table, dialect)} ({c}) VALUES"
    return "'" + text.replace("'", "''") + "' || chr(10)"


ORDER_TEXT_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]
ORDER_TUPLE = ("'(' || " + " || ', ' || ".join([lit_num("o_orderkey"), lit_num("o_custkey"), lit_str("o_orderstatus"), lit_ts("o_orderdate"), lit_str("o_orderpriority")]) + " || ')'")


def page_stmt(dialect: str) -> str:
    tup = "'(' || " + " || ', ' || ".join([lit_num("page_id"), lit_str("url", dialect), lit_str("html", dialect)]) + " || ')'"
    return f"{prefix_sql('pages', ['page_id', 'url', 'html'], dialect)} || {tup} || ';'"


EVENTS_COLS = "event_id, ts, user_id, event_type, value, props"

ORACLES.update({
    "sql_literals": f"""SELECT event_id, {lit_str("nullif(event_type, 'error')")} AS type_mysql, {lit_str('props')} AS props_mysql,
                               {lit_str('props', 'postgres')} AS props_pg, {lit_ts('ts')} AS ts_lit, {lit_num('user_id')} AS user_lit FROM events""",
    "sql_literals_pages": f"""SELECT page_id, {lit_str('url')} AS url_mysql, {lit_str('html')} AS html_mysql, {lit_str('html', 'postgres')} AS html_pg FROM pages""",
    "insert_batches": f"""
        WITH t AS (SELECT {ORDER_TUPLE} AS tup, row_number() OVER (ORDER BY o_orderkey) - 1 AS seq FROM orders)
        SELECT CAST(seq // 1000 AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS rows,
               {prefix_sql('orders', ORDER_TEXT_COLS, 'mysql')} || string_agg(tup, ',' || chr(10) ORDER BY seq) || ';' || chr(10) AS stmt
        FROM t GROUP BY seq // 1000""",
    "dump_lines_orders": f"SELECT {ORDER_TUPLE} AS line FROM orders",
    "dump_statements": f"SELECT {page_stmt('mysql')} AS stmt FROM pages",
    "dump_statements_pg": f"SELECT {page_stmt('postgres')} AS stmt FROM pages",
    "dump_statements_line": f"SELECT rtrim({page_stmt('mysql')}, ';') AS stmt FROM pages",
    "stmt_filter": f"SELECT {page_stmt('mysql')} AS stmt FROM pages",
    "stmt_classify": """SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'read' ELSE 'write' END AS kind,
                               CASE WHEN event_type IN ('click', 'view', 'error', 'purchase') THEN 'read' ELSE 'write' END AS kind_cte FROM events""",
    "dump_roundtrip_orders": "SELECT * FROM orders",
    "dump_roundtrip_gz": "SELECT * FROM orders",
    "dump_roundtrip_zst": "SELECT * FROM events",
    "dump_roundtrip_xz": "SELECT * FROM pages",
    "dump_roundtrip_pages": "SELECT * FROM pages",
    "dump_roundtrip_documents": "SELECT * FROM documents",
    "dump_roundtrip_customer": "SELECT * FROM customer",
    "dump_resume": "SELECT * FROM orders",
    "dump_table_subset": "SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer",
    "export_stats": "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in SHOP),
    "load_rejects": "SELECT 'events' AS \"table\", 'value does not convert to the column type' AS error, event_id FROM events WHERE value > 300",
    "load_fail_stops": """SELECT event_type, CASE WHEN event_type = 'error' THEN 0 ELSE count(*) END AS rows, event_type = 'error' AS stopped FROM events GROUP BY event_type""",
    "load_by_ddl": "SELECT * FROM supplier",
    "load_qualified": "SELECT * FROM customer",
    "roundtrip_empty": "SELECT 'empty_orders' AS name, CAST(0 AS BIGINT) AS row_count UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'structure_orders', CAST(0 AS BIGINT)",
    "load_hex_text": "SELECT page_id, url, hex(encode(url)) AS raw_hex FROM pages",
    "typed_literals": """SELECT dialect, event_id, value, user_id % 2 = 0 AS even, CAST(ts AS DATE) AS day, CAST(round(value, 2) AS DECIMAL(18,2)) AS amount,
                                hex(encode(event_type)) AS raw_hex, CASE WHEN user_id % 3 = 0 THEN props END AS maybe
                         FROM events, (VALUES ('mysql'), ('postgres')) d(dialect)""",
    "load_batch_outcomes": """SELECT CAST(event_id // 100 AS BIGINT) AS batch_id, count(*) AS statements,
                                     coalesce(bool_or(event_type = 'error'), false) AS failed,
                                     min(event_id) FILTER (WHERE event_type = 'error') AS first_error_stmt
                              FROM events GROUP BY event_id // 100""",
})


# ---------------------------------------------------------------------------
# backup / retention / schedule / health / format twins
# ---------------------------------------------------------------------------
SHOP_ROWS = "((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem))"
REF_ROWS = "((SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier))"
RET_EX = """(SELECT DISTINCT event_id AS id, ts AS timestamp, d AS database FROM (SELECT event_id, ts, unnest([event_type, 'view']) AS d FROM events))"""


def _fmt2(x: str, div: int, unit: str) -> str:
    return f"printf('%.2f {unit}', round({x} / {float(div)}, 2))"


def _fmt1(x: str, div: int, unit: str) -> str:
    return f"printf('%.1f {unit}', round({x} / {float(div)}, 1))"


def _format_bytes(x: str) -> str:
    parts = [f"WHEN {x} >= {1024 ** (i + 1)} THEN {_fmt1(x, 1024 ** (i + 1), letter + 'B')}" for i, letter in reversed(list(enumerate("KMGTPE")))]
    return f"CASE {' '.join(parts)} ELSE printf('%d B', {x}) END"


def _format_size(x: str) -> str:
    return (f"CASE WHEN {x} >= {1024**3} THEN {_fmt2(x, 1024**3, 'GB')} WHEN {x} >= {1024**2} THEN {_fmt2(x, 1024**2, 'MB')} "
            f"WHEN {x} >= 1024 THEN {_fmt2(x, 1024, 'KB')} ELSE printf('%d B', {x}) END")


def _format_uptime(x: str) -> str:
    d, h, m = f"({x} // 86400)", f"(({x} // 3600) % 24)", f"(({x} // 60) % 60)"
    return f"CASE WHEN {d} > 0 THEN printf('%dd %dh %dm', {d}, {h}, {m}) WHEN {h} > 0 THEN printf('%dh %dm', {h}, {m}) ELSE printf('%dm', {m}) END"


ORACLES.update({
    "backup_manifest": f"""SELECT 'shop' AS database, 'shop.sql' AS filename, CAST(3 AS INTEGER) AS tables, CAST({SHOP_ROWS} AS BIGINT) AS rows
                           UNION ALL SELECT 'ref', 'ref.sql', CAST(4 AS INTEGER), CAST({REF_ROWS} AS BIGINT)""",
    "backup_catalog": f"""SELECT 'shop only' AS description, CAST(1 AS INTEGER) AS n_databases, CAST({SHOP_ROWS} AS BIGINT) AS total_rows, 'none' AS compression
                          UNION ALL SELECT 'everything', CAST(2 AS INTEGER), CAST({SHOP_ROWS} + {REF_ROWS} AS BIGINT), 'gzip'""",
    "backup_restore_roundtrip": SHOP_ALL,
    "restore_checks_rows": f"SELECT 'shop' AS database, CAST({SHOP_ROWS} AS BIGINT) AS rows, true AS noticed UNION ALL SELECT 'ref', CAST({REF_ROWS} AS BIGINT), true",
    "retention_apply": f"SELECT 'set 1' AS description, CAST({REF_ROWS} AS BIGINT) AS total_rows UNION ALL SELECT 'set 2', CAST({SHOP_ROWS} + {REF_ROWS} AS BIGINT) UNION ALL SELECT 'set 3', CAST({SHOP_ROWS} AS BIGINT)",
    "restore_missing": "SELECT lower(n_name) AS name FROM nation",
    "retention_plan": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY timestamp DESC, id DESC) AS rn FROM {RET_EX})
        SELECT id, timestamp, CASE WHEN bool_and(rn > 3) THEN 'delete' ELSE 'keep' END AS action FROM r GROUP BY id, timestamp""",
    "retention_plan_per_db": f"""
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY database ORDER BY timestamp DESC, id DESC) AS rn FROM {RET_EX}),
             per AS (SELECT DISTINCT event_type AS database, length(event_type) - 3 AS retain FROM events)
        SELECT id, timestamp, CASE WHEN bool_and(coalesce(p.retain, 0) > 0 AND rn > p.retain) THEN 'delete' ELSE 'keep' END AS action
        FROM r LEFT JOIN per p USING (database) GROUP BY id, timestamp""",
    "due_rows": """
        WITH s AS (SELECT event_id AS id, event_type AS database, user_id % 4 <> 0 AS enabled,
                          ['hourly','daily','weekly','monthly','other'][event_id % 5 + 1] AS interval, ts AS next_run FROM events)
        SELECT id, database, interval, next_run,
               CASE interval WHEN 'hourly' THEN next_run + INTERVAL 1 HOUR WHEN 'daily' THEN next_run + INTERVAL 24 HOUR
                    WHEN 'weekly' THEN next_run + INTERVAL 168 HOUR
                    WHEN 'monthly' THEN date_trunc('month', next_run) + INTERVAL 1 MONTH + (day(next_run) - 1) * INTERVAL 1 DAY
                                        + (next_run - date_trunc('day', next_run))
                    ELSE next_run + INTERVAL 24 HOUR END AS following_run
        FROM s WHERE enabled AND next_run IS NOT NULL AND next_run < TIMESTAMP '2024-01-15 12:00:00'""",
    "health_levels": """
        WITH per AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id),
             l AS (SELECT user_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_ts)) / 1e6 AS lag_seconds FROM per)
        SELECT user_id, lag_seconds, CASE WHEN lag_seconds > 60 THEN 'unhealthy' WHEN lag_seconds > 10 THEN 'warning' ELSE 'healthy' END AS level,
               lag_seconds <= 60 AS is_healthy FROM l""",
    "cluster_health": """
        WITH a AS (SELECT CAST(user_id % 5 AS INTEGER) AS server, count(DISTINCT user_id) AS users,
                          count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'click') AS clicks,
                          max(user_id) AS maxu, min(user_id) AS minu, max(event_id) AS maxe FROM events GROUP BY 1)
        SELECT server,
               CASE WHEN server <= 1 THEN 'galera' WHEN server IN (2, 3) THEN 'replication' ELSE 'postgres_streaming' END AS type,
               CASE WHEN server <= 1 THEN 'node' WHEN server IN (2, 3) THEN 'replica' ELSE 'primary' END AS role,
               server NOT IN (2, 3) AS is_primary,
               CASE WHEN server <= 1 THEN errors < clicks WHEN server = 2 THEN errors % 100 <= 60 WHEN server = 3 THEN false
                    ELSE errors % 100 <= 60 END AS is_healthy,
               CAST(CASE WHEN server <= 1 THEN users WHEN server IN (2, 3) THEN 1 ELSE 3 END AS BIGINT) AS node_count,
               CAST(CASE WHEN server = 4 THEN (maxu * 4294967296 + maxe) - (minu * 4294967296 + maxe - errors) ELSE 0 END AS BIGINT) AS lag_bytes,
               CAST(CASE WHEN server <= 1 THEN 0 ELSE errors % 100 END AS DOUBLE) AS lag_seconds
        FROM a""",
    "format_sizes": f"""
        WITH s AS ({SIZES})
        SELECT ns, name, {_format_size('data_size')} AS size_text, {_format_bytes('data_size * 1000')} AS bytes_text,
               {_format_uptime('row_count * 7')} AS uptime_text FROM s""",
    "lsn_numbers": """SELECT event_id, upper(hex(user_id)) || '/' || upper(hex(event_id)) AS lsn,
                             CAST(user_id * 4294967296 + event_id AS BIGINT) AS lsn_number,
                             upper(hex(user_id)) || '/' || upper(hex(event_id)) AS lsn_back FROM events""",
    "name_formats": """
        SELECT event_id, event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.sql' AS output_name,
               strftime(ts, '%Y%m%d-%H%M%S') AS backup_id, event_type AS database,
               CASE WHEN length(props) > 8 THEN substr(props, 1, 6) || '..' ELSE props END AS props_short,
               coalesce(try_cast(regexp_extract(trim(substr(props, 7, 4)), '^[+-]?[0-9]+', 0) AS BIGINT), 0) AS k_value
        FROM events""",
})

ORACLES.update({
    "stream_latest_metrics": """SELECT CAST(user_id % 5 AS INTEGER) AS server, max(ts) AS ts, arg_max(event_id, ts) AS event_id,
                                       arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY 1""",
    "stream_health_levels": """SELECT event_id, value AS lag_seconds,
                                      CASE WHEN value > 60 THEN 'unhealthy' WHEN value > 10 THEN 'warning' ELSE 'healthy' END AS level,
                                      value <= 60 AS is_healthy FROM events""",
    "stream_load": "SELECT * FROM orders",
})

ORACLES["sql_query"] = """
    WITH o AS (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders)
    SELECT c.c_mktsegment, o.o_orderstatus, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
    FROM o JOIN customer c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_mktsegment, o.o_orderstatus"""

ORACLES["uptime_report"] = f"""
    WITH p AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id),
         s AS (SELECT *, CAST(round((epoch_us(last_ts) - epoch_us(first_ts)) / 1e6) AS INTEGER) AS uptime_seconds FROM p)
    SELECT user_id, first_ts, last_ts, uptime_seconds, {_format_uptime('uptime_seconds')} AS uptime_text FROM s"""

from .examples_dumps import SQL as _DUMP_SQL  # noqa: E402
from .examples_jobs import SQL as _JOB_SQL  # noqa: E402

_PAGE = """'INSERT INTO `pages` (`page_id`, `url`, `html`) VALUES' || {gap} || '(' || CAST(page_id AS VARCHAR) || ', ' || {url} || ', ' || {html} || ');'"""


def _pages(gap: str) -> str:
    return f"SELECT {_PAGE.format(gap=gap, url=lit_str('url'), html=lit_str('html'))} AS stmt FROM pages"


ORACLES.update(_DUMP_SQL | _JOB_SQL)
ORACLES["sync_by_digest"] = ORACLES["sync_changes"] + " WHERE action <> 'same'"
ORACLES.update({
    "dump_statements_one_line": _pages("' '"),
    "dump_statements_zst_parts": _pages("chr(10)"),
    "dump_statements_xz_parts": _pages("chr(10)"),
    "line_mode_chunks": f"SELECT 'INSERT INTO t VALUES' || chr(10) || '((' || CAST(page_id AS VARCHAR) || ', ' || {lit_str('url')} || '),' || chr(10) || chr(39) || 'a;' || chr(10) || '//' || chr(10) || chr(39) || ')' AS stmt FROM pages",
})
