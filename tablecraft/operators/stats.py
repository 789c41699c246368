"""Size, count, usage and catalog analytics.

Every function takes and returns DataFrames. Per-table work is one partial
aggregate per table (map-side combine) and the union of the one-row results
is what gets grouped, so the only shuffles carry a few rows per table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formats import text_to_long
from ..functions.sizes import row_bytes
from ..tableset import TableSet

# ---------------------------------------------------------------------------
# A1 / A5 / A2-A4
# ---------------------------------------------------------------------------

def row_counts(ts: TableSet) -> DataFrame:
    """A1: exact row count per table, one job over the union of per-table counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count") for name, df in ts.items()]
    return _union_all(parts)


def table_sizes(sets: Iterable[TableSet], index_sizes: DataFrame | None = None) -> DataFrame:
    """(ns, name, row_count, data_size, index_size) for every table of every set.

    ``data_size`` is the row-bytes measure; ``index_size`` comes from an optional
    catalog frame (ns, name, index_size) and is 0 otherwise.
    """
    parts = []
    for ts in sets:
        for name, df in ts.items():
            parts.append(
                df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).cast("long").alias("data_size"))
                .select(F.lit(ts.name).alias("ns"), F.lit(name).alias("name"), "row_count", "data_size")
            )
    out = _union_all(parts)
    if index_sizes is not None:
        out = out.join(index_sizes.select("ns", "name", "index_size"), ["ns", "name"], "left")  # AQE broadcasts it when small
        out = out.withColumn("index_size", F.coalesce(F.col("index_size").cast("long"), F.lit(0).cast("long")))
    else:
        out = out.withColumn("index_size", F.lit(0).cast("long"))
    return out


def table_stats(ts: TableSet, total: bool = True, index_sizes: DataFrame | None = None) -> DataFrame:
    """A5: per table row count, data, index and total bytes, biggest first, plus a TOTAL row."""
    sizes = table_sizes([ts], index_sizes)
    cols = [
        F.sum("row_count").cast("long").alias("row_count"),
        F.sum("data_size").cast("long").alias("data_size"),
        F.sum("index_size").cast("long").alias("index_size"),
        F.sum(F.col("data_size") + F.col("index_size")).cast("long").alias("total_size"),
    ]
    if total:
        out = sizes.rollup("name").agg(*cols, F.grouping("name").alias("_g"))
        out = out.select(
            F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("name")).alias("name"),
            "row_count", "data_size", "index_size", "total_size", F.col("_g"),
        )
        return out.orderBy(F.col("_g"), F.desc("total_size"), "name").drop("_g")
    out = sizes.groupBy("name").agg(*cols)
    return out.orderBy(F.desc("total_size"), "name")


def database_size(sizes: DataFrame, database: str) -> DataFrame:
    """A2: ``COALESCE(SUM(data + index), 0)`` of one namespace; an empty match gives 0."""
    return sizes.where(F.col("ns") == database).agg(
        F.coalesce(F.sum(F.col("data_size") + F.col("index_size")), F.lit(0)).cast("long").alias("size")
    )


def database_sizes(sizes: DataFrame) -> DataFrame:
    """A3: size per namespace; no coalesce, so an all-null group stays NULL."""
    return sizes.groupBy("ns").agg(F.sum(F.col("data_size") + F.col("index_size")).cast("long").alias("size"))


def database_stats(sizes: DataFrame, server_total: bool = True) -> DataFrame:
    """A4: per namespace size and table count, plus the server total row (ns NULL -> 'TOTAL')."""
    aggs = [
        F.coalesce(F.sum(F.col("data_size") + F.col("index_size")), F.lit(0)).cast("long").alias("size"),
        F.count(F.lit(1)).alias("table_count"),
    ]
    if not server_total:
        return sizes.groupBy("ns").agg(*aggs)
    out = sizes.rollup("ns").agg(*aggs, F.grouping("ns").alias("_g"))
    return out.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("ns")).alias("ns"), "size", "table_count")


# ---------------------------------------------------------------------------
# A6-A11
# ---------------------------------------------------------------------------

def hit_ratio(df: DataFrame, hit: Column | str, read: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """``COALESCE(ROUND(sum(hit)*100 / NULLIF(sum(hit)+sum(read), 0), 2), 0)``."""
    hit, read = _c(hit), _c(read)
    h, r = F.sum(hit), F.sum(read)
    ratio = F.coalesce(F.round(h * 100.0 / F.nullif(h + r, F.lit(0)), 2), F.lit(0.0)).alias("cache_hit_rate")
    return df.groupBy(*by).agg(ratio) if by else df.agg(ratio)


def kv_hit_ratio(status: DataFrame, requests_name: str, reads_name: str, by: Sequence[str] = ("server",)) -> DataFrame:
    """``(1 - reads / NULLIF(requests, 0)) * 100`` from key/value status rows (null when unknown)."""
    req = F.max(F.when(F.col("name") == requests_name, text_to_long(F.col("value"))))
    rd = F.max(F.when(F.col("name") == reads_name, text_to_long(F.col("value"))))
    out = status.groupBy(*by).agg(req.alias("read_requests"), rd.alias("reads"))
    return out.withColumn(
        "cache_hit_rate", F.round((F.lit(1.0) - F.col("reads") / F.nullif(F.col("read_requests"), F.lit(0))) * 100.0, 2)
    )


def slow_count(df: DataFrame, ms: Column | str, threshold: float = 1000, by: Sequence[str] = ()) -> DataFrame:
    """Statements slower than ``threshold`` ms, COALESCE 0."""
    agg = F.coalesce(F.count_if(_c(ms) > threshold), F.lit(0)).cast("long").alias("slow_queries")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def active_count(df: DataFrame, state: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """Sessions with state 'active' and all sessions."""
    aggs = [F.count_if(_c(state) == "active").cast("long").alias("active"), F.count(F.lit(1)).alias("total")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def usage_levels(df: DataFrame, active: str = "active", maximum: str = "max") -> DataFrame:
    """Usage percent ``active/max*100`` when max > 0; >= 90 danger, >= 70 warning, else ok."""
    usage = F.when(F.col(maximum) > 0, F.col(active).cast("double") / F.col(maximum) * 100.0)
    level = F.when(usage >= 90, "danger").when(usage >= 70, "warning").otherwise("ok")
    return df.withColumn("usage", F.round(usage, 2)).withColumn("level", level)


def share_of_max(df: DataFrame, col: str, out: str = "pct") -> DataFrame:
    """A10: ``col / max(col) * 100``, 0 when the maximum is 0.

    The maximum is a scalar subquery (computed once, no window over all rows,
    no cross join), so this also works on large frames.
    """
    mx = df.select(F.max(col)).scalar()
    return df.withColumn(out, F.when(mx > 0, F.round(F.col(col) * 100.0 / mx, 2)).otherwise(F.lit(0.0)))


def exists(df: DataFrame, predicate: Column | str | None = None) -> bool:
    """Is there at least one row (matching ``predicate``)? Stops at the first hit."""
    if predicate is not None:
        df = df.where(predicate)
    return len(df.limit(1).take(1)) > 0


def has_match(left: DataFrame, right: DataFrame, on: Sequence[str], out: str = "present") -> DataFrame:
    """A11 as a column: every left row plus EXISTS(right row with the same key).

    The right side is reduced to its distinct keys before the join, so a hot
    key on the right costs one row, not a fan-out.
    """
    keys = right.select(*on).distinct().withColumn(out, F.lit(True))
    return left.join(keys, list(on), "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


# ---------------------------------------------------------------------------
# W2 top n and "n more"
# ---------------------------------------------------------------------------

def top_n(df: DataFrame, by: str, n: int = 5, tie: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """W2 (D5 fixed: really sorted). Global form is a TakeOrderedAndProject
    (per-partition top-n, then a merge of n rows per partition); the grouped
    form filters ``row_number <= n`` which Spark turns into a partial
    WindowGroupLimit before the shuffle.
    """
    order = [F.desc(by)] + [F.col(t) for t in tie]
    if group is None:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n_more(df: DataFrame, by: str, n: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` rows plus ``more`` = rows not shown (scalar subquery count)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return top_n(df, by, n, tie).withColumn("more", F.greatest(total - F.lit(n), F.lit(0)).cast("long"))


# ---------------------------------------------------------------------------
# Catalog joins J1-J3
# ---------------------------------------------------------------------------

def tables_with_stats(tables: DataFrame, stats: DataFrame, keys: Sequence[str] = ("ns", "name")) -> DataFrame:
    """Tables LEFT JOIN live stats on (namespace, name), rows COALESCE 0, sorted by name."""
    out = tables.join(stats, list(keys), "left").withColumn("rows", F.coalesce(F.col("rows"), F.lit(0)).cast("long"))
    return out.orderBy(*keys)


def base_tables(catalog: DataFrame, schema: str = "public") -> DataFrame:
    """Catalog rows of plain tables in one schema (type BASE TABLE), sorted by name."""
    return catalog.where((F.col("table_schema") == schema) & (F.col("table_type") == "BASE TABLE")).orderBy("table_name")


def primary_key_columns(indexes: DataFrame, attributes: DataFrame, key_array: str = "keys", on: str = "table") -> DataFrame:
    """Attribute number = ANY(key array) as posexplode + equi join (keeps key order).

    ``indexes``: (table, keys array<long>); ``attributes``: (table, attnum, ...).
    """
    ex = indexes.select(on, F.posexplode(key_array).alias("pos", "attnum"))
    return ex.join(attributes, [on, "attnum"], "inner")


# ---------------------------------------------------------------------------
# J7 privilege mapping, U1 grant report, P4 / P5 filters
# ---------------------------------------------------------------------------

def map_privilege(col: Column) -> Column:
    """MySQL privilege word -> Postgres privilege (trim, upper first).

    Fixed values: ALL -> ALL PRIVILEGES; INDEX -> CREATE; ALTER -> ALL PRIVILEGES; others unchanged.
    """
    p = F.upper(F.trim(col))
    return (
        F.when(p == "ALL", "ALL PRIVILEGES")
        .when(p == "INDEX", "CREATE")
        .when(p == "ALTER", "ALL PRIVILEGES")
        .otherwise(p)
    )


def map_privileges(df: DataFrame, col: str = "privileges", sep: str = ",") -> DataFrame:
    """Explode a comma list of privileges and map each one."""
    ex = df.select("*", F.posexplode(F.split(F.col(col), sep)).alias("pos", "privilege_in"))
    return ex.withColumn("privilege", map_privilege(F.col("privilege_in"))).drop(col)


def grant_report(table_grants: DataFrame, db_grants: DataFrame) -> DataFrame:
    """Table grants UNION ALL database connect rights, null padded, then defaults.

    ``table_grants``: (grantee, privilege, schema_name, table_name);
    ``db_grants``: (grantee, database). Defaults: privilege CONNECT, table '*';
    object = schema.table (``concat`` gives NULL only when a side is NULL,
    hence the explicit defaults first).
    """
    u = table_grants.unionByName(db_grants, allowMissingColumns=True)
    return u.select(
        "grantee",
        F.coalesce(F.col("privilege"), F.lit("CONNECT")).alias("privilege"),
        F.coalesce(F.col("database"), F.col("schema_name")).alias("database"),
        F.coalesce(F.col("table_name"), F.lit("*")).alias("table_name"),
        F.concat(F.coalesce(F.col("schema_name"), F.col("database")), F.lit("."), F.coalesce(F.col("table_name"), F.lit("*"))).alias("object"),
    ).orderBy("grantee", "database", "object")


# System databases per dialect.
SYSTEM_NAMESPACES = {
    "postgres": ["postgres", "template0", "template1"],
    "mysql": ["information_schema", "mysql", "performance_schema", "sys"],
}


def is_system_namespace(col: Column, dialect: str = "mysql") -> Column:
    """Lower-cased name is one of the dialect's system databases."""
    return F.lower(col).isin(SYSTEM_NAMESPACES[_dialect(dialect)])


def like_filter(df: DataFrame, col: str, pattern: str | None) -> DataFrame:
    """P5: LIKE filter; an empty pattern means '%'."""
    return df.where(F.col(col).like(pattern or "%"))


# ---------------------------------------------------------------------------

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _dialect(d: str) -> str:
    d = d.lower()
    if d in ("mysql", "mariadb"):
        return "mysql"
    if d in ("postgres", "postgresql", "pg"):
        return "postgres"
    raise ValueError(f"unknown dialect {d}")


def _union_all(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("empty table set")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# J2 index sizes, J7 renames, A12 totals of a job
# ---------------------------------------------------------------------------
def index_sizes(indexes: DataFrame, classes: DataFrame, namespaces: DataFrame, schema: str = "public") -> DataFrame:
    """table_name, index_name, size of every index on a table of ``schema``, largest first.

    ``indexes`` (index_id, table_id), ``classes`` (id, name, namespace_id, size) of tables and indexes alike,
    ``namespaces`` (id, name). The schema is that of the table.
    """
    inside = namespaces.where(F.col("name") == schema).select(F.col("id").alias("namespace_id"))
    tables = classes.join(inside, "namespace_id").select(F.col("id").alias("table_id"), F.col("name").alias("table_name"))
    named = classes.select(F.col("id").alias("index_id"), F.col("name").alias("index_name"), "size")
    return indexes.join(tables, "table_id").join(named, "index_id").select("table_name", "index_name", "size").orderBy(F.desc("size"), "table_name", "index_name")


def rename_lookup(df: DataFrame, mapping: dict[str, str], col: str = "name", out: str = "target") -> DataFrame:
    """``out`` is the new name that ``mapping`` has for ``col``, or the name itself."""
    new = F.lit(None).cast("string")
    if mapping:
        new = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[F.col(f"`{col}`")]
    return df.withColumn(out, F.coalesce(new, F.col(f"`{col}`")))


def job_totals(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, tables, rows and bytes of a job, from one row per file (size, tables, rows); 0 without files."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), total("tables").alias("tables"), total("rows").alias("rows"), total("size").alias("bytes"))
