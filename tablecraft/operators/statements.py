"""Statement-level operators: P7 load filter, P8 classification, A13 batch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENTS_PER_BATCH = 100  # fixed value: statements per transaction on load


def _trim_space(c):
    """Trim all white space (spaces, tabs, line feeds), not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filter_statements(stmts: DataFrame, rename: bool = False, col: str = "stmt") -> DataFrame:
    """Drop blank and ``;``-only statements; when renaming, also drop any
    statement containing CREATE DATABASE or starting with USE (upper-cased)."""
    t = _trim_space(F.col(col))
    keep = (t != "") & (t != ";")
    if rename:
        u = F.upper(t)
        keep = keep & ~u.contains("CREATE DATABASE") & ~u.startswith("USE ")
    return stmts.where(keep)


def classify_statements(stmts: DataFrame, col: str = "stmt", cte_as_read: bool = False) -> DataFrame:
    """``kind`` = read when the trimmed, upper-cased text starts with
    SELECT / SHOW / DESCRIBE / EXPLAIN (and WITH when ``cte_as_read``), else write."""
    u = F.upper(_trim_space(F.col(col)))
    read = u.startswith("SELECT") | u.startswith("SHOW") | u.startswith("DESCRIBE") | u.startswith("EXPLAIN")
    if cte_as_read:
        read = read | u.startswith("WITH")
    return stmts.withColumn("kind", F.when(read, "read").otherwise("write"))


def batch_outcomes(stmts: DataFrame, seq: str = "stmt_no", bad: str = "bad", size: int = STATEMENTS_PER_BATCH,
                   by: tuple[str, ...] = (), error: str | None = None) -> DataFrame:
    """Statements grouped into batches of ``size`` consecutive numbers;
    a batch fails as a whole when any statement in it fails.

    Output: (by..., batch_id, statements, failed, first_error_stmt[, first_error]).
    Map-side partial aggregation keeps the shuffle at one row per batch per partition.
    """
    bid = F.floor(F.col(seq) / size).cast("long").alias("batch_id")
    aggs = [
        F.count(F.lit(1)).alias("statements"),
        F.coalesce(F.bool_or(F.col(bad)), F.lit(False)).alias("failed"),
        F.min(F.when(F.col(bad), F.col(seq))).alias("first_error_stmt"),
    ]
    if error:
        aggs.append(F.min_by(F.col(error), F.when(F.col(bad), F.col(seq))).alias("first_error"))
    return stmts.groupBy(*by, bid).agg(*aggs)


def good_rows(rows: DataFrame, outcomes: DataFrame, seq: str = "stmt_no", size: int = STATEMENTS_PER_BATCH,
              by: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose batch did not fail (anti join on the failed batch ids)."""
    failed = outcomes.where("failed").select(*by, "batch_id")
    keyed = rows.withColumn("batch_id", F.floor(F.col(seq) / size).cast("long"))
    return keyed.join(failed, [*by, "batch_id"], "left_anti").drop("batch_id")
