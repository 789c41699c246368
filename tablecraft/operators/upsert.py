"""U4 within one dump: what is left of each key after writes in order (REPLACE, INSERT IGNORE, upserts).

The result is an aggregate per key, so writes of one key are combined on the map side, however many there are: a column
has the value of its last write. The first row of a key writes all columns, a replacing row as well, an upsert those
that it sets; a row that keeps the old one writes nothing but as the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_writes(rows: DataFrame, keys: list[str], columns: list[str], position: Column, mode: str = "mode", sets: Column | None = None) -> DataFrame:
    """``columns`` of one row per key, and ``first_error``: the least position at which a write was not allowed (null: none).

    ``mode``: i (refused if the key is there), r (replaces), g (keeps the old row), u (writes the columns named in the
    array ``sets``), x (not allowed if the key is there). ``position`` orders the writes; null keys are equal.
    """
    taken = {c: f"c{i}" for i, c in enumerate(columns)}
    base = rows.select(F.col(mode).alias("mode"), position.alias("at"), (sets if sets is not None else F.array().cast("array<string>")).alias("sets"), *[F.col(f"`{c}`").alias(a) for c, a in taken.items()])

    def last(name: str, alias: str) -> list[Column]:
        writes = (F.col("mode") == "r") | ((F.col("mode") == "u") & F.array_contains("sets", name.lower()))
        value = F.struct(F.col(alias).alias("v"))
        # a first row that is no write of the column is the value to fall back to
        return [F.max_by(F.when(writes, value), F.when(writes, F.col("at"))).alias(f"last_{alias}"), F.min_by(value, "at").alias(f"first_{alias}")]

    rest = [c for c in columns if c not in keys]
    strict = F.col("mode").isin("i", "x")
    grouped = base.groupBy(*[taken[k] for k in keys]).agg(
        F.min("at").alias("begin"), F.min(F.when(strict, F.col("at"))).alias("strict_first"), F.max(F.when(strict, F.col("at"))).alias("strict_last"),
        *[a for c in rest for a in last(c, taken[c])],
    )
    value = lambda c: F.col(taken[c]) if c in keys else F.coalesce(f"last_{taken[c]}", f"first_{taken[c]}")["v"]
    # the first write may be of any mode; a strict one after it is refused
    wrong = F.when(F.col("strict_last") > F.col("begin"), F.when(F.col("strict_first") > F.col("begin"), F.col("strict_first")).otherwise(F.col("strict_last")))
    return grouped.select(*[value(c).alias(c) for c in columns], wrong.alias("first_error"))
