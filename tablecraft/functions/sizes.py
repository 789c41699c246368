"""Row-size measure (the "data size" of a table without a server catalog).

Fixed values: 8 bytes per long, double or timestamp, 4 per int, 2 per short,
1 per byte or boolean, 4 per float or date, 16 per decimal; strings and binary
count their UTF-8 / raw byte length; nested values count the bytes of their
JSON text. Nulls count 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED_WIDTH = {
    T.LongType: 8,
    T.DoubleType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.IntegerType: 4,
    T.FloatType: 4,
    T.DateType: 4,
    T.ShortType: 2,
    T.ByteType: 1,
    T.BooleanType: 1,
    T.DecimalType: 16,
}


def value_bytes(col: Column, dtype: T.DataType) -> Column:
    for cls, width in FIXED_WIDTH.items():
        if isinstance(dtype, cls):
            return F.when(col.isNull(), F.lit(0)).otherwise(F.lit(width)).cast("long")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")
    return F.coalesce(F.octet_length(F.to_json(col)), F.lit(0)).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Column expression: bytes of one row under the measure above."""
    parts = [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    if not parts:
        return F.lit(0).cast("long")
    expr = parts[0]
    for p in parts[1:]:
        expr = expr + p
    return expr
