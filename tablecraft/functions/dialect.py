"""SQL text rendering per dialect as Column expressions.

Everything here stays inside whole-stage codegen: no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_dialect(d: str) -> str:
    d = d.lower()
    if d in ("mysql", "mariadb"):
        return "mysql"
    if d in ("postgres", "postgresql", "pg"):
        return "postgres"
    raise ValueError(f"unknown dialect {d}")


# MySQL string escapes, backslash first.
MYSQL_ESCAPES = [
    ("\\", "\\\\"),
    ("'", "\\'"),
    ('"', '\\"'),
    ("\n", "\\n"),
    ("\r", "\\r"),
    ("\t", "\\t"),
    ("\x00", "\\0"),
    ("\x1a", "\\Z"),
]


_MYSQL_SPECIALS = r"""[\\'"\n\r\t\x00\x1a]"""  # Java regex: backslash, quotes, LF, CR, TAB, NUL, 0x1A


def escape_mysql(col: Column) -> Column:
    """backslash escapes (backslash first so later escapes are not doubled).

    The eight replaces only run on values that hold one of the characters;
    the common value is checked with one character-class scan and kept.
    """
    out = col
    for a, b in MYSQL_ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(col.rlike(_MYSQL_SPECIALS), out).otherwise(col)


def escape_postgres(col: Column) -> Column:
    """standard SQL escaping - a single quote is doubled."""
    return F.replace(col, F.lit("'"), F.lit("''"))


def escape(col: Column, dialect: str) -> Column:
    return escape_mysql(col) if norm_dialect(dialect) == "mysql" else escape_postgres(col)


def quote_ident(name: str, dialect: str) -> str:
    """backticks (MySQL) or double quotes (Postgres), the quote char doubled."""
    if norm_dialect(dialect) == "mysql":
        return "`" + name.replace("`", "``") + "`"
    return '"' + name.replace('"', '""') + '"'


def looks_binary(col: Column) -> Column:
    """any byte below 32 other than LF, CR, TAB."""
    return F.hex(col).rlike("^(..)*?(0[0-8BCEF]|1[0-9A-F])")


def timestamp_text(col: Column, ntz: bool = False) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` plus ``.SSSSSS`` when the fraction is non-zero.

    Zoned timestamps render in the session time zone; timestamp_ntz values
    render from their own fields, so no zone (or DST gap) can shift them.
    """
    if ntz:
        # the string cast of timestamp_ntz is zone-free and drops trailing zeros of the fraction
        s = col.cast("string")
        return F.when(s.contains("."), F.rpad(s, 26, "0")).otherwise(s)
    frac = F.date_format(col, "SSSSSS")
    return F.concat(F.date_format(col, "yyyy-MM-dd HH:mm:ss"), F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")))


def _q(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def sql_literal(col: Column, dtype: T.DataType, dialect: str = "mysql") -> Column:
    """K2: one value as SQL literal text; NULL for nulls.

    integers: digits; float/double: Spark's shortest round-trip text (NaN and
    infinities quoted); boolean: 1/0 (mysql) or true/false (postgres);
    timestamp/date: quoted text; string: quoted + dialect escape; binary:
    X'HEX' (mysql) or '\\xHEX' (postgres), always (D14); decimal and nested
    values: quoted text (nested as JSON).
    """
    d = norm_dialect(dialect)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        v = col.cast("string")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        s = col.cast("string")
        v = F.when(F.isnan(col) | (F.abs(col) == float("inf")), _q(s)).otherwise(s)
    elif isinstance(dtype, T.BooleanType):
        v = F.when(col, F.lit("1" if d == "mysql" else "true")).otherwise(F.lit("0" if d == "mysql" else "false"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        v = _q(timestamp_text(col, ntz=isinstance(dtype, T.TimestampNTZType)))
    elif isinstance(dtype, T.DateType):
        v = _q(F.date_format(col, "yyyy-MM-dd"))
    elif isinstance(dtype, T.StringType):
        v = _q(escape(col, d))
    elif isinstance(dtype, T.BinaryType):
        v = F.concat(F.lit("X'"), F.hex(col), F.lit("'")) if d == "mysql" else F.concat(F.lit("'\\x"), F.hex(col), F.lit("'"))
    elif isinstance(dtype, T.DecimalType):
        v = _q(col.cast("string"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        v = _q(escape(F.to_json(col), d))
    else:
        v = _q(escape(col.cast("string"), d))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(v)


def row_tuple(schema: T.StructType, dialect: str = "mysql") -> Column:
    """``(v1, v2, ...)`` text of one row."""
    parts = [sql_literal(F.col(f"`{f.name}`"), f.dataType, dialect) for f in schema.fields]
    return F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")"))


def insert_prefix(table: str, columns: list[str], dialect: str = "mysql") -> str:
    cols = ", ".join(quote_ident(c, dialect) for c in columns)
    return f"INSERT INTO {quote_ident(table, dialect)} ({cols}) VALUES\n"


# ---------------------------------------------------------------------------
# K4 DDL
# ---------------------------------------------------------------------------

def sql_type(dtype: T.DataType, dialect: str) -> str:
    d = norm_dialect(dialect)
    m = {
        T.ByteType: ("TINYINT", "SMALLINT"),
        T.ShortType: ("SMALLINT", "SMALLINT"),
        T.IntegerType: ("INT", "INTEGER"),
        T.LongType: ("BIGINT", "BIGINT"),
        T.FloatType: ("FLOAT", "REAL"),
        T.DoubleType: ("DOUBLE", "DOUBLE PRECISION"),
        T.BooleanType: ("BOOLEAN", "BOOLEAN"),
        T.DateType: ("DATE", "DATE"),
        T.TimestampType: ("DATETIME(6)", "TIMESTAMP WITH TIME ZONE"),
        T.TimestampNTZType: ("DATETIME(6)", "TIMESTAMP"),
        T.StringType: ("LONGTEXT", "TEXT"),
        T.BinaryType: ("LONGBLOB", "BYTEA"),
    }
    for cls, (my, pg) in m.items():
        if isinstance(dtype, cls):
            return my if d == "mysql" else pg
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})" if d == "mysql" else f"NUMERIC({dtype.precision},{dtype.scale})"
    return "JSON" if d == "mysql" else "JSONB"


def create_table_sql(schema: T.StructType, table: str, dialect: str = "mysql", primary_key: list[str] | None = None,
                     defaults: dict[str, str] | None = None, lengths: dict[str, int] | None = None) -> str:
    """K4: CREATE TABLE text from a schema: name, type, NOT NULL, DEFAULT, PRIMARY KEY.

    ``defaults``: {column: SQL text of its default}. ``lengths``: {column: most characters of a text}; MySQL text columns
    with a length are VARCHAR, and only those can have a default.
    """
    lines = []
    for f in schema.fields:
        kind = sql_type(f.dataType, dialect)
        if isinstance(f.dataType, T.StringType) and f.name in (lengths or {}):
            kind = f"VARCHAR({lengths[f.name]})"
        line = f"  {quote_ident(f.name, dialect)} {kind}"
        if not f.nullable:
            line += " NOT NULL"
        if f.name in (defaults or {}):
            line += f" DEFAULT {defaults[f.name]}"
        lines.append(line)
    if primary_key:
        lines.append(f"  PRIMARY KEY ({', '.join(quote_ident(c, dialect) for c in primary_key)})")
    return f"CREATE TABLE {quote_ident(table, dialect)} (\n" + ",\n".join(lines) + "\n);"


def drop_table_sql(table: str, dialect: str = "mysql") -> str:
    return f"DROP TABLE IF EXISTS {quote_ident(table, dialect)};"
