"""Text formatting and small conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB, MB, GB = 1024, 1024**2, 1024**3


def format_size(b: Column) -> Column:
    """F8: ``%.2f GB/MB/KB`` on a 1024 base, else ``n B`` (stops at GB)."""
    d = b.cast("double")
    return (
        F.when(b >= GB, F.format_string("%.2f GB", d / GB))
        .when(b >= MB, F.format_string("%.2f MB", d / MB))
        .when(b >= KB, F.format_string("%.2f KB", d / KB))
        .otherwise(F.format_string("%d B", b.cast("long")))
    )


# Unit letters for format_bytes, from kilo to exa.
UNIT_LETTERS = "KMGTPE"


def format_bytes(b: Column) -> Column:
    """one decimal with the largest unit K..E that keeps the value >= 1."""
    out = F.format_string("%d B", b.cast("long"))
    for i, letter in enumerate(UNIT_LETTERS):
        div = 1024 ** (i + 1)
        out = F.when(b >= div, F.format_string(f"%.1f {letter}B", b.cast("double") / div)).otherwise(out)
    return out


def format_uptime(seconds: Column) -> Column:
    """``Dd Hh Mm``, ``Hh Mm`` or ``Mm`` from whole seconds."""
    s = seconds.cast("long")
    days = F.floor(s / 86400)
    hours = F.floor(s / 3600) % 24
    minutes = F.floor(s / 60) % 60
    return (
        F.when(days > 0, F.format_string("%dd %dh %dm", days, hours, minutes))
        .when(hours > 0, F.format_string("%dh %dm", hours, minutes))
        .otherwise(F.format_string("%dm", minutes))
    )


def ellipsis(text: Column, limit: int, keep: int, mark: str) -> Column:
    """text longer than ``limit`` becomes its first ``keep`` characters plus ``mark``."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit(mark))).otherwise(text)


def backup_id(ts: Column) -> Column:
    """``yyyyMMdd-HHmmss``."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole-microsecond difference in seconds (works for timestamp and timestamp_ntz)."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def replication_lag(is_replica: Column, last_replay: Column, now: Column) -> Column:
    """seconds since a replica's last replayed transaction; 0 on a primary, and where nothing was replayed yet."""
    return F.when(is_replica, F.coalesce(seconds_between(last_replay, now), F.lit(0.0))).otherwise(F.lit(0.0))


def uptime_seconds(start: Column, now: Column) -> Column:
    """F16: whole seconds since ``start``, rounded like ``EXTRACT(EPOCH ...)::integer``."""
    return F.round(seconds_between(start, now)).cast("int")


def lsn_to_number(lsn: Column) -> Column:
    """Postgres LSN text ``HI/LO`` (hex) -> HI * 2^32 + LO as decimal(20,0)."""
    hi = F.conv(F.split(lsn, "/").getItem(0), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.split(lsn, "/").getItem(1), 16, 10).cast("decimal(20,0)")
    return (hi * F.lit(4294967296).cast("decimal(20,0)") + lo).cast("decimal(20,0)")


def lsn_diff(a: Column, b: Column) -> Column:
    """``pg_wal_lsn_diff(a, b)``."""
    return (lsn_to_number(a) - lsn_to_number(b)).cast("decimal(21,0)")


def number_to_lsn(n: Column) -> Column:
    return F.concat(F.upper(F.conv(F.floor(n / 4294967296).cast("string"), 10, 16)), F.lit("/"), F.upper(F.conv((n % 4294967296).cast("string"), 10, 16)))


# Compression suffixes stripped from a dump file name, in order.
COMPRESSION_SUFFIXES = [".gz", ".xz", ".zst", ".zstd", ".gzip"]


def database_from_path(path: Column) -> Column:
    """base name, compression suffixes stripped in order, then the last extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    for ext in COMPRESSION_SUFFIXES:
        base = F.when(base.endswith(ext), F.substring(base, F.lit(1), F.length(base) - len(ext))).otherwise(base)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def output_name(db: Column, ts: Column) -> Column:
    """``<db>_yyyyMMdd_HHmmss.sql``."""
    return F.concat(db, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".sql"))


def column_key(default: Column) -> Column:
    """default starting with nextval -> PRI, another default -> MUL, none -> ''."""
    return F.when(default.startswith("nextval"), "PRI").when(default.isNotNull(), "MUL").otherwise("")


def text_to_long(col: Column) -> Column:
    """leading integer of a text value, 0 when there is none."""
    return F.coalesce(F.regexp_extract(F.trim(col), r"^[+-]?[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("long"))
