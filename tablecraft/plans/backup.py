"""K6 backup sets, S7 backup catalog, S8 restore.

A backup set is a folder ``<root>/<id>/`` holding one dump per database and
a ``metadata.json`` manifest. The manifest is written last and commits the
set: a folder without one is no backup set to any reader here, and no rename
is needed, which object stores do not have. On any error the folder is
removed. The manifest numbers (tables, rows, bytes) come from the dump
jobs' observed metrics, not from extra scans.
"""

from __future__ import annotations

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bulk import missing as missing_names
from ..operators.retention import retention_plan
from ..operators.stats import SYSTEM_NAMESPACES
from ..sources import fs
from ..tableset import TableSet
from .dump import write_dump
from .load import load_dump

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("databases", T.ArrayType(T.StringType())),
        T.StructField(
            "files",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("database", T.StringType()),
                        T.StructField("filename", T.StringType()),
                        T.StructField("size", T.LongType()),
                        T.StructField("tables", T.IntegerType()),
                        T.StructField("rows", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("total_size", T.LongType()),
        T.StructField("compression", T.StringType()),
        T.StructField("server_version", T.StringType()),
        T.StructField("server_type", T.StringType()),
        T.StructField("profile", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)

CODEC_SUFFIX = {None: "", "gzip": ".gz", "zstd": ".zst", "xz": ".xz"}


def _new_id(root: str, now: dt.datetime) -> str:
    base = now.strftime("%Y%m%d-%H%M%S")
    bid, n = base, 1
    while fs.exists(f"{root}/{bid}"):
        n += 1
        bid = f"{base}-{n}"  # D19: one-second ids get a suffix on collision
    return bid


def create_backup(sets: list[TableSet], root: str, databases: list[str] | None = None, codec: str | None = None,
                  description: str | None = None, profile: str | None = None, dialect: str = "mysql", parallel: int = 4) -> dict:
    """K6: dump every non-system database (or the listed ones) into a new backup set, ``parallel`` databases at a time.

    The files of the manifest are in the order of the databases. The first database that fails ends the backup.
    """
    root = root.rstrip("/")
    by_name = {ts.name: ts for ts in sets}
    if databases is None:
        names = [n for n in by_name if n.lower() not in SYSTEM_NAMESPACES["mysql"] + SYSTEM_NAMESPACES["postgres"]]
    else:
        missing = [d for d in databases if d not in by_name]
        if missing:
            raise KeyError(f"databases not found: {missing}")
        names = list(databases)
    now = dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    bid = _new_id(root, now)
    stage = f"{root}/{bid}"
    try:
        def one(name: str) -> dict:
            fname = f"{name}.sql{CODEC_SUFFIX[codec]}"
            st = write_dump(by_name[name], f"{stage}/{fname}", dialect, codec=codec)
            return {"database": name, "filename": fname, "size": st.bytes, "tables": len(st.tables), "rows": st.rows}

        # zstd and xz go through a Python data source, which must be called from this thread (see write_dump)
        if parallel > 1 and len(names) > 1 and codec not in ("zstd", "zst", "xz"):
            with ThreadPoolExecutor(max_workers=parallel) as pool:
                files = list(pool.map(one, names))
        else:
            files = [one(n) for n in names]
        manifest = {
            "id": bid,
            "timestamp": now.isoformat().replace("+00:00", "Z"),
            "databases": names,
            "files": files,
            "total_size": sum(f["size"] for f in files),
            "compression": codec or "none",
            "server_version": pyspark.__version__,
            "server_type": "spark",
        }
        if profile:
            manifest["profile"] = profile
        if description:
            manifest["description"] = description
        fs.write_bytes(f"{stage}/metadata.json", json.dumps(manifest, indent=2).encode())
    except BaseException:
        fs.delete_dir(stage)
        raise
    return manifest


def read_backups(spark: SparkSession, root: str) -> DataFrame:
    """Every ``<root>/*/metadata.json``; unreadable or invalid ones are skipped; newest first.

    An empty or absent root has no backups.
    """
    manifests = [f"{d}/metadata.json" for d in fs.list_dirs(root.rstrip("/")) if fs.exists(f"{d}/metadata.json")]
    if not manifests:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    df = (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(manifests)
    )
    return df.where(F.col("id").isNotNull()).orderBy(F.desc("timestamp"), F.desc("id"))


def get_backup(root: str, backup_id: str) -> dict:
    return json.loads(fs.read_bytes(f"{root.rstrip('/')}/{backup_id}/metadata.json"))


def missing_databases(spark: SparkSession, requested: DataFrame, manifest_files: DataFrame) -> DataFrame:
    """J5 restore pre-check: requested database names without a file in the set."""
    return missing_names(requested, manifest_files.select(F.col("database").alias("name")))


def delete_backup(root: str, backup_id: str) -> None:
    """Remove a backup set; an unknown id is an error."""
    folder = f"{root.rstrip('/')}/{backup_id}"
    if not backup_id or "/" in backup_id or not fs.exists(f"{folder}/metadata.json"):
        raise KeyError(f"no backup {backup_id!r}")
    fs.delete_dir(folder)


def apply_retention(spark: SparkSession, root: str, retain: int) -> list[str]:
    """Delete the sets that the retention plan (W1) expires; returns their ids."""
    plan = retention_plan(read_backups(spark, root).select("id", "timestamp", "databases"), retain)
    expired = sorted(r["id"] for r in plan.where("action = 'delete'").select("id").collect())
    for backup_id in expired:
        delete_backup(root, backup_id)
    return expired


def restore_backup(spark: SparkSession, root: str, backup_id: str, databases: list[str] | None = None,
                   rename: dict | None = None, dialect: str = "mysql") -> dict[str, TableSet]:
    """Load the chosen databases (default all) of a backup set, optionally renamed.

    Raises when a statement does not load, or when a database's rows differ from the manifest's number.
    """
    man = get_backup(root, backup_id)
    wanted = list(databases) if databases else list(man["databases"])
    have = {f["database"]: f for f in man["files"]}
    missing = [d for d in wanted if d not in have]
    if missing:
        raise KeyError(f"backup {backup_id} has no dump for: {missing}")
    out = {}
    for d in wanted:
        target = (rename or {}).get(d, d)
        res = load_dump(spark, f"{root.rstrip('/')}/{backup_id}/{have[d]['filename']}", dialect)
        rows = sum(df.count() for df in res.tables.values())
        if rows != have[d]["rows"]:
            raise ValueError(f"backup {backup_id}: {d} has {rows} rows, its manifest says {have[d]['rows']}")
        out[target] = res.tables.renamed(target)
    return out
