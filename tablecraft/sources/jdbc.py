"""MariaDB / PostgreSQL tables through Spark's JDBC source.

Only the option builder is ours; reading is ``spark.read.format("jdbc")``
with a partition column so each executor reads one key range in parallel.
No server is reachable here, so the tests check the options only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import norm_dialect

# Default ports and JDBC URL prefixes per dialect.
DEFAULT_PORT = {"mysql": 3306, "postgres": 5432}
URL_PREFIX = {"mysql": "jdbc:mariadb://", "postgres": "jdbc:postgresql://"}
DRIVER = {"mysql": "org.mariadb.jdbc.Driver", "postgres": "org.postgresql.Driver"}


def jdbc_url(dialect: str, host: str = "localhost", port: int | None = None, database: str = "", ssl: bool = False) -> str:
    d = norm_dialect(dialect)
    url = f"{URL_PREFIX[d]}{host}:{port or DEFAULT_PORT[d]}/{database}"
    if ssl:
        url += "?sslmode=require" if d == "postgres" else "?useSsl=true"
    return url


def jdbc_options(dialect: str, table: str, host: str = "localhost", port: int | None = None, database: str = "",
                 user: str | None = None, password: str | None = None, partition_column: str | None = None,
                 lower_bound: int | None = None, upper_bound: int | None = None, num_partitions: int | None = None,
                 fetch_size: int = 10000, ssl: bool = False) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``; a partitioned read needs all four range options."""
    d = norm_dialect(dialect)
    opts = {
        "url": jdbc_url(d, host, port, database, ssl),
        "dbtable": table,
        "driver": DRIVER[d],
        "fetchsize": str(fetch_size),
    }
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    ranged = [partition_column, lower_bound, upper_bound, num_partitions]
    if any(x is not None for x in ranged):
        if any(x is None for x in ranged):
            raise ValueError("partition_column, lower_bound, upper_bound and num_partitions go together")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound), upperBound=str(upper_bound),
                    numPartitions=str(num_partitions))
    return opts


def jdbc_table(spark: SparkSession, **kwargs) -> DataFrame:
    """Read one server table in parallel key ranges (needs the JDBC driver jar on the cluster)."""
    return spark.read.format("jdbc").options(**jdbc_options(**kwargs)).load()
