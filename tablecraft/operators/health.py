"""T3 health levels and T4 replication / cluster health from collected status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import lsn_diff, text_to_long

UNHEALTHY_LAG = 60  # fixed value: seconds of lag that make a replica unhealthy
WARNING_LAG = 10  # fixed value: seconds of lag shown as a warning


def health_levels(df: DataFrame, lag: str = "lag_seconds") -> DataFrame:
    """Level unhealthy (> 60 s), warning (> 10 s) or healthy; null lag counts as 0."""
    l = F.coalesce(F.col(lag), F.lit(0.0))
    level = F.when(l > UNHEALTHY_LAG, "unhealthy").when(l > WARNING_LAG, "warning").otherwise("healthy")
    return df.withColumn("level", level).withColumn("is_healthy", l <= UNHEALTHY_LAG)


def _v(name: str) -> Column:
    return F.max(F.when(F.col("name") == name, F.col("value")))


def cluster_health(status: DataFrame, key: str = "server") -> DataFrame:
    """T4: one row per server from long-form status rows (server, ts, name, value).

    Only each server's newest snapshot counts: rows are pivoted per (server, ts)
    and the latest pivot is kept, so a name that the newest snapshot lacks is
    absent and older values never mix in. Type order: galera (wsrep_* present),
    then replication (Slave_/Replica_IO_Running, or connected replicas of a
    master), then postgres streaming (current / replay LSN or recovery state
    present), else standalone. Galera is healthy when ready and connected; a
    replica when IO and SQL threads run and lag <= 60 s; streaming when lag <=
    60 s; a master and standalone always. Both steps are hash aggregates with
    a map-side part.
    """
    snap = status.groupBy(key, "ts").agg(
        _v("wsrep_cluster_size").alias("wsrep_size"),
        _v("wsrep_ready").alias("wsrep_ready"),
        _v("wsrep_connected").alias("wsrep_connected"),
        F.coalesce(_v("Slave_IO_Running"), _v("Replica_IO_Running")).alias("io"),
        F.coalesce(_v("Slave_SQL_Running"), _v("Replica_SQL_Running")).alias("sql"),
        F.coalesce(_v("Seconds_Behind_Master"), _v("Seconds_Behind_Source")).alias("behind"),
        _v("current_lsn").alias("current_lsn"),
        _v("replay_lsn").alias("replay_lsn"),
        _v("replay_lag_seconds").alias("replay_lag"),
        _v("replicas").alias("replicas"),
        _v("in_recovery").alias("in_recovery"),
    )
    fields = [c for c in snap.columns if c not in (key, "ts")]
    p = snap.groupBy(key).agg(F.max_by(F.struct(*fields), "ts").alias("s")).select(key, "s.*")
    galera = F.col("wsrep_size").isNotNull()
    replica = F.col("io").isNotNull()
    standby = F.lower(F.coalesce("in_recovery", F.lit("f"))).isin("t", "true", "on", "1")
    stream = F.col("current_lsn").isNotNull() | standby
    master = ~replica & ~stream & (text_to_long(F.coalesce("replicas", F.lit("0"))) > 0)
    typ = F.when(galera, "galera").when(replica | master, "replication").when(stream, "postgres_streaming").otherwise("standalone")
    lag_s = F.when(replica, text_to_long(F.col("behind")).cast("double")).when(stream, F.col("replay_lag").try_cast("double")).otherwise(F.lit(0.0))
    lag_b = F.when(stream, F.coalesce(lsn_diff(F.col("current_lsn"), F.col("replay_lsn")).cast("long"), F.lit(0))).otherwise(F.lit(0).cast("long"))
    healthy = (
        F.when(galera, (F.upper(F.col("wsrep_ready")) == "ON") & (F.upper(F.col("wsrep_connected")) == "ON"))
        .when(replica, (F.col("io") == "Yes") & (F.col("sql") == "Yes") & (lag_s <= UNHEALTHY_LAG))
        .when(stream, F.coalesce(lag_s, F.lit(0.0)) <= UNHEALTHY_LAG)
        .otherwise(F.lit(True))
    )
    nodes = (
        F.when(galera, text_to_long(F.col("wsrep_size")))
        .when(replica | stream | master, text_to_long(F.col("replicas")) + 1)
        .otherwise(F.lit(1).cast("long"))
    )
    role = (
        F.when(galera, "node").when(replica, "replica").when(master, "master")
        .when(stream, F.when(standby, "standby").otherwise("primary")).otherwise("standalone")
    )
    return p.select(
        key,
        typ.alias("type"),
        role.alias("role"),
        (~role.isin("replica", "standby")).alias("is_primary"),
        F.coalesce(healthy, F.lit(False)).alias("is_healthy"),
        nodes.alias("node_count"),
        lag_b.alias("lag_bytes"),
        lag_s.alias("lag_seconds"),
    )
