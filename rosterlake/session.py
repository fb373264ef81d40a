"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution picks join strategies from measured sizes and splits hot
#: partitions, so no operator of the workforce part forces a broadcast by hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def partitions_for(shuffled_bytes: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """How many shuffle partitions keep each near ``target_bytes``.

    Use it for ``spark.sql.shuffle.partitions`` on a cluster; adaptive execution
    merges what turns out smaller.
    """
    return max(200, -(-shuffled_bytes // target_bytes))


def build_session(
    app_name: str = "rosterlake", master: str | None = None, **settings: str
) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
