"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution; on a cluster the size of shuffle partitions is left to AQE."""
    b = SparkSession.builder.master(master).appName("quarry")
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
