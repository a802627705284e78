"""Control flow on run-time data, as SQL scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import NonConvertible


def run(spark: SparkSession, script: str, args: dict | None = None) -> DataFrame:
    """A BEGIN ... END script; its result is the last query's."""
    if not script.strip().upper().startswith("BEGIN"):
        raise NonConvertible("a script starts with BEGIN")
    spark.conf.set("spark.sql.scripting.enabled", "true")
    return spark.sql(script, args=args or {})
