"""Catalog operations: append, copy, rename, delete, views, and tables that outlive a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import NonConvertible


def append(base: DataFrame, data: DataFrame) -> DataFrame:
    """By name; columns the base lacks are refused, as APPEND refuses them without FORCE."""
    extra = set(data.columns) - set(base.columns)
    if extra:
        raise NonConvertible(f"APPEND would drop {sorted(extra)}")
    return base.unionByName(data, allowMissingColumns=True)


def view(df: DataFrame, name: str) -> DataFrame:
    """A stored query; it stays lazy."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def copy(spark: SparkSession, source: str, target: str) -> DataFrame:
    spark.table(source).write.mode("overwrite").saveAsTable(target)
    return spark.table(target)


def delete(spark: SparkSession, *names: str) -> None:
    for n in names:
        if n in {t.name for t in spark.catalog.listTables() if t.isTemporary}:
            spark.catalog.dropTempView(n)
        else:
            spark.sql(f"drop table if exists {n}")


def change(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"alter table {old} rename to {new}")
