"""Macro parameters and values published at step boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def run(spark: SparkSession, sql: str, args: dict, **tables: DataFrame) -> DataFrame:
    """SQL with :name markers and IDENTIFIER(:name); {name} stands for a DataFrame. Values are bound, never pasted in."""
    return spark.sql(sql, args=args, **tables)


def publish(one_row: DataFrame) -> dict:
    """CALL SYMPUT and INTO: the values of a one-row result, for the steps after it."""
    rows = one_row.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a published value needs one row, not {'none' if not rows else 'several'}")
    return rows[0].asDict()


def sysfunc(spark: SparkSession, name: str, *args):
    """%SYSFUNC: one value of a SQL function of constants, when the plan is built."""
    if not name.isidentifier():
        raise ValueError(f"not a function name: {name}")
    marks = ", ".join(f":a{i}" for i in range(len(args)))
    return spark.sql(f"select {name}({marks})", args={f"a{i}": x for i, x in enumerate(args)}).first()[0]
