"""Value formats: codes and ranges to labels."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Range:
    """low to high; None is open; inclusive unless marked."""

    low: float | None
    high: float | None
    label: str
    low_open: bool = False
    high_open: bool = False

    def holds(self, x: Column) -> Column:
        ok = x.isNotNull()
        if self.low is not None:
            ok &= (x > self.low) if self.low_open else (x >= self.low)
        if self.high is not None:
            ok &= (x < self.high) if self.high_open else (x <= self.high)
        return ok


def put_ranges(x, ranges: list[Range], other: str | None = None) -> Column:
    c = x if isinstance(x, Column) else F.col(x)
    out = None
    for r in ranges:
        out = F.when(r.holds(c), r.label) if out is None else out.when(r.holds(c), r.label)
    return out.otherwise(F.lit(other) if other is not None else c.cast("string"))


def put_values(x, labels: dict, other: str | None = None) -> Column:
    c = x if isinstance(x, Column) else F.col(x)
    out = None
    for code, label in labels.items():
        out = F.when(c == code, label) if out is None else out.when(c == code, label)
    return out.otherwise(F.lit(other) if other is not None else c.cast("string"))


def put_table(df: DataFrame, column: str, table: DataFrame, code: str, label: str, out: str, other: str | None = None) -> DataFrame:
    """A format held in a table (first label of a code counts); no broadcast is forced, AQE decides by the table's size."""
    first = table.groupBy(F.col(code).alias("_code")).agg(F.min(label).alias("_label"))
    rest = F.lit(other) if other is not None else F.col(column).cast("string")
    return df.join(first, F.col(column) == F.col("_code"), "left").withColumn(out, F.coalesce("_label", rest)).drop("_code", "_label")


def input_values(x, labels: dict, other=None) -> Column:
    """The reverse of put_values: label to code."""
    return put_values(x, {v: k for k, v in labels.items()}, None) if other is None else put_values(x, {v: k for k, v in labels.items()}, other)
