"""Merging, updating, look-ups, stacking, transposing and comparing datasets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import NonConvertible, need_key, need_order
from quarry.operators.step import _order, nodupkey, position


def _shared(a: DataFrame, b: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in by]


def _joined(a: DataFrame, b: DataFrame, by: list[str], how: str) -> DataFrame:
    x = a.select(*[F.col(c).alias(f"_a_{c}") for c in a.columns], F.lit(1).alias("_in_a"))
    y = b.select(*[F.col(c).alias(f"_b_{c}") for c in b.columns], F.lit(1).alias("_in_b"))
    on = reduce(lambda p, q: p & q, (F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in by))
    return x.join(y, on, how)


def match_merge(a: DataFrame, b: DataFrame, by, how: str = "full", flags: tuple[str, str] | None = None) -> DataFrame:
    """MERGE BY: columns of one name take the right side's value where it has a row; how: full, left (if a), right (if b), inner.

    Keys match null-safely. Fan-out within a key is that of a join; keys should be unique on one side at least.
    """
    by = need_key(by, "MERGE")
    how = {"full": "full_outer"}.get(how, how)
    j = _joined(a, b, by, how)
    both = _shared(a, b, by)
    present_b = F.col("_in_b").isNotNull()
    out = [F.when(present_b, F.col(f"_b_{k}")).otherwise(F.col(f"_a_{k}")).alias(k) for k in by]
    out += [F.when(present_b, F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}")).alias(c) if c in both else F.col(f"_a_{c}").alias(c) for c in a.columns if c not in by]
    out += [F.col(f"_b_{c}").alias(c) for c in b.columns if c not in by and c not in both]
    if flags:
        out += [F.coalesce("_in_a", F.lit(0)).alias(flags[0]), F.coalesce("_in_b", F.lit(0)).alias(flags[1])]
    return j.select(*out)


def positional_merge(a: DataFrame, b: DataFrame, order_a=None, order_b=None) -> DataFrame:
    """MERGE without BY pairs rows by position: refused without an order of both sides."""
    x, y = (position(d, need_order(o, "MERGE without BY"), "_pos") for d, o in ((a, order_a), (b, order_b)))
    return match_merge(x, y, "_pos").drop("_pos")


def _collapsed(transactions: DataFrame, by: Sequence[str], order) -> DataFrame:
    """One row for each key: the last non-missing value of each column in the stated order; without an order, keys that repeat are refused."""
    values = [c for c in transactions.columns if c not in by]
    if order is None:
        many = F.raise_error(F.lit("UPDATE: a transaction key repeats, and no order says which row comes last"))
        found = transactions.groupBy(*by).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values])
        # the check is a filter on what only the aggregation knows, so it stays whatever columns are asked for
        return found.where(F.when(F.col("_n") > 1, many.cast("boolean")).otherwise(F.lit(True))).select(*by, *values)
    place = F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order)])
    return transactions.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in values])


def update(master: DataFrame, transactions: DataFrame, by, insert: bool = True, order=None) -> DataFrame:
    """UPDATE (insert) or MODIFY: a missing transaction value leaves the master's; new keys are inserted or not.

    Transactions of one key are applied in `order` (columns, ascending); without one a repeated key raises.
    """
    by = need_key(by, "UPDATE")
    transactions = _collapsed(transactions, by, order)
    j = _joined(master, transactions, by, "full_outer" if insert else "left")
    both = _shared(master, transactions, by)
    out = [F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in by]
    out += [F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) if c in both else F.col(f"_a_{c}").alias(c) for c in master.columns if c not in by]
    out += [F.col(f"_b_{c}").alias(c) for c in transactions.columns if c not in by and c not in both]
    return j.select(*out)


def modify(master: DataFrame, transactions: DataFrame, by, order=None) -> DataFrame:
    return update(master, transactions, by, insert=False, order=order)


def find_first(df: DataFrame, table: DataFrame, key, order) -> DataFrame:
    """A hash look-up: the table's first row for a key in a stated order; rows never fan out."""
    return df.join(nodupkey(table, key, order), need_key(key, "find()"), "left")


def find_all(df: DataFrame, table: DataFrame, key) -> DataFrame:
    return df.join(table, need_key(key, "find()"), "left")


def check(df: DataFrame, table: DataFrame, key, negate: bool = False) -> DataFrame:
    return df.join(table.select(*need_key(key, "check()")), need_key(key, "check()"), "left_anti" if negate else "left_semi")


def seen(df: DataFrame, key, order, name: str = "seen") -> DataFrame:
    """1 where an earlier row had the key."""
    w = Window.partitionBy(*need_key(key, "find before add")).orderBy(*_order(need_order(order, "find before add")))
    return df.withColumn(name, (F.row_number().over(w) > 1).cast("int"))


def stack(*dfs: DataFrame, source: str | None = None) -> DataFrame:
    """SET a b: by name, missing columns are missing, repeats stay."""
    if source:
        dfs = tuple(d.withColumn(source, F.lit(i)) for i, d in enumerate(dfs))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def interleave(*dfs: DataFrame, by) -> DataFrame:
    return stack(*dfs).orderBy(*_order(need_order(by, "interleaving SET")))


def transpose_wide(df: DataFrame, by, id_col: str, value: str, ids: Sequence | None = None, prefix: str = "") -> DataFrame:
    """Long to wide; ids: the new columns (found in the data if not given)."""
    grouped = df.groupBy(*need_key(by, "TRANSPOSE"))
    out = (grouped.pivot(id_col, list(ids)) if ids is not None else grouped.pivot(id_col)).agg(F.first(value, ignorenulls=True))
    names = {c: f"{prefix}{c}" for c in out.columns if c not in need_key(by, "TRANSPOSE")}
    return out.withColumnsRenamed(names)


def transpose_long(df: DataFrame, by, columns: Sequence[str], name: str = "_name_", value: str = "col1") -> DataFrame:
    """Wide to long; missing values keep their rows."""
    return df.unpivot([F.col(b) for b in need_key(by, "TRANSPOSE")], [F.col(c) for c in columns], name, value)


def compare_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, repeats counted: side is BASE or COMPARE."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("BASE")).unionByName(b.exceptAll(a).withColumn("side", F.lit("COMPARE")))


def compare_values(a: DataFrame, b: DataFrame, by, columns: Sequence[str], criterion: float | None = None) -> DataFrame:
    """A row for each key and column whose values differ, missing values compared as values."""
    by = need_key(by, "COMPARE")
    j = _joined(a.select(*by, *columns), b.select(*by, *columns), by, "inner")

    def differs(c: str) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if criterion is None:
            return ~x.eqNullSafe(y)
        return F.when(x.isNull() | y.isNull(), ~x.eqNullSafe(y)).otherwise(F.abs(x - y) > criterion)

    rows = [F.when(differs(c), F.struct(F.lit(c).alias("variable"), F.col(f"_a_{c}").cast("string").alias("base"), F.col(f"_b_{c}").cast("string").alias("compare"))) for c in columns]
    one = F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("d")
    return j.select(*[F.col(f"_a_{k}").alias(k) for k in by], one).select(*by, "d.variable", "d.base", "d.compare")


def contents(df: DataFrame) -> DataFrame:
    """name, type, varnum, label."""
    rows = [(f.name, f.dataType.simpleString(), i, f.metadata.get("comment")) for i, f in enumerate(df.schema, 1)]
    return df.sparkSession.createDataFrame(rows, "name string, type string, varnum int, label string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = ({f.name: f.dataType.simpleString() for f in d.schema} for d in (a, b))
    rows = [(n, x.get(n), y.get(n)) for n in sorted({*x, *y}) if x.get(n) != y.get(n)]
    return a.sparkSession.createDataFrame(rows, "name string, base string, compare string")


def kill(*_):
    raise NonConvertible("KILL")
