"""Row steps: conditional assignments, outputs, windows over a stated order, sorting and de-duplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import NonConvertible, need_key, need_order


def keep(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names)


def drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def independent_ifs(target: str, rules: Sequence[tuple[Column, Column]], start: Column | None = None) -> Column:
    """Unconnected IFs that write one variable: the last that holds wins, so they fold in reverse into one CASE."""
    out = None
    for condition, value in reversed(rules):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return (out if start is None else out.otherwise(start)).alias(target)


def dependent_ifs(df: DataFrame, target: str, rules: Sequence[tuple[Callable[[], Column], Column]]) -> DataFrame:
    """IFs whose conditions read what earlier ones wrote stay staged."""
    for condition, value in rules:
        df = df.withColumn(target, F.when(condition(), value).otherwise(F.col(target)))
    return df


def output_rows(df: DataFrame, rows: Sequence[tuple[Column | None, dict[str, Column]]], keep_columns: Sequence[str]) -> DataFrame:
    """Several OUTPUT statements: each writes a row where its condition holds."""
    made = [F.when(condition if condition is not None else F.lit(True), F.struct(*[v.alias(k) for k, v in values.items()])) for condition, values in rows]
    names = list(rows[0][1])
    one = F.explode(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("_row")
    return df.select(*keep_columns, one).select(*keep_columns, *[F.col(f"_row.{n}").alias(n) for n in names])


def route(df: DataFrame, targets: dict[str, Column]) -> dict[str, DataFrame]:
    """OUTPUT to named datasets."""
    return {name: df.where(condition) for name, condition in targets.items()}


def _order(columns: Sequence) -> list[Column]:
    return [c if isinstance(c, Column) else F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in columns]


def _window(by: Sequence[str] | None, order) -> Window:
    return (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*_order(order))


def obs(df: DataFrame, order, first: int = 1, last: int | None = None) -> DataFrame:
    """FIRSTOBS= and OBS= in a stated order."""
    out = df.orderBy(*_order(need_order(order, "OBS=")))
    if first > 1:
        out = out.offset(first - 1)
    return out.limit(last - first + 1) if last is not None else out


def _ranges(df: DataFrame, order, what: str) -> DataFrame:
    """df in a total order by ranges, so that no task holds the whole table: adds _part, _row (from 0, in the range) and of each range _before, the rows before
    it, and _count.

    Rows are range-partitioned and sorted; each partition numbers its own, and the counts of partitions (one row each) give where it
    starts. The sorted rows are written to a shared folder in between, so that all passes see the same partitions.
    """
    from quarry.sources.files import scratch

    spark = df.sparkSession
    path = scratch(spark)
    keyed = df.orderBy(*_order(need_order(order, what)))
    keyed.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(path)
    held = spark.read.parquet(path)
    parts = held.groupBy("_part").agg(F.count("*").alias("_count"))  # a row for each partition
    before = F.coalesce(F.sum("_count").over(_earlier()), F.lit(0))
    return held.join(F.broadcast(parts.select("_part", "_count", before.alias("_before"))), "_part")


def _earlier():
    """Of a table with a row for each range: the ranges before one."""
    return Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def position(df: DataFrame, order, name: str = "_n_", total: str | None = None) -> DataFrame:
    """The place of each row in a total order of the whole table, without bringing the table into one task."""
    held = _ranges(df, order, "a position")
    out = held.withColumn(name, F.col("_before") + F.col("_row") + 1)
    if total:
        out = out.crossJoin(F.broadcast(held.agg(F.count("*").alias(total))))  # one row
    return out.select(*df.columns, name, *([total] if total else []))


def _carried(df: DataFrame, order, within: Column, own: Column, over_ranges, join, name: str) -> DataFrame:
    """A running value over the whole table: within a range by a window, and what the ranges before it hand on.

    within: the value in its range, over a window that is open at its start; own: what a range hands on, an aggregate; over_ranges: the same of all
    ranges before one; join: (handed on, within) to the running value.
    """
    held = _ranges(df, order, "RETAIN")
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    handed = held.groupBy("_part").agg(own.alias("_own")).select("_part", over_ranges(F.col("_own")).over(_earlier()).alias("_handed"))  # a row for each range
    return held.withColumn("_within", within.over(w)).join(F.broadcast(handed), "_part").withColumn(name, join(F.col("_handed"), F.col("_within"))).select(*dict.fromkeys([*df.columns, name]))


def _previous(df: DataFrame, value: Column, order, by: Sequence[str], n: int, name: str, what: str) -> DataFrame:
    """Adds the value n rows before; without by a range's first n rows get theirs from the last n of the ranges before it."""
    if by:
        return df.withColumn(name, F.lag(value, n).over(_window(by, need_order(order, what))))
    rows = _ranges(df, order, what).withColumns({"_value": value, "_place": F.col("_before") + F.col("_row")})
    given = rows.where(F.col("_count") - F.col("_row") <= n).select((F.col("_place") + n).alias("_place"), F.struct("_value").alias("_given"))  # n rows for each range
    rows = rows.withColumn("_near", F.lag("_value", n).over(Window.partitionBy("_part").orderBy("_row"))).join(given, "_place", "left")
    return rows.withColumn(name, F.when(F.col("_row") < n, F.col("_given._value")).otherwise(F.col("_near"))).select(*dict.fromkeys([*df.columns, name]))


def row_counter(df: DataFrame, order, by: Sequence[str] = (), name: str = "_n_", end: str | None = None) -> DataFrame:
    """_N_ and END=."""
    if not by:
        out = position(df, order, name, "_total" if end else None)
        return out.withColumn(end, (F.col(name) == F.col("_total")).cast("int")).drop("_total") if end else out
    w = _window(by, need_order(order, "_N_"))
    out = df.withColumn(name, F.row_number().over(w))
    if end:
        out = out.withColumn(end, (F.lead(F.lit(1)).over(w).isNull()).cast("int"))
    return out


def first_last(df: DataFrame, by: str | Sequence[str], order) -> DataFrame:
    """first_<by> and last_<by> flags of each group."""
    by = need_key(by, "FIRST./LAST.")
    w = _window(by, need_order(order, "FIRST./LAST."))
    name = by[-1]
    return df.withColumns({f"first_{name}": F.lag(F.lit(1)).over(w).isNull().cast("int"), f"last_{name}": F.lead(F.lit(1)).over(w).isNull().cast("int")})


def running_sum(df: DataFrame, value: str, order, by: Sequence[str] = (), name: str = "running") -> DataFrame:
    """The sum statement: missing values leave the total as it is."""
    known = F.coalesce(F.col(value), F.lit(0))
    if not by:
        return _carried(df, order, F.sum(known), F.sum(known), F.sum, lambda handed, within: F.coalesce(handed, F.lit(0)) + within, name)
    return df.withColumn(name, F.sum(known).over(_window(by, need_order(order, "RETAIN")).rowsBetween(Window.unboundedPreceding, 0)))


def carry_forward(df: DataFrame, value: str, order, by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    name = name or value
    if not by:
        newest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_row")))
        return _carried(df, order, F.last(value, ignorenulls=True), newest, lambda c: F.last(c, ignorenulls=True), lambda handed, within: F.coalesce(within, handed), name)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_window(by, need_order(order, "RETAIN")).rowsBetween(Window.unboundedPreceding, 0)))


def lag_dif(df: DataFrame, value: str, order, by: Sequence[str] = (), n: int = 1) -> DataFrame:
    return _previous(df, F.col(value), order, by, n, f"lag_{value}", "LAG").withColumn(f"dif_{value}", F.col(value) - F.col(f"lag_{value}"))


def lag_when(df: DataFrame, condition: Column, value: str, key: Sequence[str], order, by: Sequence[str] = (), name: str = "lagged") -> DataFrame:
    """LAG inside an IF: a queue that only rows on which it runs move on; missing elsewhere. key identifies a row."""
    runs = _previous(df.where(condition), F.col(value), order, by, 1, name, "LAG").select(*key, name)
    return df.join(runs, list(key), "left")


def sort(df: DataFrame, by) -> DataFrame:
    """Ascending by default, missing first either way; -name descends (missing last)."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first() for c in need_order(by, "SORT")])


def nodupkey(df: DataFrame, key, order, dupout: bool = False) -> DataFrame:
    """The first row of each key in a stated order; dupout: all the others."""
    w = _window(need_key(key, "NODUPKEY"), need_order(order, "NODUPKEY"))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn > 1" if dupout else "_rn = 1").drop("_rn")


def nodup_adjacent(df: DataFrame, columns: Sequence[str], order, by: Sequence[str] = ()) -> DataFrame:
    """Drops a row that equals the one before it in these columns."""
    whole = F.struct(*columns)
    rows = _previous(df, whole, order, by, 1, "_previous", "NODUPRECS")
    return rows.where(F.col("_previous").isNull() | ~F.col("_previous").eqNullSafe(whole)).drop("_previous")


def top_k(df: DataFrame, score: str, recency: str, k: int) -> DataFrame:
    """Best k, ties to the later one."""
    return df.orderBy(F.col(score).desc(), F.col(recency).desc()).limit(k)


def interleave_lists(df: DataFrame, list_col: str, pos: str) -> DataFrame:
    """Firsts of every list, then seconds, ...: adds rank in the interleaved order's keys."""
    return df.withColumn("turn", F.row_number().over(_window([list_col], [pos])))


def array_loop(df: DataFrame, columns: Sequence[str], body: Callable[[Column], Column]) -> DataFrame:
    """DO over an ARRAY with a body that handles each element alone."""
    return df.withColumns({c: body(F.col(c)) for c in columns})


def do_while(*_):
    raise NonConvertible("a data-dependent DO WHILE; use plans.scripting for run-time control flow")


def label(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata | {"comment": labels[c]}) if c in labels else F.col(c) for c in df.columns])


def length(df: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """LENGTH: character columns hold at most so many characters; trailing blanks don't count."""
    return df.select(*[F.rtrim(F.substring(c, 1, lengths[c])).alias(c, metadata=df.schema[c].metadata | {"length": lengths[c]}) if c in lengths else F.col(c) for c in df.columns])


def formatted(df: DataFrame, formats_: dict[str, str]) -> DataFrame:
    """FORMAT: the display format goes with the column as metadata; values stay."""
    return df.select(*[F.col(c).alias(c, metadata=df.schema[c].metadata | {"format": formats_[c]}) if c in formats_ else F.col(c) for c in df.columns])
