"""Summary procedures: means, frequencies, univariate statistics, ranks, standardising, tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import NonConvertible, need_key
from quarry.operators.graph import _cut
from quarry.operators.step import position

STATS = {
    "n": lambda c: F.count(c),
    "nmiss": lambda c: F.count_if(F.col(c).isNull()),
    "sum": lambda c: F.sum(c),
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "range": lambda c: F.max(c) - F.min(c),
    "var": lambda c: F.var_samp(c),
    "std": lambda c: F.stddev_samp(c),
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "skew": lambda c: F.skewness(c),
    "kurt": lambda c: F.kurtosis(c),
}


def stat(name: str, column: str) -> Column:
    if name in STATS:
        return STATS[name](column)
    if name.startswith("p") and name[1:].replace("_", "").isdigit():
        return F.percentile(column, F.lit(float(name[1:].replace("_", ".")) / 100))
    raise NonConvertible(f"statistic {name}")


def means(df: DataFrame, classes: Sequence[str], outputs: dict[str, tuple[str, str]], nway: bool = True, types: Sequence[Sequence[str]] | None = None, missing: bool = False) -> DataFrame:
    """outputs: column name to (statistic, variable). Without nway every combination of classes, with _type_ and _freq_.

    _type_ has a bit for each class that a row is grouped by, the last class in the lowest. Rows with a missing class are left out
    unless missing.
    """
    classes = list(classes)
    rows = df if missing else df.dropna(subset=classes) if classes else df
    aggregates = [stat(s, c).alias(name) for name, (s, c) in outputs.items()]
    if nway and types is None:
        return rows.groupBy(*classes).agg(*aggregates)
    aggregates.append(F.count("*").alias("_freq_"))
    level = ((1 << len(classes)) - 1 - F.grouping_id()).cast("int").alias("_type_")
    if types is None:
        return rows.cube(*classes).agg(level, *aggregates)
    sets = [[F.col(c) for c in t] for t in types]
    return rows.groupingSets(sets, *classes).agg(level, *aggregates)


def freq(df: DataFrame, columns: Sequence[str], missing: bool = False) -> DataFrame:
    """count and percent of each combination."""
    rows = df if missing else df.dropna(subset=list(columns))
    return rows.groupBy(*columns).agg(F.count("*").alias("count")).withColumn("percent", 100 * F.col("count") / F.sum("count").over(Window.partitionBy()))


def freq_test(*_):
    raise NonConvertible("association tests of FREQ")


def mode(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the least of equals."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return counted.agg(F.max_by(column, F.struct("count", (-F.col(column)).alias("low"))).alias("mode"), F.max("count").alias("count"))


def rank(df: DataFrame, column: str, name: str | None = None, by: Sequence[str] = (), ties: str = "MEAN", descending: bool = False, fixed: bool = False) -> DataFrame:
    """Ranks of the non-missing values; name None replaces the column. A window runs over the counts of distinct values and not over the rows.

    Rows meet the ranks of their values, which takes two passes over df. A mean of doubles differs in its last bits each time it is worked out, so
    df is written in between. fixed: df gives the same values each time, as what is read from a table does, and isn't written.
    """
    df = df if fixed else _cut(df)
    c = F.col(column)
    order = c.desc() if descending else c.asc()
    w = Window.partitionBy(*by).orderBy(order)
    high = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    low = high - F.col("_n") + 1
    ties = ties.upper()
    if ties == "LOW":
        r = low.cast("int")
    elif ties == "DENSE":
        r = F.row_number().over(w)
    elif ties == "HIGH":
        r = high
    elif ties == "MEAN":  # the mean of the ranks that equal values span, not of one rank repeated
        r = (low + high) / 2
    else:
        raise NonConvertible(f"TIES={ties}")
    counted = df.where(c.isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    ranks = counted.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], c.alias("_value"), r.alias("_rank"))
    same = c == F.col("_value")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    return df.join(ranks, same, "left").withColumn(name or column, F.col("_rank")).select(*dict.fromkeys([*df.columns, name or column]))


def rank_groups(df: DataFrame, column: str, groups: int, tiebreak: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Zero-based quantile groups; tiebreak makes equal values' places definite."""
    c = F.col(column)
    if not by:  # the groups of a whole table from places, without one task for all rows
        placed = position(df.where(c.isNotNull()), [column, *tiebreak], "_pos", "_all")
        small, larger = F.floor(F.col("_all") / groups), F.col("_all") % groups
        at = F.col("_pos") - 1
        head = larger * (small + 1)
        group = F.when(at < head, F.floor(at / (small + 1))).otherwise(larger + F.floor(F.try_divide(at - head, small)))
        return placed.withColumn(name, group.cast("int")).drop("_pos", "_all").unionByName(df.where(c.isNull()).withColumn(name, F.lit(None).cast("int")))
    w = Window.partitionBy(*map(F.col, by), c.isNull()).orderBy(c, *tiebreak)
    return df.withColumn(name, F.when(c.isNotNull(), F.ntile(groups).over(w) - 1))


def rank_percent(df: DataFrame, column: str, name: str, by: Sequence[str] = (), fraction: bool = False) -> DataFrame:
    c, scale = F.col(column), 1 if fraction else 100
    if not by:  # of a whole table from places: a value's rank is the least place of its rows
        placed = position(df.where(c.isNotNull()).select(column), [column], "_pos", "_all")
        low = placed.groupBy(column).agg(F.min("_pos").alias("_low"), F.max("_all").alias("_all"))
        share = F.coalesce(F.try_divide(F.col("_low") - 1, F.col("_all") - 1), F.lit(0.0)) * scale
        return df.join(low, column, "left").select(*[F.col(x) for x in df.columns], F.when(c.isNotNull(), share).alias(name))
    w = Window.partitionBy(*map(F.col, by), c.isNull()).orderBy(c)
    return df.withColumn(name, F.when(c.isNotNull(), F.percent_rank().over(w) * scale))


def normal_scores(*_):
    raise NonConvertible("normal scores")


def standardize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), mean: float = 0, std: float = 1, replace_only: bool = False) -> DataFrame:
    """Mean and standard deviation to the given ones; replace_only: missing values become the group's mean, nothing else changes."""
    if not by:  # one row of statistics for all tasks instead of one task for all rows
        stats = df.agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_std_{c}") for c in columns])
        rows = df.crossJoin(F.broadcast(stats))
        avg, dev = (lambda c: F.col(f"_mean_{c}")), (lambda c: F.col(f"_std_{c}"))
    else:
        w = Window.partitionBy(*by)
        rows, avg, dev = df, (lambda c: F.avg(c).over(w)), (lambda c: F.stddev_samp(c).over(w))
    if replace_only:
        new = {c: F.coalesce(F.col(c), avg(c)) for c in columns}
    else:
        new = {c: F.try_divide(F.col(c) - avg(c), F.nullif(dev(c), F.lit(0.0))) * std + mean for c in columns}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def report_across(df: DataFrame, group: Sequence[str], across: str, values: Sequence, analysis: str, statistic: str = "sum", computed: dict[str, Column] | None = None) -> DataFrame:
    out = df.groupBy(*need_key(group, "REPORT")).pivot(across, list(values)).agg(stat(statistic, analysis))
    return out.withColumns(computed) if computed else out


def compute_block(*_):
    raise NonConvertible("a COMPUTE block that reads other report lines")


def equivalence(df: DataFrame, numeric: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Row count, sums and distinct counts of an output."""
    return df.agg(F.count("*").alias("n_rows"), *[F.sum(c).alias(f"sum_{c}") for c in numeric], *[F.count_distinct(c).alias(f"distinct_{c}") for c in keys])


def plots(*_):
    raise NonConvertible("plots of UNIVARIATE")
