"""Extension points: a user's own token counter, reranker, metric or summariser over Arrow batches, and statements as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.operators.text import CHUNK, Grouping, scan_statements


def token_counter(count: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A Column function from one that counts the tokens of a Series of texts."""

    @pandas_udf("long")
    def counted(x: pd.Series) -> pd.Series:
        return count(x.fillna("")).astype("int64")

    return counted


def metric(score: Callable[[pd.Series, pd.Series], pd.Series], name: str, threshold: float) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """(case, metric, score, threshold, skipped) rows of cases with an expected and a given text, clamped to 0..1; a missing text skips the case."""

    @pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return score(a.fillna(""), b.fillna("")).astype(float).clip(0, 1)

    def run(cases: DataFrame, key: str, expected: str, given: str) -> DataFrame:
        missing = F.col(expected).isNull() | F.col(given).isNull()
        return cases.select(key, F.lit(name).alias("metric"), F.when(~missing, scored(expected, given)).alias("score"), F.lit(threshold).alias("threshold"), missing.alias("skipped"))

    return run


def reranker(score: Callable[[str, pd.Series], pd.Series], query: str) -> Callable[[Column], Column]:
    """A Column function that scores texts against a query, for retrieval.rerank_window."""

    @pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return score(query, x.fillna("")).astype(float)

    return scored


def summariser(fold: Callable[[list[str]], str]) -> Callable[[DataFrame, str, str, str], DataFrame]:
    """by, summary: fold over the ordered texts of each group, which must fit a task (turns of one thread)."""

    def run(rows: DataFrame, by: str, order: str, text: str) -> DataFrame:
        own = pandas_udf(lambda x: x.map(lambda t: fold([v for v in t if v is not None])), "string")
        texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text])
        return rows.groupBy(by).agg(texts.alias("_texts")).select(by, own("_texts").alias("summary"))

    return run


class _Statements:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        for i, unit in enumerate(scan_statements(text or ""), 1):
            if not unit[3]:
                yield i, unit[2].strip()


class _Chunks:
    """A table function with one state for each partition: units of a source come in order, its chunks go out as they end."""

    @staticmethod
    def analyze(units: AnalyzeArgument) -> AnalyzeResult:
        if not units.isTable:
            raise ValueError("chunk_units takes a table: chunk_units(TABLE(units) PARTITION BY source_id ORDER BY unit_no)")
        given = {f.name: f for f in units.dataType.fields}
        missing = {"source_id", "unit_no", "start_char", "end_char", "text", "is_comment", "kind", "normal"} - set(given)
        if missing:
            raise ValueError(f"chunk_units: the table has no column {', '.join(sorted(missing))}")
        types = [IntegerType(), StringType(), *[IntegerType()] * 4, StringType()]
        return AnalyzeResult(StructType([given["source_id"], *[StructField(n, t) for n, t in zip(CHUNK, types, strict=True)]]))

    def __init__(self):
        self.source, self.group = None, Grouping()

    def eval(self, units) -> Iterator[tuple]:
        self.source = units.source_id
        for row in self.group.add(units):
            yield self.source, *row

    def terminate(self) -> Iterator[tuple]:
        for row in self.group.flush():
            yield self.source, *row


def register(spark: SparkSession) -> None:
    """SQL: select * from statements(text); select * from chunk_units(TABLE(units) PARTITION BY source_id ORDER BY unit_no), units as text.described_units gives them."""
    spark.udtf.register("statements", F.udtf(_Statements, returnType="unit_no int, statement string"))
    spark.udtf.register("chunk_units", F.udtf(_Chunks))
