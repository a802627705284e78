"""Ranking: BM25, dense cosine, rank fusion, keyword scores, re-ranking, history selection and budgeted packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokenizers for retrieval, metrics and leakage; they differ on purpose.
RETRIEVAL, METRICS, LEAKAGE = r"[a-z0-9_]+", r"[a-z0-9_.]+", r"[a-z0-9]+"
K1, B = 1.5, 0.75
FUSION = 60


def tokens(text: Column, pattern: str = RETRIEVAL) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """key, score of documents that hold a query term; k1 = 1.5, b = 0.75, non-negative idf, no (k1 + 1) factor.

    Only the query's terms are exploded; corpus statistics come from one aggregate row.
    """
    import re

    terms = sorted(set(re.findall(RETRIEVAL, query.lower())))
    base = docs.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_tokens")).withColumn("_len", F.size("_tokens"))
    whole = base.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    tf = base.select("_key", "_len", F.explode(F.filter("_tokens", lambda w: F.array_contains(wanted, w))).alias("_term")).groupBy("_key", "_len", "_term").agg(F.count("*").alias("_tf"))
    return bm25_scores(tf, whole).withColumnRenamed("_key", key)


def bm25_scores(tf: DataFrame, whole: DataFrame) -> DataFrame:
    """_key, score from counts (_key, _len, _term, _tf) of the query's terms and one row (_n, _avg) of the corpus."""
    df = tf.groupBy("_term").agg(F.count("*").alias("_df"))
    s = tf.join(df, "_term").crossJoin(F.broadcast(whole))  # one row
    idf = F.ln(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    gain = F.col("_tf") / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return s.groupBy("_key").agg(F.sum(idf * gain).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(docs: DataFrame, key: str, vector: str, query: DataFrame) -> DataFrame:
    """key, score against a one-row query (column q), exact; more rows raise."""
    one = query.agg(F.when(F.count("*") > 1, F.raise_error(F.lit("cosine: the query has several rows")).cast(query.schema["q"].dataType)).otherwise(F.first("q")).alias("q"))
    q = F.broadcast(one.where("q is not null").select(normalised(F.col("q")).alias("_q")))
    return docs.select(key, normalised(F.col(vector)).alias("_v")).crossJoin(q).select(key, dot(F.col("_v"), F.col("_q")).alias("score"))


def ranked(scores: DataFrame, key: str, k: int, later_wins: bool = True) -> DataFrame:
    """The best k with a one-based rank; ties to the later key, or to the earlier."""
    tie = F.col(key).desc() if later_wins else F.col(key).asc()
    top = scores.orderBy(F.col("score").desc(), tie).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc(), tie)))


def fuse(*rankings: DataFrame, key: str) -> DataFrame:
    """Reciprocal-rank fusion of rankings (key, rank)."""
    every = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(key, "rank"))
    return every.groupBy(key).agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"))


def _holds(word: str):
    return lambda t: F.contains(F.lower(t), F.lit(word))


def keyword_score(key: Column, value: Column, tags: Column, words: list[str]) -> Column:
    """2.0 for a hit in the key, 1.0 an occurrence in the value, 1.5 a tag that holds the word."""
    total = F.lit(0.0)
    for w in words:
        w = w.lower()
        count = (F.length(value) - F.length(F.replace(F.lower(value), F.lit(w), F.lit("")))) / len(w)
        hits = F.size(F.filter(tags, _holds(w)))
        total = total + F.when(F.contains(F.lower(key), F.lit(w)), 2.0).otherwise(0.0) + count + 1.5 * F.coalesce(hits, F.lit(0))
    return total


def rerank_window(df: DataFrame, pos: str, score: str, window: int) -> DataFrame:
    """The first `window` places are ordered anew by score, the rest keep theirs: adds place."""
    inside = F.coalesce(F.col(pos) <= window, F.lit(False))
    first = Window.partitionBy().orderBy(-F.col(score), F.col(pos))  # over `window` rows only
    top = df.where(inside).withColumn("place", F.row_number().over(first).cast("long"))
    return top.union(df.where(~inside).withColumn("place", F.col(pos).cast("long")))


def select_history(df: DataFrame, by: str, seq: str, score: str, keep_tail: int, top: int) -> DataFrame:
    """The last rows always, and the best of the rest, in order of time."""
    tail = F.row_number().over(Window.partitionBy(by).orderBy(F.col(seq).desc()))
    x = df.withColumn("_tail", tail)
    best = F.row_number().over(Window.partitionBy(by, F.col("_tail") <= keep_tail).orderBy(F.col(score).desc(), F.col(seq).desc()))
    return x.withColumn("_best", best).where((F.col("_tail") <= keep_tail) | (F.col("_best") <= top)).drop("_tail", "_best")


def select_turns(df: DataFrame, by: str, seq: str, score: str, top_k: int, keep_last: int) -> DataFrame:
    """At most top_k rows of each group: the last keep_last always, and the best scored of the rest; where none of the rest has a score, its newest.

    Groups of top_k rows or fewer stay whole; a null score is none; ties go to the newer row.
    """
    newest = Window.partitionBy(by).orderBy(F.col(seq).desc())
    x = df.withColumn("_tail", F.row_number().over(newest) <= min(keep_last, top_k)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    part = Window.partitionBy(by, "_tail")
    x = x.withColumn("_any", F.count(score).over(part) > 0).withColumn("_best", F.row_number().over(part.orderBy(F.col(score).desc_nulls_last(), F.col(seq).desc())))
    fits = (F.col("_best") <= max(top_k - keep_last, 0)) & (F.col(score).isNotNull() | ~F.col("_any"))
    return x.where((F.col("_n") <= top_k) | F.col("_tail") | fits).select(*df.columns)


def pack_best_first(df: DataFrame, by: str, order: Column, size: str, budget: int) -> DataFrame:
    """Takes rows in order while they fit; one that doesn't is skipped, later ones may still fit. A fold: its state depends on every choice."""
    rows = df.withColumn("_o", F.row_number().over(Window.partitionBy(by).orderBy(order)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget
        for pdf in batches:
            take = []
            for o, s in zip(pdf["_o"], pdf[size], strict=True):
                if o == 1:
                    left = budget
                take.append(s <= left)
                left -= s if take[-1] else 0
            yield pdf[take].drop(columns="_o")

    return rows.sortWithinPartitions(by, "_o").mapInPandas(fold, df.schema)


def pack_windows(df: DataFrame, by: str, order: str, size: str, budget: int, most: int) -> DataFrame:
    """Adds batch: rows in order, a new batch where one more would exceed budget or `most` rows; an oversize row stands alone."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, used, n = 0, 0, 0
        for pdf in batches:
            out = []
            for o, s in zip(pdf["_o"], pdf[size], strict=True):
                if o == 1:
                    batch, used, n = 0, 0, 0
                elif used + s > budget or n >= most:
                    batch, used, n = batch + 1, 0, 0
                used, n = used + s, n + 1
                out.append(batch)
            yield pdf.drop(columns="_o").assign(batch=out)

    from pyspark.sql.types import LongType, StructType

    schema = StructType(df.schema.fields).add("batch", LongType())
    rows = df.withColumn("_o", F.row_number().over(Window.partitionBy(by).orderBy(order)))  # 1 begins a group, its key null or not
    return rows.sortWithinPartitions(by, "_o").mapInPandas(fold, schema)
