"""Evaluation metrics as DataFrame formulas; where a judge's verdict is needed it is an input column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.retrieval import LEAKAGE, METRICS, tokens


def token_estimate(text: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(text) / 4)


def message_tokens(messages: DataFrame, by: str, text: str) -> DataFrame:
    """A thread's tokens with 3 of framing a message and 3 for the reply."""
    return messages.groupBy(by).agg((F.sum(token_estimate(F.col(text))) + 3 * F.count("*") + 3).alias("tokens"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, f1 over the multisets of tokens; 0 where either has none."""

    def counted(c: str, name: str) -> DataFrame:
        return pairs.select(key, F.explode(tokens(F.col(c), METRICS)).alias("w")).groupBy(key, "w").agg(F.count("*").alias(name))

    both = counted(a, "x").join(counted(b, "y"), [key, "w"], "full_outer").groupBy(key).agg(F.sum(F.least(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))).alias("common"), F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    precision, recall = F.try_divide("common", "ny"), F.try_divide("common", "nx")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return pairs.select(key).distinct().join(both.select(key, f1.alias("f1")), key, "left").select(key, F.coalesce("f1", F.lit(0.0)).alias("f1"))


def _is(word: str):
    return lambda x: x == word


def leakage(docs: DataFrame, key: str, text: str, note: str, threshold: float = 0.8) -> DataFrame:
    """key, overlap, leaked: the best share of the note's tokens (a multiset) in any window of the note's length."""
    import re
    from collections import Counter

    words = re.findall(LEAKAGE, note.lower())
    n = max(1, len(words))
    t = docs.select(key, tokens(F.col(text), LEAKAGE).alias("t"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1)))

    def overlap(i: Column) -> Column:
        window = F.slice(F.col("t"), i, n)
        total = F.lit(0)
        for w, c in sorted(Counter(words).items()):
            total = total + F.least(F.size(F.filter(window, _is(w))), F.lit(c))
        return total / n

    best = F.array_max(F.transform(starts, overlap))
    return t.select(key, F.coalesce(best, F.lit(0.0)).alias("overlap")).withColumn("leaked", (F.col("overlap") >= threshold).cast("int"))


def required_terms(text: Column, terms: list[str]) -> Column:
    """Share of the terms that are contained, case aside; 1 where none is asked for."""
    if not terms:
        return F.lit(1.0)
    total = F.lit(0)
    for t in terms:
        total = total + F.contains(F.lower(text), F.lit(t.lower())).cast("int")
    return total / len(terms)


def mentioned(text: Column, name: str) -> Column:
    """The full name as a substring, or its last part as a word of its own."""
    import re

    bare = re.escape(name.lower().rpartition(".")[2])
    return F.contains(F.lower(text), F.lit(name.lower())) | F.rlike(F.lower(text), F.lit(rf"(?<![a-z0-9_]){bare}(?![a-z0-9_])"))


def contextual_precision(ranked: DataFrame, by: str, rank: str, relevant: str) -> DataFrame:
    """Mean over relevant places of relevant-so-far / place; 0 without any."""
    w = Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    x = ranked.withColumn("_upto", F.sum(relevant).over(w))
    total = F.sum(relevant)
    return x.groupBy(by).agg(F.coalesce(F.try_divide(F.sum(F.when(F.col(relevant) == 1, F.col("_upto") / F.col(rank)).otherwise(0.0)), total), F.lit(0.0)).alias("score"))


def verdict_ratio(df: DataFrame, by: str, verdict: str, accepted: list[str]) -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.col(verdict).isin(accepted).cast("double")).alias("score"))


def graded(grade: Column) -> Column:
    """A grade of 1 to 5 as a score; an unreadable one is 0."""
    return F.coalesce((F.least(F.greatest(grade, F.lit(1)), F.lit(5)) - 1) / 4, F.lit(0.0))


def passed(score: Column, threshold: Column, skipped: Column) -> Column:
    return skipped | (F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) >= threshold)


def roll_up(results: DataFrame, by: str) -> DataFrame:
    """by, score (mean of what wasn't skipped, 1 if all was), passed (all). Columns: score, threshold, skipped."""
    ok = passed(F.col("score"), F.col("threshold"), F.col("skipped"))
    return results.groupBy(by).agg(F.coalesce(F.avg(F.when(~F.col("skipped"), F.col("score"))), F.lit(1.0)).alias("score"), F.bool_and(ok).alias("passed"))


def greedy_matches(pairs: DataFrame, by: str, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one matches, best first, of pairs scoring at least `least`; ties by the ids. A fold over each case's sorted pairs."""
    from pyspark.sql.types import StructType

    schema = StructType([pairs.schema[c] for c in (by, left, right, score)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used_l, used_r = set(), set()
        for pdf in batches:
            take = []
            for o, a, b in zip(pdf["_o"], pdf[left], pdf[right], strict=True):
                if o == 1:
                    used_l, used_r = set(), set()
                free = a not in used_l and b not in used_r
                take.append(free)
                if free:
                    used_l.add(a)
                    used_r.add(b)
            yield pdf[take].drop(columns="_o")

    best = Window.partitionBy(by).orderBy(F.col(score).desc(), left, right)
    rows = pairs.where(F.col(score) >= least).select(by, left, right, score).withColumn("_o", F.row_number().over(best))
    return rows.sortWithinPartitions(by, "_o").mapInPandas(fold, schema)


def match_f1(matches: DataFrame, sizes: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """by, score: F1 of one-to-one matches (by, ...) against the numbers of items on both sides (sizes: by, left, right); 1 where both are none."""
    n = matches.groupBy(by).agg(F.count("*").alias("_n"))
    total = F.col(left) + F.col(right)
    return sizes.join(n, by, "left").select(by, F.when(total == 0, 1.0).otherwise(2 * F.coalesce("_n", F.lit(0)) / total).alias("score"))


#: Tags of fences that hold prose or an echo, not code.
PROSE_FENCES = ("sas", "text", "txt", "log", "output", "console", "markdown", "md")


def translation(markdown: Column) -> Column:
    """The section under a second-level heading that begins with Translation, or all where there is none."""
    section = F.regexp_extract(markdown, r"(?is)(?:\A|\n)##[ \t]+translation[^\n]*(?:\n(.*?))?(?=\n##[ \t]|\z)", 1)
    return F.when(markdown.rlike(r"(?i)(?:\A|\n)##[ \t]+translation"), section).otherwise(markdown)


def language_compliance(markdown: Column, wanted: str) -> Column:
    """Share of the translation's code blocks that are marked as the wanted language or not marked at all; 0 where there is no code block."""
    from quarry.operators.text import fences, language

    found = F.filter(F.transform(fences(translation(markdown)), lambda x: language(F.trim(x["language"]))), lambda x: ~x.isin(*PROSE_FENCES))
    hits = F.size(F.filter(found, lambda x: x.isin("", "".join(c for c in wanted.lower() if c not in " _-"))))
    return F.when(F.size(found) == 0, 0.0).otherwise(hits / F.size(found))


def coverage(rows: DataFrame, by: str, asked: Column, answered: Column) -> DataFrame:
    """by, coverage: the answered share of what was asked, 1 at most; groups that ask nothing are left out."""
    g = rows.groupBy(by).agg(F.count_if(asked).alias("_asked"), F.count_if(answered).alias("_said")).where("_asked > 0")
    return g.select(by, F.least(F.col("_said") / F.col("_asked"), F.lit(1.0)).alias("coverage"))


def weakest(rows: DataFrame, by: str, *scores: Column) -> DataFrame:
    """by, score: the least of the mean scores, which is how a summary is judged."""
    return rows.groupBy(by).agg(F.least(*[F.avg(s) for s in scores]).alias("score"))
