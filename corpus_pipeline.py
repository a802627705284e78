"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out, sources are
mixed to target weights, and what is left is encoded.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next stage's docs. No stage
but the last changes the columns. The mixing stage repeats rows and never drops one (rates are 1 or more).

Cases, stage by stage as in the operators: null and empty texts are clean, alone, uncut, kept once or more, and have no ids; null ids stay;
rows of equal ids are judged for toxicity one by one, are one document for near-duplicates, and stay or go together; columns of any
other name, those of results included, pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, mixing, neardup, suffix, toxicity
from quarry.llm.common import discard, temporary, written

#: Token weights of the domains after mixing.
TARGETS = {"high": 0.9, "low": 0.1}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit_toxic(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix.cut_texts(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mix, _ = mixing.fit_mix(docs, _labels(spark, sf_dir), TARGETS, least=1.0, of=mixing.domain(toxic=None))
    return mixing.mixed(docs, mix)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats), ("mixing", mix_sources), ("bpe", encode)]
#: Trained models, permutations and merges aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages leave in the shared folder goes when the next stage's docs are written."""
    docs = last = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as kept:
            docs = written(stage(spark, last, sf_dir), name)
            kept.append(docs)
        if last is not docs and hasattr(last, "written_to"):
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
