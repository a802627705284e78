"""Findings of round 4: values that differ each time they are worked out, and pairs that were shuffled and stored at length."""

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("ties", ["LOW", "HIGH", "DENSE", "MEAN"])
def test_rank_of_values_that_never_come_twice(spark, ties):
    """A value worked out anew differs, as sums of doubles do that meet in another order; every row has the rank of the value it shows."""
    import random

    from quarry.operators import procs

    once = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    got = procs.rank(spark.range(40).withColumn("v", once()), "v", "r", ties=ties).collect()
    assert [r.r for r in sorted(got, key=lambda r: r.v)] == list(range(1, 41))


def guided(spark, n_chunks, n_items):
    """Chunks of four scopes, and items of two profiles with thirty chunks each by topic."""
    n, none = F.col("id"), F.array().cast("array<string>")
    scope = F.get(F.array(*map(F.lit, ["always", "pinned", "reference", "topic"])), (n % 4).cast("int"))
    chunks = spark.range(n_chunks).select(n.alias("chunk_id"), scope.alias("scope"), F.when(n % 3 == 0, F.array(F.lit("sql"))).alias("langs"), none.alias("kinds"), none.alias("metas"), F.array((n % 2).cast("string")).alias("constructs"), (n % 9).alias("size"))
    items = spark.range(n_items).select(n.alias("item_id"), F.when(n % 2 == 0, "sql").otherwise("py").alias("lang"), none.alias("kinds"), none.alias("metas"), F.array(F.lit("1")).alias("constructs"))
    ranking = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("rank")).withColumn("chunk_id", (F.col("item_id") * 7 + F.col("rank") * 11) % n_chunks).repartition(4)
    return chunks, items, ranking


def test_claims_by_topic_are_dealt_once(spark):
    """Pairs found by topic go to the tasks of their items, where all else happens: no further exchange has them."""
    from test_findings_r03 import shuffled

    from quarry.operators import guidance

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")  # chunks and profiles are small beside the ranking
    try:
        got = guidance.chosen(*guided(spark, 120, 2000), 90, 40, 1)
        by_topic = sum(r.tier in ("user_topic", "topical") for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert by_topic > 10_000 and [n for n in shuffled(got) if n >= by_topic] == [60_000]


def test_items_of_a_claim_come_in_blocks(spark):
    """Items of a profile repeat in short sequences, one for each claim, so that files of columns hold a row in a few bits however many items there are."""
    from quarry.operators import guidance, spread

    chunks, items, ranking = guided(spark, 1200, 3000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = guidance.chosen(chunks, items, ranking.limit(0), 90, 40, 1)
        place = F.monotonically_increasing_id()
        near = got.select("item_id", F.floor(place / 1024).alias("near")).groupBy("near").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"))
        worst = near.where("n = 1024").agg(F.max("items"), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert worst[1] > 1000 and worst[0] <= 2.5 * spread.BLOCK, worst
