"""Importance resampling of documents towards a target text set, over hashed word n-grams.

1. A position table: each document's words are exploded with their places, and for orders above 1 lead() over a window of the
   document concatenates the words that follow. Each order's n-gram is hashed to one of BUCKETS buckets. The table has a row for each word and
   an int for each order; it is written once and read twice.
2. Buckets are counted over all documents and over all target texts; a bucket's gain is the logarithm of its smoothed frequency among
   the target over that among the documents. There are BUCKETS gains whatever the corpus, so their join is a broadcast.
3. A document's weight is the mean gain of its features. A Gumbel number drawn from its id is added, so that taking the highest scores is
   sampling without replacement in proportion to exp(weight). Ranks come from range partitions and their counts, not from one task.

Words are runs of ASCII letters (A-Z lower-cased), digits and characters above ASCII.

Cases: null and empty texts, and texts without words, have no features and weight 0, and are never drawn unless least_words is 0; rows of equal
ids are documents of their own with the same random number, ordered by a hash of the text; equal rows get equal weights; a null id
counts as an empty one and comes first; long texts are taken whole; an empty target has no counts (all its smoothed frequencies are equal); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, lower_ascii, numbered, own_id, ranked, texts, written

BUCKETS, SEED, LEAST_WORDS = 10_000, "2024", 20
#: Java's class of what separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def positions(rows: DataFrame) -> DataFrame:
    """doc_id, tie, pos, word: a row for each word, pos ascending in the text; rows: doc_id, tie, text."""
    words = rows.select("doc_id", "tie", F.posexplode(F.split("text", BETWEEN)).alias("pos", "word")).where("word <> ''")
    return words.withColumn("word", lower_ascii(F.col("word")))


def hashed(table: DataFrame, orders: tuple[int, int], buckets: int = BUCKETS) -> DataFrame:
    """doc_id, tie, and by order n a column b<n>: the bucket of the n words from each place on, null where fewer are left."""
    low, high = orders
    if not 1 <= low <= high:
        raise ValueError(f"orders {orders}")
    document = Window.partitionBy("doc_id", "tie").orderBy("pos")
    following = ["word"]
    for k in range(1, high):
        table = table.withColumn(f"word{k}", F.lead("word", k).over(document))
        following.append(f"word{k}")
    gram = lambda n: F.concat_ws(" ", *following[:n]) if n > 1 else F.col("word")
    bucket = lambda n: F.when(F.col(following[n - 1]).isNotNull(), F.crc32(gram(n).cast("binary")) % buckets).cast("int")
    return table.select("doc_id", "tie", *[bucket(n).alias(f"b{n}") for n in range(low, high + 1)])


def _long(table: DataFrame) -> DataFrame:
    """doc_id, tie, bucket: a row for each feature."""
    buckets = [c for c in table.columns if c not in ("doc_id", "tie")]
    if len(buckets) == 1:
        return table.select("doc_id", "tie", F.col(buckets[0]).alias("bucket")).where("bucket is not null")
    return table.select("doc_id", "tie", F.explode(F.array(*buckets)).alias("bucket")).where("bucket is not null")


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain for every bucket; source and target: tables of hashed()."""
    count = lambda table, name: _long(table).groupBy("bucket").agg(F.count("*").alias(name))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(source, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    return both.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))  # totals: one row


def random_score(doc_id: Column, seed: str = SEED) -> Column:
    """1000 times a Gumbel number that the id and the seed fix, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def resample(docs: DataFrame, target: DataFrame, orders: tuple[int, int] = (1, 1), share: tuple[int, int] = (10, 100), least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank: 1, 2, 3 ... of the share that is drawn, null for others.

    Drawn are floor(share * N) of the N documents with at least least_words words.
    """
    rows = numbered(texts(docs, id_col, text_col))
    of_target = texts(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), "id").withColumn("tie", F.monotonically_increasing_id())
    table = written(hashed(positions(rows), orders), "features")
    gain = F.broadcast(gains(table, hashed(positions(of_target), orders)))  # as many rows as buckets
    sums = _long(table).join(gain, "bucket").groupBy("doc_id", "tie").agg(F.sum("gain").alias("sum"), F.count("*").alias("n_features"))
    if orders == (1, 1):
        sums = sums.withColumn("n_words", F.col("n_features"))
    else:
        each = table.groupBy("doc_id", "tie").agg(F.count("*").alias("n_words"))
        sums = each.join(sums, ["doc_id", "tie"], "left")
    full = rows.select("doc_id", "tie").join(sums, ["doc_id", "tie"], "left").fillna(0, ["n_words", "n_features", "sum"])
    # the mean, rounded down, in whole numbers
    weight = F.when(F.col("n_features") > 0, F.expr("(sum - pmod(sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    scored = written(full.withColumn("weight", weight).withColumn("score", F.col("weight") + random_score(own, seed)), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share[0] // share[1]
    places = ranked(able.select("doc_id", "tie", "score"), [F.col("score").desc(), "doc_id", "tie"], "rank").where(F.col("rank") <= drawn)
    out = scored.join(places.select("doc_id", "tie", "rank"), ["doc_id", "tie"], "left")
    return out.select(own_id(), "n_features", "weight", "score", "rank")


def keep_drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose ids are drawn, all columns."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(ids["_drawn"]), "left_semi")
