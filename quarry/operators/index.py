"""A kept inverted index over a key-value table: puts and deletes maintain it, and a search reads the postings of its own words only.

Four tables in hash buckets make a version: postings by word, the keys that a change put or deleted, the length of each key, and one row of totals. A change
appends the postings of what it puts and the keys it changes; a posting counts while no later change has its key. So a change shuffles and writes what it
puts, not what there was, and after RUNS of them the postings are written anew without those that no longer count. The
table of keys is committed last, and its last version is the one that is searched: a change that failed half-way is not seen, and the same version
run again completes it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.operators.graph import _cut, _drop
from quarry.streaming.buckets import BASE, Buckets

#: Parts into which the postings of one word are dealt, so that a word of a third of all rows is no single task's.
SPREAD = 16
#: Appended changes after which the postings are written anew.
RUNS = 8


def _place(word, part):
    return F.pmod(F.xxhash64(word), F.lit(1 << 16)).cast("int") * SPREAD + part.cast("int")


class Index:
    """Keys, values and tags (a JSON array) as BM25 documents: the key, the value and the tags are searched.

    Nulls count as empty. Of several puts of a key in one change the greatest (value, tags) counts; a key that is put and deleted is put.
    """

    def __init__(self, spark: SparkSession, root: str, count: int = 64):
        self.spark = spark
        self.postings = Buckets(spark, f"{root}/postings", "place", "place int, term string, kv_key string, tf long, length long, version long", count)
        self.changed = Buckets(spark, f"{root}/changed", "kv_key", "kv_key string, version long", count)
        self.totals = Buckets(spark, f"{root}/totals", "part", "part int, n long, length long", 1)
        self.keys = Buckets(spark, f"{root}/keys", "kv_key", "kv_key string, length long", count)
        self.tables = (self.postings, self.changed, self.totals, self.keys)

    def create(self, store: DataFrame) -> None:
        """Begins with the rows of store: kv_key, value, tags."""
        held = _cut(self._described(store))
        self.postings.create(self._posted(held, BASE))
        self.changed.create(self.spark.createDataFrame([], self.changed.schema))
        self.totals.create(self._total(held))
        self.keys.create(held.select("kv_key", "length"))
        _drop(held)

    def _described(self, rows: DataFrame) -> DataFrame:
        """kv_key, terms (term, tf), length. Words are counted in their row: sorted, each is a stretch from where it begins to where the next one does."""
        one = rows.where("kv_key is not null").groupBy("kv_key").agg(F.max(F.struct(F.coalesce("value", F.lit("")).alias("v"), F.coalesce("tags", F.lit("")).alias("t"))).alias("r"))
        words = one.select("kv_key", F.sort_array(retrieval.tokens(F.concat_ws("\n", "kv_key", "r.v", "r.t"))).alias("w"))
        begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
        at = words.withColumn("at", F.when(F.size("w") > 0, begins).otherwise(F.array().cast("array<int>")))
        terms = F.transform("at", lambda p, i: F.struct(F.get("w", p).alias("term"), (F.coalesce(F.get("at", i + 1), F.size("w")) - p).cast("long").alias("tf")))
        return at.select("kv_key", terms.alias("terms"), F.size("w").cast("long").alias("length"))

    @staticmethod
    def _posted(held: DataFrame, version: int) -> DataFrame:
        x = held.select("kv_key", "length", F.explode("terms").alias("p"))
        place = _place(F.col("p.term"), F.pmod(F.xxhash64("kv_key"), F.lit(SPREAD)))
        return x.select(place.alias("place"), F.col("p.term").alias("term"), "kv_key", F.col("p.tf").alias("tf"), "length", F.lit(version).cast("long").alias("version"))

    @staticmethod
    def _total(held: DataFrame, sign: int = 1) -> DataFrame:
        n, length = F.count("length"), F.coalesce(F.sum("length"), F.lit(0))
        return held.agg((n * sign).alias("n"), (length * sign).alias("length")).select(F.lit(0).alias("part"), "n", "length")

    def _live(self, postings: DataFrame, version: int) -> DataFrame:
        """Those of the postings whose key no later change has."""
        last = self.changed.read(version).groupBy("kv_key").agg(F.max("version").alias("_last"))
        return postings.join(last, "kv_key", "left").where("_last is null or version >= _last").select(*postings.columns)

    def change(self, version: int, puts: DataFrame, deletes: DataFrame | None = None) -> None:
        """A version with puts (kv_key, value, tags) and without the keys of deletes (kv_key)."""
        base = {max(v for v in t.versions() if v < version) for t in self.tables}
        if len(base) > 1:
            raise ValueError(f"version {max(base)} was not completed: run it again before {version}")
        base = base.pop()
        new = _cut(self._described(puts))
        keys = new.select("kv_key")
        if deletes is not None:
            keys = keys.union(deletes.where("kv_key is not null").select("kv_key")).distinct()
        now = _cut(keys.join(new.select("kv_key", "length"), "kv_key", "left"))  # no length: deleted
        before = _cut(self.keys.near(now, base).join(now.select("kv_key"), "kv_key", "left_semi"))
        posted, gone = self._posted(new, version), now.select("kv_key", F.lit(version).cast("long").alias("version"))
        if self.changed.runs(base) < RUNS:
            self.changed.append(version, gone)
            self.postings.append(version, posted)
        else:
            kept = self._live(self.postings.read(base), base).join(gone.select("kv_key"), "kv_key", "left_anti")
            self.postings.replace(version, kept.unionByName(posted))
            self.changed.replace(version, gone.limit(0))
        delta = self._total(now).union(self._total(before, -1))
        self.totals.change(version, delta, lambda old, new: old.union(new).groupBy("part").agg(F.sum("n").alias("n"), F.sum("length").alias("length")))
        self.keys.change(version, now, lambda old, new: old.join(new, "kv_key", "left_anti").unionByName(new.where("length is not null")))
        _drop(new, now, before)

    def search(self, query: str, version: int | None = None) -> DataFrame:
        """kv_key, score of rows with a word of the query, as retrieval.bm25 scores them; the scan is of the buckets of these words."""
        version = max(self.keys.versions()) if version is None else version
        terms = sorted(set(re.findall(retrieval.RETRIEVAL, query.lower())))
        places = self.spark.createDataFrame([(w, part) for w in terms for part in range(SPREAD)], "term string, part int").select(_place(F.col("term"), F.col("part")).alias("place"))
        found = self._live(self.postings.near(places, version).where(F.col("term").isin(terms)), version)
        tf = found.select(F.col("kv_key").alias("_key"), F.col("length").alias("_len"), F.col("term").alias("_term"), F.col("tf").alias("_tf"))
        whole = self.totals.read(version).select(F.col("n").alias("_n"), (F.col("length") / F.nullif(F.col("n"), F.lit(0))).alias("_avg"))
        return retrieval.bm25_scores(tf, whole).withColumnRenamed("_key", "kv_key")

    def hybrid(self, query: str, dense: DataFrame, top: int, depth: int = 100) -> DataFrame:
        """kv_key, rank, score = 1 / rank: the best `depth` by words and by dense (kv_key, score), fused by their ranks; ties to the smaller key.

        Keys of dense that the table does not hold are left out. Without a word that occurs and without dense rows the result is empty.
        """
        rounded = lambda x: x.withColumn("score", F.round("score", 9))
        held = self.keys.read().select("kv_key")
        rankings = [retrieval.ranked(rounded(x), "kv_key", depth, later_wins=False) for x in (self.search(query), dense.join(held, "kv_key", "left_semi"))]
        fused = retrieval.ranked(rounded(retrieval.fuse(*rankings, key="kv_key")), "kv_key", top, later_wins=False)
        return fused.select("kv_key", F.col("rank").cast("int").alias("rank"), (1.0 / F.col("rank")).alias("score"))

    def vacuum(self, keep: int = 2) -> None:
        for t in self.tables:
            t.vacuum(keep)
