"""Keyed conversation memory: upserts, prefixes, tags, threads, retention and notes over a key-value table.

Columns: kv_key, value (JSON), tags (JSON array), created_at, updated_at, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "kv_key string not null, value string not null, tags string, created_at double, updated_at double, source string"


def upsert(store: DataFrame, new: DataFrame, now: float) -> DataFrame:
    """An update keeps created_at, and tags and source where the new row has none."""
    s, n = store.alias("s"), new.alias("n")
    j = s.join(n, F.col("s.kv_key") == F.col("n.kv_key"), "full_outer")
    fresh = F.col("n.kv_key").isNotNull()
    return j.select(
        F.coalesce("n.kv_key", "s.kv_key").alias("kv_key"),
        F.when(fresh, F.col("n.value")).otherwise(F.col("s.value")).alias("value"),
        F.coalesce("n.tags", "s.tags").alias("tags"),
        F.coalesce("s.created_at", F.lit(now)).alias("created_at"),
        F.when(fresh, F.lit(now)).otherwise(F.col("s.updated_at")).alias("updated_at"),
        F.coalesce("n.source", "s.source").alias("source"),
    )


def delete_keys(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("kv_key"), "kv_key", "left_anti")


def delete_prefix(store: DataFrame, prefix: str) -> DataFrame:
    """The prefix is literal: % and _ mean themselves."""
    return store.where(~F.col("kv_key").startswith(prefix))


def with_prefix(store: DataFrame, prefix: str, after: str | None = None) -> DataFrame:
    out = store.where(F.col("kv_key").startswith(prefix))
    return out.where(F.col("kv_key") > after) if after is not None else out


def with_tag(store: DataFrame, tag: str) -> DataFrame:
    return store.where(F.array_contains(F.from_json("tags", "array<string>"), tag))


def all_tags(store: DataFrame) -> DataFrame:
    return store.select(F.explode(F.from_json("tags", "array<string>")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def turns(messages: DataFrame, by: str, order: str, role: str, opener: str = "user") -> DataFrame:
    """Adds turn_id: a message of the opener starts a turn; leading others form turn 1 of their own."""
    w = Window.partitionBy(by).orderBy(order)
    starts = ((F.col(role) == opener) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    return messages.withColumn("_s", starts).withColumn("turn_id", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def newest(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*[c.desc() for c in order]))).where(F.col("_rn") <= n).drop("_rn")


def rewind(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n oldest."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def frontier(df: DataFrame, by: str, order: str, size: Column, trigger: int, exempt: int) -> DataFrame:
    """folded: the rows that a rolling summary takes in once those pending, the newest `exempt` left out, hold `trigger` tokens."""
    from_end = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc()))
    x = df.withColumn("_size", size).withColumn("_end", from_end)
    pending = F.sum(F.when(F.col("_end") > exempt, F.col("_size")).otherwise(0)).over(Window.partitionBy(by))
    return x.withColumn("folded", ((F.col("_end") > exempt) & (pending >= trigger)).cast("int")).drop("_size", "_end")


def fork(messages: DataFrame, by: str, source: int, target: int, order: str, count: int) -> DataFrame:
    """The first `count` messages of a thread, under another thread's id."""
    own = messages.where(F.col(by) == source).withColumn("_rn", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    return own.where(F.col("_rn") <= count).drop("_rn").withColumn(by, F.lit(target).cast("long"))


def live_notes(notes: DataFrame, expires: str, now: Column) -> DataFrame:
    return notes.where(F.col(expires).isNull() | (F.col(expires) > now))


def tail_overlap(df: DataFrame, by: str, order: str, size: Column, budget: int) -> DataFrame:
    """The trailing rows whose running total from the end fits; the first that doesn't ends the run."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("_t", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_t") <= budget).drop("_t")


def completed(facts: DataFrame, by: str, pos: str, ok: Column) -> DataFrame:
    """The facts before the first unsatisfied position."""
    bad = F.min(F.when(~ok, F.col(pos))).over(Window.partitionBy(by))
    return facts.withColumn("_bad", bad).where(F.col("_bad").isNull() | (F.col(pos) < F.col("_bad"))).drop("_bad")


def snapshot(store: DataFrame, prefix: str) -> DataFrame:
    """The rows under a literal prefix, as they are, for restore()."""
    return with_prefix(store, prefix)


def restore(store: DataFrame, saved: DataFrame, prefix: str) -> DataFrame:
    """What is under the prefix becomes what was saved, times included; saved rows under other keys are ignored."""
    return delete_prefix(store, prefix).unionByName(with_prefix(saved, prefix).select(store.columns))


def threads(store: DataFrame) -> DataFrame:
    """thread, n, first_at, last_at of the msg::{thread}::{...} keys, for listing."""
    own = with_prefix(store, "msg::").withColumn("thread", F.element_at(F.split("kv_key", "::"), 2))
    return own.groupBy("thread").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("updated_at").alias("last_at"))


def unread(messages: DataFrame, marks: DataFrame, by: str, order: str) -> DataFrame:
    """by, n_unread, next_unread: what lies behind each thread's read frontier. marks: by, seen (none: nothing has been read)."""
    x = messages.join(marks.select(by, "seen"), by, "left")
    fresh = F.col("seen").isNull() | (F.col(order) > F.col("seen"))
    return x.groupBy(by).agg(F.count_if(fresh).alias("n_unread"), F.min(F.when(fresh, F.col(order))).alias("next_unread"))


def advanced(marks: DataFrame, read: DataFrame, by: str, order: str) -> DataFrame:
    """The frontier after reading these messages; it never goes back. by, seen."""
    return marks.select(by, "seen").union(read.select(by, order)).groupBy(by).agg(F.max("seen").alias("seen"))


def fork_before(store: DataFrame, source: str, target: str, before: float | None = None) -> DataFrame:
    """Copies of a thread's msg:: rows under another thread, created before a time (none: all): the thread's name is rewritten in keys and tags."""
    head = f"msg::{source}::"
    own = with_prefix(store, head)
    own = own if before is None else own.where(F.col("created_at") < before)
    tags_ = F.transform(F.from_json("tags", "array<string>"), lambda x: F.when(x == f"thread:{source}", f"thread:{target}").otherwise(x))
    return own.withColumn("kv_key", F.concat(F.lit(f"msg::{target}::"), F.expr(f"substring(kv_key, {len(head) + 1})"))).withColumn("tags", F.to_json(tags_))
