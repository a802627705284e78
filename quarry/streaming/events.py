"""Structured Streaming over the event log: windows with late data, de-duplication within a watermark, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.memory import SCHEMA, upsert
from quarry.sources.files import scratch
from quarry.streaming.buckets import Buckets


def read_log(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """New files of a folder as they come; the checkpoint of a query over it is the read frontier."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 8).parquet(folder)


def session_counts(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end, n, total of sessions closed by a gap."""
    w = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy("user_id", w.alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n", "total")


def window_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n")


def first_within(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """A note lives until its time is up: repeats within the watermark are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, as a table: the stream runs until it has read everything, then the result is returned.

    Each batch writes its rows to the folder that executors share, so none passes the driver; of a complete result only the last batch's stay.
    """
    spark, place = df.sparkSession, scratch(df.sparkSession)
    folders: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{place}/rows-{'all' if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(folder)
        folders.append(folder)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(*sorted(set(folders))) if folders else spark.createDataFrame([], df.schema)


def upsert_sink(changes: DataFrame, paths: dict[str, str], now: float, checkpoint: str, buckets: int = 64):
    """Keyed upserts batch by batch into the buckets under paths["root"], from the table paths["current"] on.

    A batch rewrites the buckets that its keys fall into and leaves the files of all others. Its base is the last version of a lower number,
    so a batch that is run again after a failure gives the same version, and a restarted stream goes on from what earlier ones wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = keyed(batch.sparkSession, paths["root"], buckets)
        if not table.versions():
            table.create(batch.sparkSession.read.parquet(paths["current"]))
        last = F.max_by(F.struct("value", "tags", "source"), "seq").alias("r")
        new = batch.groupBy("kv_key").agg(last).select("kv_key", "r.value", "r.tags", "r.source")
        table.change(number, new, lambda old, fresh: upsert(old, fresh, now))

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed(spark: SparkSession, root: str, buckets: int = 64) -> Buckets:
    return Buckets(spark, root, "kv_key", SCHEMA.replace(" not null", ""), buckets)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the batches that upsert_sink has committed."""
    return [v for v in keyed(spark, root).versions() if v >= 0]


def current(spark: SparkSession, root: str, buckets: int = 64) -> DataFrame:
    """The table after the last batch."""
    return keyed(spark, root, buckets).read()
