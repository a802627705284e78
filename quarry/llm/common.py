"""Helpers that the operators of this package share: shared scratch tables, Arrow text buffers, whole-column passes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir, or a temporary one where it is unset and there is one machine alone (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Paths in the shared folder that this process has given out and not deleted.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, a lost executor costs a re-read, not a re-run."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _MADE:
        _MADE.remove(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes what operators have left in the shared folder within this block, but for the tables that are put into the list.

    An operator's result reads its last tables when it is used, so these stay until the caller has written the result.
    """
    before, kept = set(_MADE), []
    try:
        yield kept
    finally:
        for path in [x for x in _MADE if x not in before and x not in {df.written_to for df in kept}]:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now instead of at the driver's next garbage collection."""
    import gc
    import time

    for _ in range(2):  # what the first round frees lets the second free what it held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text (null: empty) alone, so that columns of any other name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


NO_ID = -(1 << 63)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def numbered(rows: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), tie, text of doc_id, text: tie numbers rows of equal ids by a hash of the text; 0 throughout where ids don't repeat."""
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows.select("doc_id", F.lit(0).cast("int").alias("tie"), "text")
    return rows.withColumn("tie", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).select("doc_id", "tie", "text")


def lower_ascii(text):
    """A-Z lower-cased; translate() looks every character up, so it is kept for texts beyond ASCII, where lower() would change more."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def own_id():
    """The doc_id of numbered() as it was."""
    return F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds the place (from 1) of each row in a total order; no task holds more than a range of it.

    The rows are sorted by ranges and written with their places within a range; the counts of the ranges, a row each, give where it starts.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_within": within}), "ranges")
    counts = held.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_range", before.alias("_before")))  # a row for each range
    return held.join(starts, "_range").select(*df.columns, (F.col("_before") + F.col("_within") + 1).alias(name))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (rows + 1) of a string or binary Arrow column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


#: Arrow hands Python workers so many bytes at once, which bounds what a task holds outside the JVM's heap.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _lean() -> None:
    """In a Python worker: memory of freed arrays goes back to the system."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """mapInArrow with one call of fn for each non-empty batch."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows that hold at most `most` bytes together, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
