"""Delimited and fixed-width text, bindings of library names, corpora, history and key-value sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.errors import NonConvertible


def scratch(spark: SparkSession) -> str:
    """A new folder that executors share: in spark.checkpoint.dir, or a temporary one where that is unset (tests, one machine)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-")
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, delimiter: str = ",", names: bool = True, first_row: int = 1) -> DataFrame:
    """The schema is always given, never guessed; first_row skips rows after the header."""
    df = spark.read.schema(schema).csv(path, sep=delimiter, header=names, mode="PERMISSIVE")
    if first_row > 1:
        raise NonConvertible("DATAROW= past the header: files are read in parts without a row order; filter on a column instead")
    return df


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", one_file: bool = False) -> None:
    """A folder of part files; one_file only for small results."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep=delimiter, header=True)


def read_fixed(spark: SparkSession, path: str, columns: dict[str, tuple[int, int, str]], short: str = "TRUNCOVER") -> DataFrame:
    """columns: name to (1-based start, width, type). A field past a line's end is missing; MISSOVER drops a partial one too."""
    line = spark.read.text(path)
    out = []
    for name, (at, width, kind) in columns.items():
        raw = F.trim(F.col("value").substr(at, width))
        whole = F.length("value") >= at + width - 1 if short == "MISSOVER" else F.length("value") >= at
        out.append(F.when(whole & (raw != ""), raw).try_cast(kind).alias(name))
    return line.select(*out)


def line_hold(*_):
    raise NonConvertible("@@ with column input holds a line across rows; list input has it (infile.read_list)")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """source_id, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_id"), F.col("value").alias("text"))


class Bindings:
    """Library names to places. DBMS engines must be read by their own connector; pipes and mail have no table."""

    REFUSED = ("pipe", "url", "email", "ftp", "sftp", "socket")

    def __init__(self) -> None:
        self.places: dict[str, str] = {}

    def libname(self, name: str, place: str, engine: str | None = None) -> None:
        if engine and engine.lower() not in ("base", "v9", "parquet"):
            raise NonConvertible(f"engine {engine}: read it with its Spark connector")
        self.places[name.lower()] = place.rstrip("/")

    def filename(self, name: str, place: str, method: str | None = None) -> None:
        if method and method.lower() in self.REFUSED:
            raise NonConvertible(f"filename {method}")
        self.places[name.lower()] = place

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        lib, _, member = name.lower().rpartition(".")
        if lib in ("", "work"):
            return spark.table(member)
        return spark.read.parquet(f"{self.places[lib]}/{member}.parquet")


def name_mapping(names: DataFrame, name: str, exact: DataFrame, by_library: DataFrame) -> DataFrame:
    """Adds target: an exact mapping, else the library's schema with the member; quoted paths and macro names stay as they are."""
    low = F.lower(F.col(name))
    skip = low.rlike("^['\"]") | F.contains(low, F.lit("&"))
    e = exact.groupBy(F.lower("source").alias("_e")).agg(F.max("target").alias("_et"))
    lib = by_library.groupBy(F.lower("source").alias("_l")).agg(F.max("target").alias("_lt"))
    x = names.withColumn("_low", low).withColumn("_lib", F.substring_index("_low", ".", 1))
    x = x.join(e, F.col("_low") == F.col("_e"), "left").join(lib, F.col("_lib") == F.col("_l"), "left")
    member = F.substring_index("_low", ".", -1)
    target = F.when(skip, F.col(name)).otherwise(F.coalesce("_et", F.when(F.col("_lt").isNotNull(), F.concat("_lt", F.lit("."), member)), F.col(name)))
    return x.withColumn("target", target).drop("_low", "_lib", "_e", "_et", "_l", "_lt")


def append_history(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows in the declared order of columns, appended."""
    df.select(*columns).write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old one and returns its path; the caller swaps the name it reads."""
    new = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(new)
    return new


def cache_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name, status: fresh, stale, uncached (on disk only) or missing (in the manifest only). files: name, content; manifest: name, sha."""
    f = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("now"))
    j = f.join(manifest.select("name", F.col("sha").alias("was")), "name", "full_outer")
    return j.select("name", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "uncached").when(F.col("now") == F.col("was"), "fresh").otherwise("stale").alias("status"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row wins."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_rn = 1").drop("_rn")
