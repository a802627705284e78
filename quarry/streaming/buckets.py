"""A keyed table in hash buckets, of which a change rewrites only those it touches.

A version is a manifest that names a folder for each bucket; folders are never changed. The version of a batch is made from the last
version of a lower number, so a batch that is run again after a failure, or after a restart, gives the same table, and readers see the version before or
after. Folders that no kept version names go by vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The version that holds the table as it was before the first batch.
BASE = -1


class Buckets:
    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, count: int = 64):
        self.spark, self.root, self.key, self.schema, self.count = spark, root.rstrip("/"), key, schema, count
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version + 1:010d}"

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/manifests")
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(x) - 1 for x in names if x.isdigit())

    def folders(self, version: int | None = None) -> dict[int, str]:
        """The folder of each run of a bucket that has rows."""
        version = max(self.versions()) if version is None else version
        stream = self.fs.open(self.path(self._manifest(version)))
        try:
            held = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        if held["buckets"] != self.count:
            raise ValueError(f"the table has {held['buckets']} buckets, not {self.count}")
        return {int(k): v for k, v in held["folders"].items()}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        new, place = self.path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self.path(self._manifest(version))
        out = self.fs.create(new, False)
        try:
            out.write(bytearray(json.dumps({"buckets": self.count, "folders": {str(k): v for k, v in sorted(folders.items())}}).encode()))
        finally:
            out.close()
        if self.fs.exists(place):  # the same batch, run again
            self.fs.delete(place, False)
        if not self.fs.rename(new, place):
            raise RuntimeError(f"version {version} was not committed")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.count)).cast("int"))

    def _write(self, df: DataFrame) -> dict[int, str]:
        """Folders by bucket of df, whose rows have their bucket."""
        place = f"{self.root}/data/{uuid.uuid4().hex}"
        df.repartition("bucket").write.partitionBy("bucket").parquet(place)
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(self.path(place))]
        return {int(x.partition("=")[2]): f"{place}/{x}" for x in names if x.startswith("bucket=")}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        return read.parquet(*folders.values()) if folders else self.spark.createDataFrame([], self.schema)

    def create(self, table: DataFrame) -> None:
        self._commit(BASE, self._write(self._placed(table)))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.folders(version))

    def near(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the buckets that the keys fall into; other buckets are not read."""
        wanted = self._placed(keys.select(self.key)).select("bucket").distinct().collect()  # as many as buckets at most
        folders = self.folders(version)
        near = {r.bucket for r in wanted}
        return self._read({k: v for k, v in folders.items() if k % self.count in near})

    def change(self, version: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Makes a version with merge(old rows, changes) in the buckets that changes have a key of; returns these."""
        from quarry.operators.graph import _cut, _drop

        base = self.folders(max(v for v in self.versions() if v < version))
        new = _cut(self._placed(changes))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # as many as buckets at most
        rows = merge(self._read({k: v for k, v in base.items() if k % self.count in touched}), new.drop("bucket"))
        written = self._write(self._placed(rows)) if touched else {}
        self._commit(version, {k: v for k, v in base.items() if k % self.count not in touched} | written)
        _drop(new)
        return touched

    def runs(self, version: int | None = None) -> int:
        """The largest number of runs that a bucket may have."""
        return max((k // self.count + 1 for k in self.folders(version)), default=0)

    def append(self, version: int, rows: DataFrame) -> None:
        """Makes a version with rows in a new run beside what there is, which is neither read nor written."""
        base = max(v for v in self.versions() if v < version)
        run = self.runs(base) * self.count
        self._commit(version, self.folders(base) | {run + k: v for k, v in self._write(self._placed(rows)).items()})

    def replace(self, version: int, table: DataFrame) -> None:
        """Makes a version of the rows of table alone, in one run."""
        self._commit(version, self._write(self._placed(table)))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last `keep`, and the folders that these don't name; returns how many folders went."""
        last = self.versions()[-keep:]
        for v in self.versions():
            if v not in last:
                self.fs.delete(self.path(self._manifest(v)), False)
        live, gone = {x for v in last for x in self.folders(v).values()}, 0
        top = self.path(f"{self.root}/data")
        for run in self.fs.listStatus(top) if self.fs.exists(top) else []:
            for x in self.fs.listStatus(run.getPath()):
                name = f"{self.root}/data/{run.getPath().getName()}/{x.getPath().getName()}"
                if str(x.getPath().getName()).startswith("bucket=") and name not in live:
                    self.fs.delete(x.getPath(), True)
                    gone += 1
        return gone
