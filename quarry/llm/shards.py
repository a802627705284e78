"""Sharding: a store of immutable runs with size-tiered compaction and versioned manifests.

An arrival is appended as a small run (a folder of Parquet files that is never changed). A run's tier tells its size: tier t
holds runs of BASE_BYTES * FANOUT ** t bytes and more. Whenever a tier has FANOUT runs they are merged into one run whose files have
about the target size, and that run joins the tier of its size; so each row is rewritten once a tier, as often as the logarithm
of the table's size. Merging reads and writes without a shuffle.

A change is a complete manifest under a name of its own, committed by creating the next version's file, which fails if that file exists
and names the manifest; a version file that names none yet (its writer is at it, or was lost) is not a version to readers and a Conflict
to writers, until vacuum removes it after the lease. So readers see the version before or after, never between. Appending
is tried again on a Conflict; a merge that comes too late is dropped. No change deletes anything: runs that no version names are left for
vacuum, which keeps the runs of the last versions and whatever is younger than a lease, so that readers of older versions and writers
that haven't committed go on. All paths go through Hadoop's file systems; the store needs one whose create without overwriting is
atomic (HDFS, local disks, object stores with conditional writes).

Cases: an arrival without rows makes an empty run of tier 0; repeated rows, nulls, extra columns and very long texts are kept
as they are; arrivals may lack columns of others (read as null); an empty store has no rows and can't be read.
"""

from __future__ import annotations

import dataclasses
import json
import math
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

BASE_BYTES, FANOUT, TARGET_BYTES = 4 << 20, 4, 128 << 20
#: vacuum keeps so many versions, and files younger than so many seconds; appending is tried so often.
KEPT_VERSIONS, LEASE, TRIES = 10, 24 * 3600.0, 20


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclasses.dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    rows: int

    @property
    def tier(self) -> int:
        return max(0, int(math.log(max(self.bytes, 1) / BASE_BYTES, FANOUT)) if self.bytes >= BASE_BYTES else 0)


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests
    def _versions(self) -> dict[int, str]:
        """Manifests by version; "": not committed yet."""
        folder = self.path(f"{self.root}/versions")
        if not self.fs.exists(folder):
            return {}
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(folder)]
        return {int(x): self._text(f"{self.root}/versions/{x}") for x in names if x.isdigit()}

    def _text(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> None:
        out = self.fs.create(self.path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def version(self) -> int:
        """The last committed version; 0: none."""
        return max((v for v, name in self._versions().items() if name), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        return self._snapshot(version)[1]

    def _snapshot(self, version: int | None = None) -> tuple[int, list[Run]]:
        known = {v: name for v, name in self._versions().items() if name}
        version = max(known, default=0) if version is None else version
        if not version:
            return 0, []
        if version not in known:
            raise KeyError(f"no version {version}")
        return version, [Run(**x) for x in json.loads(self._text(f"{self.root}/manifests/{known[version]}"))]

    def _commit(self, version: int, runs: list[Run]) -> None:
        name = uuid.uuid4().hex
        self._create(f"{self.root}/manifests/{name}", json.dumps([dataclasses.asdict(r) for r in runs]))
        try:
            if any(v >= version for v in self._versions()):
                raise Conflict(f"version {version} exists")
            self._create(f"{self.root}/versions/{version:012d}", name)
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception):
                raise
            raise Conflict(f"version {version} exists") from e

    # ---- runs
    def _write(self, df: DataFrame) -> Run:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.write.parquet(path)
        size = self.fs.getContentSummary(self.path(path)).getLength()
        return Run(path, int(size), self.spark.read.schema(df.schema).parquet(path).count())

    def append(self, arrival: DataFrame) -> None:
        run = self._write(arrival)
        for k in range(TRIES):
            version, runs = self._snapshot()
            try:
                return self._commit(version + 1, [*runs, run])
            except Conflict:
                if k == TRIES - 1:
                    raise
                time.sleep(0.05 * (k + 1))

    @staticmethod
    def _crowded(runs: list[Run]) -> list[Run]:
        """The oldest FANOUT runs of the lowest tier that has so many."""
        by: dict[int, list[Run]] = {}
        for r in runs:
            by.setdefault(r.tier, []).append(r)
        return next((by[t][:FANOUT] for t in sorted(by) if len(by[t]) >= FANOUT), [])

    def compact(self) -> int:
        """Merges until no tier is crowded; returns the number of merges."""
        done = 0
        while True:
            version, runs = self._snapshot()
            crowd = self._crowded(runs)
            if not crowd:
                return done
            files = max(1, round(sum(r.bytes for r in crowd) / self.target))
            merged = self._write(self._read(crowd).coalesce(files))
            while True:
                at = runs.index(crowd[0])
                rest = [r for r in runs if r not in crowd]
                try:
                    self._commit(version + 1, [*rest[:at], merged, *rest[at:]])
                    done += 1
                    break
                except Conflict:
                    time.sleep(0.05)
                    version, runs = self._snapshot()
                    if not all(r in runs for r in crowd):  # merged by another
                        break

    def vacuum(self, keep: int = KEPT_VERSIONS, lease: float = LEASE) -> int:
        """Deletes what neither the last `keep` versions nor anybody within the lease needs; returns how many runs went."""
        now, versions = time.time() * 1000, self._versions()
        last = sorted(v for v, name in versions.items() if name)[-keep:]
        live = {"versions": {f"{v:012d}" for v in last}, "manifests": {versions[v] for v in last}, "runs": {r.path.rpartition("/")[2] for v in last for r in self.runs(v)}}
        gone = 0
        for kind, names in live.items():
            folder = self.path(f"{self.root}/{kind}")
            for x in self.fs.listStatus(folder) if self.fs.exists(folder) else []:
                if str(x.getPath().getName()) not in names and now - x.getModificationTime() >= 1000 * lease:
                    self.fs.delete(x.getPath(), True)
                    gone += kind == "runs"
        return gone

    def _read(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(*[r.path for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.runs(version))


def arrivals(docs: DataFrame, count: int, id_col: str = "doc_id") -> list[DataFrame]:
    """docs in `count` ranges of ids (nulls in the first), so that the scan of one prunes the files of the others."""
    from pyspark.sql import functions as F

    c = F.col(id_col)
    bounds = docs.agg(F.percentile_approx(c, [i / count for i in range(1, count)], 10_000).alias("b")).first().b or []
    edges = [None, *sorted(set(bounds)), None]
    out = []
    for lo, hi in zip(edges, edges[1:], strict=False):
        rows = docs if lo is None else docs.where(c >= lo)
        rows = rows if hi is None else rows.where((c < hi) | c.isNull() if lo is None else c < hi)
        out.append(rows)
    return out


def ingest(docs: DataFrame, root: str, count: int, target_bytes: int = TARGET_BYTES) -> Store:
    """A store that got docs in `count` arrivals, compacted as they came."""
    store = Store(docs.sparkSession, root, target_bytes)
    for rows in arrivals(docs, count):
        store.append(rows)
        store.compact()
    return store
