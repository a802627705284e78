"""Reversible line de-duplication: sharded cuckoo filters in front of exact reference tables.

A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least LEAST code points are known by their SHA-256. A
key that at least two documents hold keeps its lines in the document with the smallest id and loses them in all others.

A LineStore is a folder of immutable runs with versioned manifests (those of the sharding store):

* References, the exact tables: a row (key, doc_id, tie, place) for each line. An insertion appends a run of them; a deletion appends a run of
  ids that ends the references before it. Reference counts follow from them by aggregation, and so does what a deletion gives back.
* Filters: one cuckoo filter a shard of the keys, BUCKETS buckets of SLOTS 16-bit fingerprints. A key has one copy of its fingerprint
  while one document holds it, two while more do, none otherwise. Copies go in and out as exact counts change, so deletions never
  harm other keys. A filter says "no document", "one at most", or "perhaps more": only keys of which it says the last (or, when lines are
  inserted, that it knows them) are looked up in the reference tables.

Filters and keys are dealt by shard and streamed through tasks, a filter (512 KB) at a time; keys are counted before they are dealt, and
references are dealt by shard and document, so a line that a third of all documents share doesn't gather in a task. When filters fill up they
are built anew with more shards from the references. A change is visible when its manifest is committed; one that is interrupted
leaves only runs that no version names.

Cases: null and empty texts are one empty line, which is shorter than LEAST and stays; texts of equal ids are one document (their lines stay
or go together); null ids are one document that comes first; equal lines of one document stay or go together; an id that is inserted
again adds to its document; ids that are not in the store are deleted without effect; documents that were never inserted lose
nothing; an empty table inserts nothing; very long lines and texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import shards
from quarry.llm.common import NO_ID, buffers, lower_ascii, map_batches, numbered, own_id, small_batches, texts, written
from quarry.llm.words import mix

LEAST = 10
WHITE = " \t\n\x0b\x0c\r"
#: A shard's filter; filters are built anew when shards hold more copies than FULL on average.
BUCKETS, SLOTS, FULL = 1 << 16, 4, 180_000
#: How many kicks a copy may take before its filter counts as full.
KICKS = 500
#: References of a shard are dealt to so many tasks.
SALTS = 8
_U = np.uint64


class Cuckoo:
    """A cuckoo filter over 32-byte digests (rows of four uint64), which may hold a digest twice."""

    def __init__(self, cells: bytes | None = None):
        self.cells = np.zeros((BUCKETS, SLOTS), np.uint16) if not cells else np.frombuffer(cells, np.uint16).reshape(-1, SLOTS).copy()

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(print_.astype(_U)) & _U(BUCKETS - 1)).astype(np.int64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never 0, which marks a free slot) and both buckets."""
        prints = (keys[:, 0] % _U(65535) + _U(1)).astype(np.uint16)
        first = (keys[:, 1] & _U(BUCKETS - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def copies(self, keys: np.ndarray) -> np.ndarray:
        """At least how often each digest is held, as far as 2."""
        prints, a, b = self.places(keys)
        held = (self.cells[a] == prints[:, None]).sum(1)
        held += np.where(a != b, (self.cells[b] == prints[:, None]).sum(1), 0)
        return np.minimum(held, 2)

    def add(self, keys: np.ndarray) -> bool:
        """Adds a copy of each; False if there was no room for one."""
        prints, at, _ = self.places(keys)
        for k in range(KICKS):
            if not len(prints):
                return True
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # among those that want the same bucket
            taken = self.cells[at] != 0
            fits = rank < SLOTS - taken.sum(1)
            slots = np.argsort(taken, axis=1, kind="stable")  # free ones first
            self.cells[at[fits], slots[fits, rank[fits]]] = prints[fits]
            prints, at, rank = prints[~fits], at[~fits], rank[~fits]
            if k:  # every second try in a full bucket: one takes the place of another, which moves on
                head = np.ones(len(at), bool)
                head[1:] = at[1:] != at[:-1]
                slot = (prints[head].astype(np.int64) + k) % SLOTS
                out = self.cells[at[head], slot]
                self.cells[at[head], slot] = prints[head]
                prints[head] = out
            at = self._other(at, prints)
        return not len(prints)

    def remove(self, keys: np.ndarray) -> None:
        """Takes out a copy of each; all must be held."""
        prints, a, b = self.places(keys)
        flat = self.cells.ravel()
        while len(prints):
            in_a, in_b = self.cells[a] == prints[:, None], self.cells[b] == prints[:, None]
            here = in_a.any(1)
            if not (here | in_b.any(1)).all():
                raise ValueError("a key to be removed is not in its filter")
            cell = np.where(here, a * SLOTS + in_a.argmax(1), b * SLOTS + in_b.argmax(1))
            _, first = np.unique(cell, return_index=True)
            flat[cell[first]] = 0
            left = np.ones(len(prints), bool)
            left[first] = False
            prints, a, b = prints[left], a[left], b[left]


def lines(rows: DataFrame) -> DataFrame:
    """key, doc_id, tie, place of the lines whose keys are long enough; rows: doc_id, tie, text."""
    each = rows.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    key = each.withColumn("line", F.btrim("line", F.lit(WHITE))).where(F.char_length("line") >= LEAST)
    return key.select(F.unhex(F.sha2(lower_ascii(F.col("line")).cast("binary"), 256)).alias("key"), "doc_id", "tie", "place")


def _digests(column: pa.Array) -> np.ndarray:
    return buffers(column)[0].view(np.uint64).reshape(-1, 4)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, bool]]:
    """Stretches of one shard, from rows sorted by shard; and whether a stretch begins a shard."""
    last = None
    for batch in batches:
        shard = batch.column(0).to_numpy()
        for at in np.flatnonzero(np.diff(shard, prepend=shard[0] - 1 if len(shard) else 0)).tolist():
            end = at + int(np.searchsorted(shard[at:], shard[at], "right"))
            yield int(shard[at]), batch.slice(at, end - at), shard[at] != last
            last = shard[at]


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shard, salt, cells, and rows with a key: the rows with the copies that the filter holds; the filter's own row comes first."""
    held = None
    for _, part, _ in _by_shard(batches):
        own = part.column(2).is_valid().to_numpy(zero_copy_only=False)
        if own[0]:
            held = Cuckoo(part.column(2)[0].as_py())
        rest = part.filter(pa.array(~own))
        if rest.num_rows:
            yield pa.RecordBatch.from_arrays([*rest.columns[3:], pa.array(held.copies(_digests(rest.column(3))).astype(np.int32))], [*rest.schema.names[3:], "copies"])


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shard, cells, key, change (-2 to 2): the changed filters, and whether one was full."""
    held, full, shard = None, False, None

    def told() -> pa.RecordBatch:
        cells = held.cells
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([cells.tobytes()], pa.binary()), pa.array([int((cells != 0).sum())], pa.int64()), pa.array([full])], ["shard", "cells", "copies", "full"])

    for now, part, begins in _by_shard(batches):
        if begins:
            if held is not None:
                yield told()
            held, full, shard = Cuckoo(part.column(1)[0].as_py()), False, now
            part = part.slice(1)
        if part.num_rows:
            keys, change = _digests(part.column(2)), part.column(3).to_numpy()
            for k in (1, 2):
                if (gone := change <= -k).any():
                    held.remove(keys[gone])
                if (new := change >= k).any():
                    full |= not held.add(keys[new])
    if held is not None:
        yield told()


def _shard(count: int):
    return F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")


def _copies(lo: str, hi: str):
    return F.when(F.col(lo).isNull(), 0).when(F.col(lo) == F.col(hi), 1).otherwise(2)


def _held(references: DataFrame) -> DataFrame:
    """key, lo, hi: the smallest and largest document that holds it."""
    return references.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))


class LineStore(shards.Store):
    """Lines of the documents inserted and not deleted since. The runs of a version are in the order of their changes."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        small_batches(spark)

    def _put(self, df: DataFrame, kind: str) -> shards.Run:
        path = f"{self.root}/runs/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return shards.Run(path, int(self.fs.getContentSummary(self.path(path)).getLength()), 0)

    @staticmethod
    def _kind(run: shards.Run) -> str:
        return run.path.rpartition("/")[2].partition("-")[0]

    def _references(self, runs: list[shards.Run]) -> DataFrame:
        """Those that no later deletion has ended."""
        schema = "key binary, doc_id long, tie int, place int"
        read = self.spark.read.schema(schema).parquet
        ends = [k for k, r in enumerate(runs) if self._kind(r) == "gone"]
        out = None
        for begin, end in zip([-1, *ends], [*ends, len(runs)], strict=True):  # runs between two deletions are ended by the same ones
            paths = [r.path for r in runs[begin + 1 : end] if self._kind(r) == "refs"]
            if paths:
                part = read(*paths)
                later = [runs[k].path for k in ends if k >= end]
                part = part.join(self.spark.read.schema("doc_id long").parquet(*later).distinct(), "doc_id", "left_anti").select(part.columns) if later else part
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def references(self, version: int | None = None) -> DataFrame:
        """key, doc_id, tie, place of every line whose key is long enough."""
        return self._references(self._snapshot(version)[1])

    read = references

    def compact(self) -> int:
        """Writes the references that hold as one run, so that ended ones and the deletions go; Conflict if another writer commits meanwhile."""
        version, runs = self._snapshot()
        old = [r for r in runs if self._kind(r) != "filter"]
        if len(old) < 2:
            return 0
        self._commit(version + 1, [self._put(self._references(runs), "refs"), *(r for r in runs if self._kind(r) == "filter")])
        return len(old) - 1

    def counts(self, version: int | None = None) -> DataFrame:
        """key, documents: exact reference counts."""
        rows = self.references(version).select("key", "doc_id").distinct()
        return rows.groupBy("key").agg(F.count("*").alias("documents"))

    def _filters(self, runs: list[shards.Run]) -> DataFrame | None:
        path = next((r.path for r in reversed(runs) if self._kind(r) == "filter"), None)
        return self.spark.read.schema("shard int, cells binary, copies long, full boolean").parquet(path) if path else None

    def _asked(self, filters: DataFrame, rows: DataFrame, salts: int = 1) -> DataFrame:
        """rows (with a key) with copies, as the filters have it; by shard and salt."""
        count = filters.count()
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int") if salts > 1 else F.lit(0)
        own = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "cells")
        asked = rows.select(_shard(count).alias("shard"), salt.alias("salt"), F.lit(None).cast("binary").alias("cells"), *rows.columns)
        both = own.select("shard", "salt", "cells", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).unionByName(asked)
        both = both.withColumn("shard", F.col("shard") * salts + F.col("salt"))  # a filter of its own for each salt
        dealt = both.repartition("shard").sortWithinPartitions("shard", F.col("cells").isNull())
        return dealt.mapInArrow(_probe, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", copies int")

    def _changed(self, filters: DataFrame | None, changes: DataFrame, every) -> shards.Run:
        """The filters after the changes (key, change); built anew from every() (key, change from nothing) where they are too full."""
        if filters is not None:
            count = filters.count()
            total = (filters.agg(F.sum("copies")).first()[0] or 0) + (changes.agg(F.sum("change")).first()[0] or 0)
            if total <= FULL * count:
                run = self._poured(filters, changes, count)
                if run is not None:
                    return run
            changes = every()
        total = changes.agg(F.sum("change")).first()[0] or 0
        count = max(1, -(-2 * total // FULL))  # half full
        while (run := self._poured(None, changes, count)) is None:
            count *= 2
        return run

    def _poured(self, filters: DataFrame | None, changes: DataFrame, count: int) -> shards.Run | None:
        own = filters.select("shard", "cells") if filters is not None else self.spark.range(count).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("cells"))
        own = own.select("shard", "cells", F.lit(None).cast("binary").alias("key"), F.lit(0).alias("change"))
        both = own.union(changes.where("change <> 0").select(_shard(count).alias("shard"), F.lit(None).cast("binary").alias("cells"), "key", F.col("change").cast("int").alias("change")))
        new = both.repartition("shard").sortWithinPartitions("shard", F.col("cells").isNull(), "key").mapInArrow(_fill, "shard int, cells binary, copies long, full boolean")
        run = self._put(new, "filter")
        return None if self._filters([run]).agg(F.bool_or("full")).first()[0] else run

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Adds the lines of docs; Conflict if another writer commits meanwhile."""
        version, runs = self._snapshot()
        added = self._put(lines(numbered(texts(docs, id_col, text_col))), "refs")
        new = written(_held(self._references([added])), "keys")
        filters = self._filters(runs)
        if filters is None:
            changes = new.select("key", _copies("lo", "hi").alias("change"))
        else:
            asked = written(self._asked(filters, new), "asked")
            known = asked.where("copies > 0")
            before = _held(self._references(runs).join(known.select("key"), "key", "left_semi")).toDF("key", "old_lo", "old_hi")
            both = known.join(before, "key", "left").withColumns({"all_lo": F.least("lo", "old_lo"), "all_hi": F.greatest("hi", "old_hi")})
            of_known = both.select("key", (_copies("all_lo", "all_hi") - _copies("old_lo", "old_hi")).alias("change"))
            changes = written(asked.where("copies = 0").select("key", _copies("lo", "hi").alias("change")).union(of_known), "changes")
        after = [*runs, added]
        every = lambda: written(_held(self._references(after)).select("key", _copies("lo", "hi").alias("change")), "keys")
        self._commit(version + 1, [*(r for r in after if self._kind(r) != "filter"), self._changed(filters, changes, every)])

    append = insert

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents with these ids out; lines that only they kept from other documents come back there."""
        version, runs = self._snapshot()
        filters = self._filters(runs)
        if filters is None:
            return
        gone = self._put(texts(ids.select(F.col(id_col), F.lit("").alias("text")), id_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct(), "gone")
        left = self.spark.read.schema("doc_id long").parquet(gone.path).withColumn("gone", F.lit(True))
        now = self._references(runs)
        hit = now.join(left, "doc_id", "left_semi").select("key").distinct()
        rows = now.join(hit, "key", "left_semi").join(left, "doc_id", "left")
        stays = F.when(F.col("gone").isNull(), F.col("doc_id"))
        both = rows.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(stays).alias("new_lo"), F.max(stays).alias("new_hi"))
        changes = written(both.select("key", (_copies("new_lo", "new_hi") - _copies("lo", "hi")).alias("change")), "changes")
        after = [*runs, gone]
        every = lambda: written(_held(self._references(after)).select("key", _copies("lo", "hi").alias("change")), "keys")
        self._commit(version + 1, [*(r for r in after if self._kind(r) != "filter"), self._changed(filters, changes, every)])

    def repeats(self, only: DataFrame | None = None) -> DataFrame:
        """doc_id, tie, place of the lines that go, in all documents or in those with the ids of `only`."""
        _, runs = self._snapshot()
        filters, every = self._filters(runs), self._references(runs)
        if filters is None:
            return every.select("doc_id", "tie", "place")
        rows = every if only is None else every.join(only.select("doc_id").distinct(), "doc_id", "left_semi").select(every.columns)
        asked = written(self._asked(filters, rows, SALTS).where("copies > 1").select("key", "doc_id", "tie", "place"), "asked")
        source = asked if only is None else every.join(asked.select("key").distinct(), "key", "left_semi")
        shared = written(_held(source).where("lo < hi").select("key", "lo"), "shared")  # written, so that the join can split a key
        return asked.join(shared, "key").where("doc_id > lo").select("doc_id", "tie", "place")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the lines that stay, joined) of every row of docs, which must have the texts they were inserted with."""
        rows = numbered(texts(docs, id_col, text_col))
        places = self.repeats().groupBy("doc_id", "tie").agg(F.collect_list("place").alias("places"))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not gone:
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                each, drop = text.split("\n"), set(gone)
                n_lines.append(len(each))
                n_dropped.append(len(drop))
                kept.append("\n".join(x for k, x in enumerate(each) if k not in drop))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

        joined = rows.join(places, ["doc_id", "tie"], "left").select(own_id(), "text", "places")
        return map_batches(joined, run, "doc_id long, n_lines long, n_dropped long, kept string")


def deduplicate(docs: DataFrame, root: str, arrivals: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """clean() of a new store at root into which docs come in so many arrivals, ranges of ids."""
    store = LineStore(docs.sparkSession, root)
    for rows in shards.arrivals(docs, arrivals, id_col):
        store.insert(rows, id_col, text_col)
    return store.clean(docs, id_col, text_col)
