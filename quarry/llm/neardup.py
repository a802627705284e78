"""Near-duplicates by min-max hashing of word shingles, with links confirmed on full shingle sets.

Words are runs of bytes that aren't ASCII white space, lower-cased (A-Z). A text's set holds its distinct five-word
shingles; a text of fewer words has its whole sequence as one; without words the set is empty and links with nothing. Two
documents link if 100 * intersection >= 75 * union. A component is a set of documents connected by links.

1. Texts with equal shingle sets are one class; its smallest id stands for it.
2. Each permutation of the shingle hashes keeps its minimum and its maximum, so PERMUTATIONS passes give twice as
   many values; bands of ROWS values of a kind are hashed to buckets (a pair at 0.75 shares none of the BANDS buckets with a
   probability of 5e-6).
3. Each representative is compared with the hub (the smallest id of a bucket) that it shares most buckets with; links join
   components. Buckets that still hold several components are then compared across components: small ones as pairs,
   large ones blockwise inside tasks, from which only joining links come. Pairs within one component cannot change the
   result and are never formed, and no other pair of a bucket is left out.

Buckets come from hashes without a secret and are only candidates. Whether sets or shingles are equal is judged by keyed hashes whose key is
drawn for each run: 128 bits for a set as a whole, 64 bits for a shingle when the sets of a pair are compared. A pair then looks more alike
than it is with probability (shingles of one) * (shingles of the other) / 2 ** 64, whoever wrote the texts.

Cases: null and empty texts have n_shingles 0 and stand alone; rows with equal ids are one
document with the links of each of its texts; very long texts are hashed whole, in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buffers, discard, map_batches, texts, written
from quarry.llm.components import components
from quarry.llm.words import Words, blocks, mix

SHINGLE, SIMILARITY = 5, (75, 100)
#: 2 * PERMUTATIONS values in BANDS bands of ROWS.
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS

_U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_SEED = np.random.default_rng(5).integers(0, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) * _U(2) + _U(1)
_ROLL = [_U(pow(0xC2B2AE3D27D4EB4F, k, 1 << 64)) for k in range(SHINGLE)]


def shingles(w: Words, rows: int, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's rows: hashes without a secret, keyed hashes (two columns), and where each row's begin (and the last one's end)."""
    count = np.bincount(w.row, minlength=rows)
    first = np.cumsum(count) - count
    n = len(w.start)
    left = count[w.row] - (np.arange(n) - first[w.row])  # words from here to the row's end
    size = np.minimum(count, SHINGLE)[w.row].astype(np.uint64)  # a short sequence is one shingle, which no longer one can equal
    own = (left >= SHINGLE) | (np.arange(n) == first[w.row])

    def joined(h: np.ndarray) -> np.ndarray:
        value = np.zeros(n, np.uint64)
        for k in range(min(SHINGLE, n)):
            value[: n - k] += np.where(left[: n - k] > k, h[k:] * _ROLL[k], _U(0))
        return mix(value + size)[own]

    secret = w.digests(key)
    value, first_key, second_key = joined(w.hashes(w.start, w.end)), joined(secret[:, 0]), joined(secret[:, 1])
    row = w.row[own]
    order = np.lexsort((first_key, row))
    value, first_key, second_key, row = value[order], first_key[order], second_key[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (first_key[1:] != first_key[:-1]) | (second_key[1:] != second_key[:-1]) | (row[1:] != row[:-1])
    return value[new], np.stack([first_key[new], second_key[new]], axis=1), np.searchsorted(row[new], np.arange(rows + 1))


def minmax(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By set: the minima, then the maxima, of each permutation; sets must not be empty."""
    out = np.empty((len(at) - 1, 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        p = values * _SEED[0, k]
        p ^= p >> _U(32)
        p *= _SEED[1, k]
        out[:, k] = np.minimum.reduceat(p, at[:-1])
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(p, at[:-1])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A bucket number for each band."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        out = out * _U(0x9E3779B97F4A7C15) + mix(signature[:, r::ROWS])
    return mix(out + np.arange(BANDS, dtype=np.uint64))


#: Buckets of at most SMALL members become explicit pairs; larger ones are compared blockwise, so many set elements and sets a block.
SMALL, BLOCK_ELEMENTS, BLOCK_SETS = 16, 400_000, 2_000
#: A set of n shingles can be as like another as n / (n + 1) at most.
LEAST_LINKED = -(-SIMILARITY[0] // (SIMILARITY[1] - SIMILARITY[0]))
NO_ID = -(1 << 63)


def features(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (distinct shingles), set_key (128-bit keyed hash of the set; null if empty), buckets (a number for each band)."""

    def run(batch: pa.RecordBatch):
        data, offsets = buffers(batch.column(1))
        for i, j, w in blocks(data, offsets, IS_WORD):
            values, keyed, at = shingles(w, j - i, key)
            n = np.diff(at)
            full = np.flatnonzero(n)
            starts = at[full]
            of_set = np.zeros((j - i, 2), np.uint64)
            found = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                of_set[full] = np.add.reduceat(mix(keyed), starts, axis=0)
                found = bands(minmax(values, np.append(starts, at[-1])))
            lengths = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(n.astype(np.int64)),
                    pa.array([k.tobytes() if m else None for k, m in zip(of_set, n, strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(found.ravel().view(np.int64))),
                ],
                ["doc_id", "n", "set_key", "buckets"],
            )

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, n long, set_key binary, buckets array<long>")


def shingle_sets(rows: DataFrame, key: bytes) -> DataFrame:
    """doc_id, shingles (the whole set) of doc_id, text."""

    def run(batch: pa.RecordBatch):
        data, offsets = buffers(batch.column(1))
        for i, j, w in blocks(data, offsets, IS_WORD):
            _, keyed, at = shingles(w, j - i, key)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.ascontiguousarray(keyed[:, 0]).view(np.int64)))], ["doc_id", "shingles"])

    return map_batches(rows, run, "doc_id long, shingles array<long>")


def _may_link(n: str, m: str):
    """Sets whose sizes differ more than this cannot link."""
    part, whole = SIMILARITY
    return F.greatest(n, m) * part <= F.least(n, m) * whole


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    part, whole = SIMILARITY
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(whole * F.col("common") >= part * (F.col("total") - F.col("common"))).select("a", "b")


def block_links(ids: np.ndarray, parts: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between different parts, as many as join the parts that any link joins; every pair across parts is compared."""
    part, whole = SIMILARITY
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    value, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[at] > 1
    row, at = row[shared], at[shared]
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    width = int(at[-1]) + 1 if len(at) else 0
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (2 << 20) // len(sets))
    for lo in range(0, width, step):  # the incidence matrix, some columns at a time
        i, j = np.searchsorted(at, [lo, lo + step])
        m = np.zeros((len(sets), min(step, width - lo)), np.float32)
        m[row[i:j], at[i:j] - lo] = 1
        common += m @ m.T
    a, b = np.nonzero(np.triu(whole * common >= part * (size[:, None] + size[None, :] - common), 1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(int(parts[i])), root(int(parts[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def _blockwise(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) in buckets of several components; members: bucket, doc_id, component, blocks (of its bucket)."""
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = members.select("bucket", "doc_id", "component", own.alias("own"), other.alias("other"))
    rows = rows.select("bucket", "doc_id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).distinct()

    def run(table: pa.Table) -> pa.Table:
        column = table["shingles"].combine_chunks()
        values, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        found = block_links(table["doc_id"].to_numpy(), table["component"].to_numpy(), [values[a:b] for a, b in zip(at, at[1:], strict=False)])
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return rows.join(sets, "doc_id").groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    base = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    key = os.urandom(16)
    found = written(features(base, key), "shingles")
    full = found.where("n > 0")
    distinct_sets = written(full.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("buckets").alias("buckets")), "classes")
    members = distinct_sets.where(f"n >= {LEAST_LINKED}").select(F.explode("buckets").alias("bucket"), "doc_id", "n")
    hubs = members.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("hub"), F.count("*").alias("size")).where("size > 1")
    shared = written(members.join(hubs, "bucket").select("bucket", "doc_id", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    wanted = shared.select("doc_id").distinct()
    sets = written(shingle_sets(base.join(wanted, "doc_id", "left_semi"), key), "sets")

    votes = shared.where("doc_id <> hub").groupBy("doc_id", "hub").agg(F.count("*").alias("votes"), F.first("n").alias("n"), F.first("hub_n").alias("hub_n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("votes", -F.col("hub"), "n", "hub_n")).alias("v")).select(F.col("doc_id").alias("a"), (-F.col("v.col2")).alias("b"), "v.n", "v.hub_n")
    links = written(confirmed(best.where(_may_link("n", "hub_n")).select("a", "b"), sets), "links")

    of_hubs = components(links)
    first = written(of_hubs, "components")
    discard(of_hubs)
    placed = shared.select("bucket", "doc_id", "n").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("elements"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    left = written(placed.join(mixed, "bucket").select("bucket", "doc_id", "n", "component", "size", F.greatest(F.ceil(F.col("elements") / BLOCK_ELEMENTS), F.ceil(F.col("size") / BLOCK_SETS)).cast("long").alias("blocks")), "mixed")
    small = left.where(f"size <= {SMALL}").select("bucket", "doc_id", "n", "component")
    x, y = small.toDF("bucket", "a", "n", "p"), small.toDF("bucket", "b", "m", "q")
    pairs = x.join(y, "bucket").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & _may_link("n", "m")).select("a", "b").distinct()
    more = written(confirmed(pairs, sets).union(_blockwise(left.where(f"size > {SMALL}"), sets)), "links")
    parts = components(links.union(more))
    discard(shared, sets, links, first, left, more)

    of_set = distinct_sets.join(parts, distinct_sets.doc_id == parts.node, "left").select("set_key", F.coalesce("component", "doc_id").alias("component"))
    rows = full.join(of_set, "set_key").select("doc_id", "n", "component").union(found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.select(real("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stand for their components."""
    gone = classes(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
