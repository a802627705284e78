"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

A word is a run of letters, digits and non-ASCII bytes, lower-cased (A-Z). A text's features are the distinct hashes of its
words, their first five bytes, adjacent pairs and pairs with one word between. Each coordinate has its own
learning rate; L1 leaves most weights at exactly zero, so the model is a short list of (bucket, weight), of at most
BUCKETS entries, which is broadcast. Training uses at most `sample` labelled rows (those with the smallest hashes
of their ids), in shards of at most SHARD_ROWS rows whose weights are averaged.

Cases: null and empty texts get the score of the bias alone; labels that are null or without a document are ignored, of several
for one document the largest counts; without any label of either class every score is the base rate (0 without labels);
equal texts get equal scores; rows with equal ids stay separate rows; an empty table gives no rows; other columns never
enter a score.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buffers, map_batches
from quarry.llm.words import Words, blocks, mix

BITS = 20
BUCKETS = 1 << BITS
#: At most so many labelled rows are trained on, and so many in one shard.
SAMPLE, SHARD_ROWS = 24_000, 6_000
#: FTRL-proximal: learning rate, its smoothing, L1, L2; passes over a shard.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 0.0, 5
#: A bucket is trained if so many of a shard's rows have it.
LEAST_ROWS = 5
THRESHOLD = 0.3
PREFIX = 5

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_U = np.uint64


def features(w: Words, shapes: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays: words, word prefixes, pairs, pairs with one word between; shapes: also what stands between words, and repeats of a word."""
    word = w.hashes(w.start, w.end)
    prefix = w.hashes(w.start, np.minimum(w.start + PREFIX, w.end))
    out = [(w.row, word), (w.row, prefix * _U(0xA24BAED4963EE407))]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        same = w.row[gap:] == w.row[:-gap]
        out.append((w.row[gap:][same], mix(word[:-gap][same] * _U(salt) + word[gap:][same])))
    if shapes and len(word) > 1:
        same = w.row[1:] == w.row[:-1]
        out.append((w.row[1:][same], w.hashes(w.end[:-1], w.start[1:])[same] * _U(0x94D049BB133111EB)))
        twice = same & (word[1:] == word[:-1])
        out.append((w.row[1:][twice], np.full(int(twice.sum()), 0xBF58476D1CE4E5B9, np.uint64)))
    return [(row, (h >> _U(64 - BITS)).astype(np.int64)) for row, h in out]


def distinct(rows: list[np.ndarray], buckets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.concatenate(rows) << BITS | np.concatenate(buckets))
    return pairs >> BITS, pairs & (BUCKETS - 1)


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


class Ftrl:
    """Binary FTRL-proximal over sets of buckets; the last coordinate is the bias, without L1."""

    def __init__(self, base_rate: float):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        self.l1 = np.full(BUCKETS + 1, L1)
        self.l1[-1] = 0
        p = min(max(base_rate, 1e-3), 1 - 1e-3)
        self.z[-1] = -np.log(p / (1 - p)) * (BETA / ALPHA + L2)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, l1 = self.z[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclasses.dataclass(frozen=True)
class Model:
    """Weights by bucket and class; classes in the order of `names`."""

    names: tuple[str, ...]
    bucket: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((BUCKETS, len(self.names)), np.float32)
        out[self.bucket] = self.weight
        return out

    def margins(self, data: np.ndarray, offsets: np.ndarray, dense: np.ndarray, shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Rows by classes: the sums of the distinct features' weights; and each row's number of words."""
        out = np.tile(self.bias, (len(offsets) - 1, 1))
        words = np.zeros(len(offsets) - 1, np.int64)
        live = dense.any(axis=1)
        for i, j, w in blocks(data, offsets, IS_WORD):
            words[i:j] = np.bincount(w.row, minlength=j - i)
            rows, found = [], []
            for row, bucket in features(w, shapes):
                keep = live[bucket]
                rows.append(row[keep])
                found.append(bucket[keep])
            row, bucket = distinct(rows, found)
            for k in range(len(self.names)):
                out[i:j, k] += np.bincount(row, dense[bucket, k], minlength=j - i)
        return out, words


def _examples(docs: DataFrame, labels: DataFrame, sample: int, shapes: bool, id_col: str, text_col: str) -> DataFrame:
    """shard, doc_id, label, buckets of at most `sample` labelled rows; labels: doc_id, label (a string), one row for each id."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sample = min(sample, labels.count())
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = max(1, -(-sample // SHARD_ROWS))
    # `chosen` has at most `sample` rows of two small columns
    rows = known.join(F.broadcast(chosen), "doc_id").select((F.abs(F.xxhash64("doc_id", F.lit(7))) % shards).cast("int").alias("shard"), "doc_id", "label", "text")

    def run(batch: pa.RecordBatch):
        data, offsets = buffers(batch.column(3))
        for i, j, w in blocks(data, offsets, IS_WORD):
            row, bucket = distinct(*zip(*features(w, shapes), strict=True))
            at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(3)), pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32)))], ["shard", "doc_id", "label", "buckets"])

    return map_batches(rows, run, "shard int, doc_id long, label string, buckets array<int>")


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...], sample: int = SAMPLE, shapes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """One-against-rest models of `names`; labels: doc_id, label (strings)."""
    examples = _examples(docs, labels, sample, shapes, id_col, text_col)

    def train(table: pa.Table) -> pa.Table:
        order = np.argsort(mix(np.array(table["doc_id"].to_pylist(), np.int64).astype(np.uint64)), kind="stable")
        label = np.array(table["label"].to_pylist(), dtype=object)
        sets = table["buckets"].combine_chunks()
        at, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        common = np.bincount(flat, minlength=BUCKETS) >= LEAST_ROWS
        seen = [x[common[x]] for x in np.split(flat, at[1:-1])]
        out = []
        for k, name in enumerate(names):
            y = (label == name).astype(float)
            m = Ftrl(float(y.mean()))
            if 0 < y.mean() < 1:
                for _ in range(EPOCHS):
                    for i in order:
                        m.learn(np.append(seen[i], BUCKETS), y[i])
            w = m.weights(slice(None))
            live = np.flatnonzero(w)
            live = np.union1d(live, [BUCKETS])
            out.append(pa.table({"k": pa.array(np.full(len(live), k, np.int32)), "bucket": pa.array(live.astype(np.int32)), "weight": pa.array(w[live])}))
        return pa.concat_tables(out)

    learned = examples.groupBy("shard").applyInArrow(train, "k int, bucket int, weight double")
    merged = learned.groupBy("k", "bucket").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).toArrow()  # at most BUCKETS + 1 rows a class
    k, bucket, weight, n = (merged[c].to_numpy() for c in ("k", "bucket", "weight", "n"))
    trained = max(1, int(n[bucket == BUCKETS].max(initial=1)))
    weight = weight / trained
    bias = np.full(len(names), -30.0)
    bias[k[bucket == BUCKETS]] = weight[bucket == BUCKETS]
    own = bucket < BUCKETS
    rows, at = np.unique(bucket[own], return_inverse=True)
    dense = np.zeros((len(rows), len(names)), np.float32)
    dense[at, k[own]] = weight[own]
    return Model(names, rows.astype(np.int32), dense, bias)


def toxic_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label ('1' or '0') of the rows that may be trained on."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, "1").otherwise("0")).alias("label"))


def fit_toxic(docs: DataFrame, labels: DataFrame, **options) -> Model:
    return fit(docs, toxic_labels(labels), ("1",), **options)


def probabilities(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))


def _scorer(df: DataFrame, model: Model):
    held = df.sparkSession.sparkContext.broadcast(model)
    state: dict[str, np.ndarray] = {}

    def run(column: pa.Array) -> np.ndarray:
        m = held.value
        if "w" not in state:
            state["w"] = m.dense()
        return probabilities(m.margins(*buffers(column), state["w"])[0])[:, 0]

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text."""
    run = _scorer(docs, model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(run(b.column(1)), pa.float64())], ["doc_id", "score"]), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    run = _scorer(docs, model)
    at = docs.columns.index(text_col)
    return map_batches(docs, lambda b: b.filter(pa.array(run(b.column(at)) < threshold)), docs.schema)
