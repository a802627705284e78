"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary, one smoothing and one size. The background counts every token of every
document; the target those of all documents labelled as wanted; the background's counts are scaled to the target's number of tokens, so
that the smoothing weighs alike in both. A bigram's probability backs off to its word's by a Dirichlet prior. A document's score is the
mean over its tokens of target loss minus background loss: the lower, the more like the target. A document's own counts are left out of
the models that judge it.

Words and bigrams are known by 64-bit hashes and counted exactly. Documents are dealt into chunks by a hash of the id, and each chunk
posts its distinct words and bigrams, ascending and counted, by ranges of hashes (blocks, about PART_BYTES of text for each). A block
adds up what all chunks have posted and answers each chunk with the sums in the order of its post, so the counts of the whole corpus are
a distributed table that grows with it and is never gathered. The chunks then judge their documents by those answers. Marks of
wanted ids go to the chunks as documents do, so that a document finds its mark as by a left join.

Cases: null and empty texts have no tokens and score 0; a document's first token is judged by its word alone; without target
labels every score is that of an unseen model; rows with equal ids stay separate rows, but land in one chunk, which a task holds as
tokens; very long texts are counted in blocks but bigrams cross no text's end; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _lean, buffers, release, small_batches, texts, written
from quarry.llm.toxicity import IS_WORD
from quarry.llm.words import blocks, mix

#: Bytes of text for a block of the counts and for a chunk of documents; the fewest chunks; counted keys that a task holds before it adds them up.
PART_BYTES, CHUNK_BYTES, LEAST_CHUNKS, HELD = 16 << 20, 16 << 20, 24, 1 << 21
#: Weight of the word model in a bigram's probability, and added to every word's count.
PRIOR, ADDED = 200.0, 0.5
MARK, REPLY, DOC, CORPUS, QUERY = range(5)
_U = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, each token's row, its word (even), its bigram (odd), whether it starts a text and has no bigram)."""
    for i, j, w in blocks(data, offsets, IS_WORD):
        h = w.hashes(w.start, w.end)
        pair, first = np.ones(len(h), np.uint64), np.ones(len(h), bool)
        if len(h) > 1:
            pair[1:] = mix(h[:-1] * _U(0x9FB21C651E98DF25) + h[1:]) | _U(1)
            first[1:] = w.row[1:] != w.row[:-1]
        yield i, j, w.row, h & ~_U(1), pair, first


def laid(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Ascending words, then ascending bigrams, cut into blocks; words fill an eighth as many blocks."""
    n_words = int((keys & _U(1) == 0).sum())
    for a, b in ((0, n_words), (n_words, len(keys))):
        r = ((keys[a:b] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
        r = r if a or not n_words else -1 - (r >> 3)
        cut = np.flatnonzero(np.diff(r)) + 1
        for x, y in zip([0, *cut], [*cut, b - a], strict=True):
            if y > x:
                yield int(r[x]), slice(a + x, a + y)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and their counts (2 rows)."""
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    n = np.concatenate([x for _, x in held], axis=1)
    return keys, np.stack([np.bincount(at, x, len(keys)).astype(np.int64) for x in n])  # exact below 2**53


def distinct(held: list[np.ndarray]) -> np.ndarray:
    """Words, then bigrams, each once and ascending."""
    keys = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
    odd = keys & _U(1) == 1
    return np.concatenate([keys[~odd], keys[odd]])


_ZSTD = pa.Codec("zstd", 1)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte of their places, so that the many zero bytes lie together; compressed, behind their size."""
    raw = np.ascontiguousarray(x.reshape(-1)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _flat(data: bytes) -> np.ndarray:
    raw = _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def sealed(keys: np.ndarray) -> bytes:
    """Ascending keys by their steps."""
    return _planes(np.diff(keys, prepend=_U(0)).astype("<u8"))


def opened(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data), dtype=np.uint64)


def packed(n: np.ndarray) -> bytes:
    return _planes(n.astype("<i8"))


def unpacked(data: bytes) -> np.ndarray:
    return _flat(data).view("<i8").reshape(2, -1)


_POSTED = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("n_keys", pa.int64()), ("background", pa.int64()), ("target", pa.int64())])


class Models(NamedTuple):
    """Both models' tokens (background, target) and the number of words."""

    total: np.ndarray
    vocabulary: int


def losses(models: Models, row: np.ndarray, first: np.ndarray, at: np.ndarray, pair_at: np.ndarray, word: np.ndarray, pair: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Each token's loss in nats under the background and the target.

    at, pair_at: places of its word and bigram; word, pair: their counts (2 rows); counted: by row, whether the background and the target
    count it (2 rows).
    """
    total, vocabulary = models
    scale = (total[1] / total[0] if total.all() else 1.0, 1.0)
    out = np.empty((2, len(at)))
    own_word, own_pair = _own(row, at), _own(row, pair_at) * ~first
    own_all = np.bincount(row)[row] if len(row) else own_word
    before = lambda x: np.append(0, x[:-1])[: len(x)]
    for k in (0, 1):
        own = counted[k][row].astype(float)
        single = (scale[k] * (word[k] - own * own_word) + ADDED) / (scale[k] * (total[k] - own * own_all) + ADDED * (vocabulary + 1))
        context = scale[k] * (before(word[k]) - own * before(own_word))
        joint = (scale[k] * (pair[k] - own * own_pair) + PRIOR * single) / (context + PRIOR)
        out[k] = -np.log(np.where(first, single, joint))
    return out


def _own(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each token's word or bigram comes up in its own row."""
    _, where, n = np.unique(row.astype(np.int64) << 32 | at, return_inverse=True, return_counts=True)
    return n[where]


def _size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def dealt(docs: DataFrame, chosen: DataFrame, chunks: int, replies: DataFrame | None = None) -> DataFrame:
    """chunk, kind, block, doc_id, text, data, by chunks: marks of wanted ids, replies, documents; docs: kind, doc_id, text."""
    chunk: Callable[[Column], Column] = lambda c: F.pmod(F.hash(c), F.lit(chunks)).cast("int").alias("chunk")
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    out = docs.select(chunk(F.coalesce("doc_id", F.xxhash64("text"))), "kind", F.lit(0).alias("block"), "doc_id", "text", no("binary", "data"))
    out = out.union(chosen.select(chunk(F.col("doc_id")), F.lit(MARK), F.lit(0), "doc_id", no("string", "text"), no("binary", "data")))
    if replies is not None:
        out = out.union(replies.select("chunk", F.lit(REPLY), "block", no("long", "doc_id"), no("string", "text"), "data"))
    small_batches(docs.sparkSession)
    return out.repartition("chunk").sortWithinPartitions("chunk", "kind")


def _by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, int, pa.RecordBatch]]]]:
    def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(chunk)], strict=True):
                if b > a:
                    yield int(chunk[a]), int(kind[a]), batch.slice(a, b - a)

    return groupby(pieces(), lambda p: p[0])


def _counted(kind: int, ids: pa.Array, marks: list[np.ndarray]) -> np.ndarray:
    """By row, whether the background and the target count it."""
    out = np.zeros((2, len(ids)), bool)
    if kind != QUERY:
        out[0] = True
        if marks:
            out[1] = np.isin(ids.fill_null(0).to_numpy(), np.concatenate(marks)) & ids.is_valid().to_numpy(zero_copy_only=False)
    return out


def post(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From dealt(): each chunk's distinct words and bigrams by blocks, with their counts in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        for chunk, group in _by_chunk(batches):
            marks, held, size = [], [], 0
            for _, kind, part in group:
                if kind == MARK:
                    marks.append(part.column(3).to_numpy())
                    continue
                counted = _counted(kind, part.column(3), marks)
                for i, j, row, word, pair, first in grams(*buffers(part.column(4))):
                    own = counted[:, i:j][:, row]
                    held.append(summed([(np.concatenate([word, pair[~first]]), np.concatenate([own, own[:, ~first]], axis=1))]))
                    size += len(held[-1][0])
                    if size >= HELD and size >= 2 * len(held[0][0]):
                        held = [summed(held)]
                        size = len(held[0][0])
            if not held:
                continue
            keys, n = summed(held)
            order = np.argsort(keys & _U(1), kind="stable")
            keys, n = keys[order], n[:, order]
            for block, at in laid(keys, parts):
                yield pa.RecordBatch.from_pydict({"block": [block], "chunk": [chunk], "keys": [sealed(keys[at])], "n": [packed(n[:, at])]}, schema=_POSTED)

    return run


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From posts by blocks: to each chunk the sums of its keys; and a row of each block's totals (chunk -1)."""
    _lean()
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for block, group in groupby(rows, lambda r: r[0]):
        posts, held, size = [], [], 0
        for _, chunk, keys, n in group:
            posts.append((chunk, keys))
            held.append((opened(keys), unpacked(n)))
            size += len(held[-1][0])
            if size >= HELD and size >= 2 * len(held[0][0]):
                held = [summed(held)]
                size = len(held[0][0])
        keys, n = summed(held)
        held.clear()
        yield pa.RecordBatch.from_pydict({"chunk": [-1], "block": [block], "data": [None], "n_keys": [int((n[0] > 0).sum())], "background": [int(n[0].sum())], "target": [int(n[1].sum())]}, schema=_REPLY)
        for chunk, own in posts:
            reply = packed(n[:, np.searchsorted(keys, opened(own))])
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "block": [block], "data": [reply], "n_keys": [None], "background": [None], "target": [None]}, schema=_REPLY)


def judge(models: Models, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From dealt() with replies: the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        for _, group in _by_chunk(batches):
            marks, replies, held = [], {}, []
            for _, kind, part in group:
                if kind == MARK:
                    marks.append(part.column(3).to_numpy())
                elif kind == REPLY:
                    replies |= dict(zip(part.column(2).to_pylist(), part.column(5).to_pylist(), strict=True))
                else:
                    counted = _counted(kind, part.column(3), marks)
                    for i, j, row, word, pair, first in grams(*buffers(part.column(4))):
                        ids = pa.array(part.column(3).slice(i, j - i).to_pylist(), pa.int64())  # a copy: the batch is let go
                        held.append((kind, ids, counted[:, i:j], row.astype(np.int32), word, pair, first))
            keys = distinct([np.unique(np.concatenate([h[4], h[5][~h[6]]])) for h in held])
            n = np.zeros((2, len(keys)), np.int64)
            for block, at in laid(keys, parts):
                n[:, at] = unpacked(replies.pop(block))
            n_words = int((keys & _U(1) == 0).sum())
            for kind, ids, counted, row, word, pair, first in held:
                if kind == CORPUS:
                    continue
                at = np.searchsorted(keys[:n_words], word)
                pair_at = np.where(first, 0, n_words + np.searchsorted(keys[n_words:], np.where(first, _U(0), pair)))
                size = np.bincount(row, minlength=len(ids))
                found = losses(models, row, first, at, pair_at, n[:, at], n[:, pair_at], counted)
                background, target = (np.bincount(row, x, minlength=len(ids)) / np.maximum(size, 1) for x in found)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (size.astype(np.int64), target, background, target - background))], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    return run


class Scoring(NamedTuple):
    """What fit() leaves: the documents to judge with marks' ids, the replies, the models, and how the work is cut."""

    rows: DataFrame
    chosen: DataFrame
    replies: DataFrame
    models: Models
    chunks: int
    parts: int

    def scores(self) -> DataFrame:
        return dealt(self.rows, self.chosen, self.chunks, self.replies.where("chunk >= 0")).mapInArrow(judge(self.models, self.parts), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def fit(docs: DataFrame, wanted: DataFrame, queries: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> Scoring:
    """Models of docs; wanted: doc_id of those that are like the target. queries: judge these instead of docs (they aren't counted)."""
    spark = docs.sparkSession
    chosen = written(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "target")
    rows = texts(docs, id_col, text_col).select(F.lit(DOC if queries is None else CORPUS).alias("kind"), "doc_id", "text")
    if queries is not None:
        rows = rows.union(texts(queries, id_col, text_col).select(F.lit(QUERY).alias("kind"), "doc_id", "text"))
    n_bytes = _size(rows)
    chunks, parts = max(LEAST_CHUNKS, -(-n_bytes // CHUNK_BYTES)), max(8, -(-n_bytes // PART_BYTES))
    replies = written(
        dealt(rows, chosen, chunks)
        .mapInArrow(post(parts), "block int, chunk int, keys binary, n binary")
        .repartition("block")
        .sortWithinPartitions("block", "chunk")
        .mapInArrow(tally, "chunk int, block int, data binary, n_keys long, background long, target long"),
        "replies",
    )
    release(spark)
    words = replies.where("chunk < 0 and block < 0").agg(F.sum("background"), F.sum("target"), F.sum("n_keys")).first()
    return Scoring(rows, chosen, replies, Models(np.array([words[0] or 0, words[1] or 0], np.int64), words[2] or 0), chunks, parts)


def score(docs: DataFrame, wanted: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (means), score of every whole text."""
    return fit(docs, wanted, **options).scores()
