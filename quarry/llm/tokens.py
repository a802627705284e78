"""Token ids in directly addressable files.

Each shard is a file of its own, written and read through pyarrow's file systems (the shared folder must be in a store that these open on the
executors); a table beside them, which Spark commits, names the files that count, so those of lost or repeated tasks are never read.

A shard holds the ids of whole documents. An id is split into 8-bit chunks, lowest first: level 0 has a
byte for every id, and a bit in the level's continuation bitmap says whether the next level holds more of it. A directory of
ranks (set bits before each 512-bit block) turns an id's place on one level into its place on the next, so that any id is
read by one byte and at most one popcount of 64 bytes a level, without decoding what lies before it.

Layout, little-endian: b"DAC1", u32 levels, u64 ids, u64 documents; by level u64 bytes; by level the chunk bytes; by level
but the last the bitmap (64-byte blocks) and the u64 ranks; then documents' ids (i64) and starts in the shard (u64).

Shard opens a file and reads single ids, or the ids of a stretch or of a document, by their places alone; from bytes it does the same
in memory.

Cases: null text is empty and holds the end id alone; documents are in ascending doc_id order (nulls
first), equal ids in the order of their texts' hashes; a document never spans shards, however long; an empty
table writes no shard and reads no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import buffers, scratch, slices, small_batches, texts
from quarry.llm.pieces import FIRST, PieceTable

MAGIC, END_ID, BLOCK_BITS = b"DAC1", 2, 512
#: A shard is closed after the batch of documents that brings it to so many ids.
SHARD_IDS = 1 << 20
#: Texts handed to the encoder together.
BYTES_AT_ONCE = 2000 << 10
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray, doc_ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A shard of these ids; starts: where each document begins."""
    rest, chunks, maps = ids.astype(np.uint32), [], []
    while True:
        chunks.append((rest & 0xFF).astype(np.uint8))
        more = rest > 0xFF
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK_BITS // 8), np.uint8)])
        maps.append((bits, np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, BLOCK_BITS // 8).sum(axis=1))[:-1]]).astype("<u8")))
        rest = rest[more] >> 8
    out = [MAGIC, struct.pack("<IQQ", len(chunks), len(ids), len(doc_ids)), struct.pack(f"<{len(chunks)}Q", *map(len, chunks)), *(c.tobytes() for c in chunks)]
    out += [x.tobytes() for m in maps for x in m]
    return b"".join([*out, doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()])


class Shard:
    """Random access to the ids of a packed shard; source: its bytes, or an open file of pyarrow's."""

    def __init__(self, source):
        self.read = (lambda at, size: source[at : at + size]) if isinstance(source, (bytes, memoryview)) else (lambda at, size: source.read_at(size, at))
        if bytes(self.read(0, 4)) != MAGIC:
            raise ValueError("not a token shard")
        levels, self.n, self.docs = struct.unpack("<IQQ", self.read(4, 20))
        self.sizes = struct.unpack(f"<{levels}Q", self.read(24, 8 * levels))
        at = 24 + 8 * levels
        self.chunk_at = [at + sum(self.sizes[:k]) for k in range(levels)]
        at += sum(self.sizes)
        self.maps = []  # where a level's bitmap and ranks begin
        for size in self.sizes[:-1]:
            blocks = -(-size // BLOCK_BITS)
            self.maps.append((at, at + blocks * BLOCK_BITS // 8))
            at += blocks * (BLOCK_BITS // 8 + 8)
        self.docs_at = at

    def __len__(self) -> int:
        return self.n

    def _array(self, kind: str, count: int, at: int) -> np.ndarray:
        return np.frombuffer(self.read(at, count * np.dtype(kind).itemsize), kind)

    def _ones_before(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before place i: a rank and at most one block."""
        bits, ranks = self.maps[level]
        block = i // BLOCK_BITS
        if block * BLOCK_BITS == self.sizes[level]:  # behind the last block
            return self.sizes[level + 1]
        n = int(self._array("<u8", 1, ranks + 8 * block)[0])
        own = self._array("u1", (i >> 3) - block * BLOCK_BITS // 8 + 1, bits + block * BLOCK_BITS // 8)
        return n + int(_ONES[own[:-1]].sum()) + int(_ONES[own[-1] & (1 << (i & 7)) - 1])

    def __getitem__(self, i: int) -> int:
        """The i-th id, from one byte a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, at in enumerate(self.chunk_at):
            value |= int(self._array("u1", 1, at + i)[0]) << 8 * level
            if level == len(self.maps) or not self._array("u1", 1, self.maps[level][0] + (i >> 3))[0] >> (i & 7) & 1:
                break
            i = self._ones_before(level, i)
        return value

    def ids(self, a: int = 0, b: int | None = None, level: int = 0) -> np.ndarray:
        """The ids at places a to b (on a level: what they have from it on), of which alone the bytes are read."""
        b = self.sizes[level] if b is None else b
        value = self._array("u1", b - a, self.chunk_at[level] + a).astype(np.uint32)
        if level < len(self.maps) and b > a:
            byte = a >> 3
            more = np.unpackbits(self._array("u1", (b + 7 >> 3) - byte, self.maps[level][0] + byte), bitorder="little")[a - 8 * byte : b - 8 * byte].view(bool)
            first, n = self._ones_before(level, a), int(more.sum())
            value[more] |= self.ids(first, first + n, level + 1) << np.uint32(8)
        return value

    @functools.cached_property
    def doc_ids(self) -> np.ndarray:
        return self._array("<i8", self.docs, self.docs_at)

    @functools.cached_property
    def starts(self) -> np.ndarray:
        return self._array("<u8", self.docs, self.docs_at + 8 * self.docs).astype(np.int64)

    def document(self, doc_id: int) -> np.ndarray:
        """The ids of the first document with this id."""
        k = int(np.searchsorted(self.doc_ids, doc_id))
        if k == self.docs or self.doc_ids[k] != doc_id:
            raise KeyError(doc_id)
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < self.docs else self.n)


def open_file(path: str):
    """A file of pyarrow's for random reads."""
    store, place = FileSystem.from_uri(path)
    return store.open_input_file(place)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts by the tokenizers library, which sees each piece that isn't remembered once, many of them a call."""

    JOINED = 200

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        words = self.library.get_vocab()
        self.spaced = np.zeros(max(words.values()) + 1, bool)
        self.spaced[[i for word, i in words.items() if word.startswith("\u0120")]] = True
        self.pieces = PieceTable(self._learn)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Pieces that hold no space and no white space at an end are joined by spaces: then a token that starts with a space starts a piece."""
        plain, odd = [], []
        for i, x in enumerate(new):
            (odd if " " in x or not x or x != x.strip() else plain).append(i)
        joined = [" " + " ".join(map(new.__getitem__, plain[i : i + self.JOINED])) for i in range(0, len(plain), self.JOINED)]
        rest = [new[i][1:] if new[i].startswith(FIRST) else " " + new[i] for i in odd]
        found = [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(joined + rest, add_special_tokens=False)]
        ids = np.concatenate(found[: len(joined)]) if joined else np.zeros(0, np.int32)
        begins = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        if len(begins) != len(plain) + 1:
            raise ValueError("the vocabulary has tokens that start with a space inside a word")
        rest = found[len(joined) :]
        return np.concatenate([ids, *rest]), np.concatenate([np.diff(begins), np.array([len(x) for x in rest], np.int64)]), plain + odd


@functools.cache
def tokenizer(path: str) -> Encoder:
    return Encoder(path)


_ROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("file", pa.string())])
_INDEX = "part int, seq int, before long, n_ids long, first long, last long, file string"


def write(docs: DataFrame, root: str, path: str | None = None, shard_ids: int = SHARD_IDS, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts in ascending doc_id order into shards under root (a folder that all executors share), and an index of them."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        table, part, seq, before = tokenizer(path).pieces, TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, documents' ids and lengths

        def shard():
            ids, names, lengths = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            file = f"{root}/shards/{part:06d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.dac"
            store, place = FileSystem.from_uri(file)
            store.create_dir(place.rpartition("/")[0], recursive=True)
            with store.open_output_stream(place) as out:
                out.write(pack(ids, names, np.cumsum(lengths) - lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "before": [before], "n_ids": [len(ids)], "first": [int(names[0])], "last": [int(names[-1])], "file": [file]}, schema=_ROW), len(ids)

        for batch in batches:
            names = batch.column(0).fill_null(NO_ID).to_numpy()
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, BYTES_AT_ONCE):
                ids, at = table.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append((np.insert(ids, at[1:], end_id), names[i:j], np.diff(at) + 1))
                if sum(len(x[0]) for x in held) >= shard_ids:
                    row, n = shard()
                    yield row
                    seq, before = seq + 1, before + n
        if held:
            yield shard()[0]

    small_batches(spark)
    ordered = texts(docs, id_col, text_col).repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, _INDEX).write.parquet(f"{root}/index")


#: Stands for a null doc_id in a shard.
NO_ID = -(1 << 63)


def index(spark: SparkSession, root: str) -> DataFrame:
    """A row for each shard: part and seq (its place in the order), before (ids of the part before it), n_ids, first and last doc_id, file."""
    return spark.read.schema(_INDEX).parquet(f"{root}/index")


def read(spark: SparkSession, root: str) -> DataFrame:
    """From the shards under root, per document: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    shards = index(spark, root)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each range of ids
    starts = np.cumsum([0, *(r.n for r in parts)]).tolist()
    base = {r.part: b for r, b in zip(parts, starts, strict=False)}

    def run(batches):
        for batch in batches:
            for part, before, file in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with open_file(file) as f:
                    s, first = Shard(memoryview(f.read_buffer())), base[part] + before
                ends = np.append(s.starts[1:], len(s))
                sums = [zlib.crc32(s.ids(a, b).astype("<u4").tobytes()) for a, b in zip(s.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([None if x == NO_ID else x for x in s.doc_ids.tolist()], pa.int64()), pa.array(s.starts + first), pa.array(ends - s.starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each few shards, however small the index's files are
    tasks = max(1, min(sum(1 for _ in parts) * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return shards.select("part", "before", "file").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document(spark: SparkSession, root: str, doc_id: int) -> np.ndarray:
    """The ids of one document: of the shards, one file is opened, and of it the document's bytes are read."""
    rows = index(spark, root).where((F.col("first") <= doc_id) & (F.col("last") >= doc_id)).orderBy("part", "seq").select("file").take(1)
    if not rows:
        raise KeyError(doc_id)
    with open_file(rows[0].file) as f:
        return Shard(f).document(doc_id)


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    root = scratch(docs.sparkSession, "tokens")
    write(docs, root, **options)
    return read(docs.sparkSession, root)
