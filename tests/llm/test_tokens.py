"""BPE, token files and media: against the libraries and by exact round trips."""

import base64
import hashlib
import random
import struct
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from quarry.llm import bpe, media, queries, tokens
from quarry.llm.common import scratch

SF = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "the", "  ", "\n", " ", "é", "ß", "中", "😀", "'s", "123", "\x1c", " ", "!!", "ing", "\t", "er", " t", "<|endoftext|>", "\u00a0", "\u2003", "\u3000", "\x85", "\u2014", "\u00e9", "x y"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_merging_by_rank(reference):
    c, r = bpe.codec(bpe.vocabulary()), random.Random(2)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, "abc" * 3000, " " * 4000, "\n \n" * 1000]
    ids, at = c.pieces.encode_texts(texts)
    for i, text in enumerate(texts):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == reference.encode_ordinary(text)
        assert c.decode(own).tobytes() == text.encode()


def test_pieces_equal_whole_texts():
    t, e, r = Tokenizer.from_file(tokens.tokenizer_path()), tokens.tokenizer(tokens.tokenizer_path()), random.Random(3)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    ids, at = e.pieces.encode_texts(texts)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids


def thue_morse(a, b, n):
    """Words like this collide under every polynomial hash modulo a power of two."""
    for _ in range(n):
        a, b = a + b, b + a
    return a


def test_patterns_that_collide(reference):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    for n in (10, 12):
        texts = ["go " + thue_morse("a", "b", n), "go " + thue_morse("b", "a", n), "go on", thue_morse("b", "a", n)]
        for encoder, want in ((bpe.codec(bpe.vocabulary()), reference.encode_ordinary), (tokens.tokenizer(tokens.tokenizer_path()), lambda x: t.encode(x, add_special_tokens=False).ids)):
            ids, at = encoder.pieces.encode_texts(texts)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [want(x) for x in texts]


@pytest.mark.parametrize("encoder", ["bpe", "library"])
def test_pieces_of_equal_hash(monkeypatch, encoder, reference):
    """With two hash values for all pieces, the bytes alone tell them apart."""
    from quarry.llm import pieces

    monkeypatch.setattr(pieces, "stretches", lambda data, eights, start, end: (end - start).astype(np.uint64) & np.uint64(1))
    c = bpe.codec(bpe.vocabulary()) if encoder == "bpe" else tokens.tokenizer(tokens.tokenizer_path())
    table = pieces.PieceTable(c._learn_pieces if encoder == "bpe" else c._learn, most=40)
    r = random.Random(4)
    for _ in range(20):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(20)]
        ids, at = table.encode_texts(texts)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference.encode_ordinary(x) if encoder == "bpe" else c.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_texts(spark, reference):
    """A text above every block size, and one word of a megabyte, through Spark."""
    r = random.Random(9)
    docs = [(1, " ".join(r.choice(["alpha", "beta,", "gamma.", "été", "x" * 70]) for _ in range(500_000))), (2, "z" * 1_000_000), (3, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(df)).collect()}
    assert all(bytes(got[i].decoded) == t.encode() for i, t in docs) and got[1].ids == reference.encode_ordinary(docs[0][1])
    start = {x.doc_id: (x.start, x.n_tokens) for x in tokens.write_and_read(df).collect()}
    assert start[2][0] == start[1][1] and start[3][0] == sum(start[2])


def test_op3(spark, small, reference):
    got = {r.doc_id: r for r in queries.op3_bpe(spark, SF).collect()}
    for r in small.collect():
        ids = reference.encode_ordinary(r.text)
        assert tuple(got[r.doc_id])[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_op7(spark, small):
    t, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    got = {r.doc_id: r for r in queries.op7_token_files(spark, SF).collect()}
    for r in small.orderBy("doc_id").collect():
        ids = [*t.encode(r.text, add_special_tokens=False).ids, 2]
        assert tuple(got[r.doc_id])[1:] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_shard_random_access():
    r = np.random.default_rng(1)
    ids = r.choice([0, 5, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], 3000).astype(np.uint32)
    s = tokens.Shard(tokens.pack(ids, np.array([7, 9]), np.array([0, 1500])))
    assert (s.ids() == ids).all() and [s[i] for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert s.doc_ids.tolist() == [7, 9] and s.starts.tolist() == [0, 1500]
    with pytest.raises(IndexError):
        s[3000]
    for a, b in ((0, 0), (0, 1), (511, 513), (512, 1024), (1000, 2999), (2990, 3000), (3000, 3000)):
        assert s.ids(a, b).tolist() == ids[a:b].tolist()
    assert s.document(9).tolist() == ids[1500:].tolist()
    small = tokens.Shard(tokens.pack(np.array([1, 2], np.uint32), np.array([1]), np.array([0])))
    assert len(small.sizes) == 1 and small.ids().tolist() == [1, 2]
    full = np.full(1024, 300, np.uint32)
    assert tokens.Shard(tokens.pack(full, np.array([1]), np.array([0]))).ids(512).tolist() == full[512:].tolist()


def test_many_small_shards(spark, small):
    whole = {tuple(r) for r in tokens.write_and_read(small).collect()}
    root = scratch(spark, "shards")
    tokens.write(small, root, shard_ids=500, partitions=7)
    assert {tuple(r) for r in tokens.read(spark, root).collect()} == whole
    t = Tokenizer.from_file(tokens.tokenizer_path())
    for r in small.limit(5).collect():
        assert tokens.document(spark, root, r.doc_id).tolist() == [*t.encode(r.text, add_special_tokens=False).ids, 2]
    with pytest.raises(KeyError):
        tokens.document(spark, root, -5)


def test_files_are_addressed_directly(spark, small):
    """Single ids and stretches from an open file, with no more bytes read than they need."""
    root = scratch(spark, "shards")
    tokens.write(small, root, partitions=3)

    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def read_at(self, size, at):
            self.n += size
            return self.file.read_at(size, at)

    for row in tokens.index(spark, root).collect():
        with tokens.open_file(row.file) as f:
            counting = Counting(f)
            s, every = tokens.Shard(counting), tokens.Shard(memoryview(tokens.open_file(row.file).read_buffer())).ids()
            assert len(s) == row.n_ids == len(every)
            counting.n = 0
            for i in range(0, len(s), 997):
                assert s[i] == every[i]
            assert counting.n < 90 * (len(s) // 997 + 1)


def test_op10(spark, small):
    got = {r.doc_id: r for r in queries.op10_media(spark, SF).collect()}
    for r in small.collect():
        raw, g = r.text.encode(), got[r.doc_id]
        data = raw + b"\0" * (-len(raw) % 64)
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        assert g.media_bytes == len(media.wav_bytes(data)) and g.media_sha256 == hashlib.sha256(media.wav_bytes(data)).hexdigest()


def test_op10_features_by_plain_transforms(spark, small):
    """Peaks by Fourier sums written out in double precision, pairs by loops over frames and bands, for every whole text."""
    k = np.arange(media.FRAME)
    sums = np.exp(-2j * np.pi * np.outer(k, k[: media.FRAME // 2 + 1]) / media.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * k / (media.FRAME - 1))
    got = {r.doc_id: r.feature for r in queries.op10_media(spark, SF).collect()}
    for r in small.collect():
        raw = r.text.encode()
        data = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = list(data) + [128] * (media.FRAME - len(data) if len(data) < media.FRAME else -(len(data) - media.FRAME) % media.HOP)
        found = media.peaks(data).tolist()
        assert len(found) == (len(x) - media.FRAME) // media.HOP + 1
        for t, own in enumerate(found):
            frame = np.array(x[t * media.HOP : t * media.HOP + media.FRAME], float)
            power = abs((frame - frame.mean()) * hann @ sums) ** 2
            floor = power.mean() + 1e-3
            for band, best in enumerate(own):  # single precision may choose otherwise among values that hardly differ
                top = power[media.BANDS[band] : media.BANDS[band + 1]].max()
                assert best >= 0 or top <= floor * 1.001
                assert best < 0 or (media.BANDS[band] <= best < media.BANDS[band + 1] and power[best] >= 0.999 * top and power[best] >= 0.999 * floor)
        codes = []
        for t, own in enumerate(found):
            for lag in (0, 1):
                for band, a in enumerate(own):
                    b = found[t + lag][(band + 1) % len(own)] if t + lag < len(found) else -1
                    if a >= 0 and b >= 0:
                        codes.append(t << 32 | lag << 18 | a << 9 | b)
        assert got[r.doc_id] == hashlib.sha256(" ".join(map(str, sorted(codes))).encode()).hexdigest()


def test_peaks_find_a_tone():
    t = np.arange(8192)
    tone = (128 + 90 * np.sin(2 * np.pi * 64 * t / 512)).astype(np.uint8).tobytes()
    p = media.peaks(tone)
    assert (p[:, 2] == 64).all()
    assert len(media.pair_codes(b"\0" * 64)) == 0
    with wave.open(__import__("io").BytesIO(media.wav_bytes(tone))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, tone)


def test_last_samples_reach_the_pairs():
    rng = np.random.default_rng(3)
    for n in (576, 640, 704, 768, 832, 4096 + 64):
        quiet = rng.integers(120, 136, n).astype(np.uint8)
        loud = quiet.copy()
        loud[-64:] = np.where(np.arange(64) % 4 < 2, 0, 255)
        assert len(media.peaks(quiet.tobytes())) == 1 + -(-(n - media.FRAME) // media.HOP)
        assert not np.array_equal(media.pair_codes(quiet.tobytes()), media.pair_codes(loud.tobytes()))


def test_odd_tables(spark, odd, none):
    n = odd.count()
    for table, size in ((odd, n), (none, 0)):
        assert bpe.decode(bpe.encode(table)).count() == size
        assert tokens.write_and_read(table).count() == size
        assert media.fingerprint(media.to_wav(table)).count() == size
    empty = tokens.write_and_read(odd).where("doc_id = 4").first()
    assert empty.n_tokens == 1
    assert {len(r.ids) for r in bpe.encode(odd).where("doc_id in (3, 4)").collect()} == {0}
    assert {len(r.payload) for r in media.fingerprint(media.to_wav(odd)).where("doc_id in (3, 4)").collect()} == {64}
