"""Vectorised word hashing over blocks of concatenated UTF-8 texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

from quarry.llm.common import slices

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A 64-bit number for each byte value, from a fixed seed.
BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
#: Keeps the lowest k bytes of a number.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer stretches are hashed one by one.
LONG = 192


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of polynomial hashes."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def unaligned(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on (zeros behind its end) as a number."""
    return np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))


def stretches(data: np.ndarray, eights: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; eights: unaligned(data).

    Eight bytes at a time go through mix(), which is one to one, so stretches of at most eight bytes and one length never collide. Longer ones
    that do can be made, as there is no secret; where equality is judged by hashes, digests() with a key of the run's own are used.
    """
    n = end - start
    h = n.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    own = np.flatnonzero((n > 0) & (n <= LONG))
    k = 0
    while len(own):
        left = n[own] - k
        h[own] = mix((h[own] ^ (eights[start[own] + k] & LOW[np.minimum(left, 8)])) * _U(BASE) + _U(k))
        k += 8
        own = own[left > 8]
    if len(far := np.flatnonzero(n > LONG)):
        import xxhash

        view = memoryview(np.ascontiguousarray(data))
        h[far] = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start[far].tolist(), end[far].tolist(), strict=True)], np.uint64)
    return h


def digests(stretches: Sequence[bytes | memoryview], key: bytes) -> np.ndarray:
    """128 bits (two uint64) of each, by BLAKE2b with a secret key: nobody without the key can make two that are equal."""
    make = hashlib.blake2b
    return np.frombuffer(b"".join([make(x, digest_size=16, key=key).digest() for x in stretches]), np.uint64).reshape(-1, 2)


class Words:
    """start, end and row of each word of a block, and hashes of stretches of its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        own = is_word[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        prev = np.zeros(n, bool)
        prev[1:] = own[:-1]
        begins = own & (~prev | first[:n])
        after = np.ones(n, bool)
        after[: n - 1] = ~own[1:] | first[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(own & after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.eights = unaligned(self.data)
        self.own = own

    def digests(self, key: bytes) -> np.ndarray:
        """digests() of all words; equal ones are hashed once."""
        import pyarrow as pa

        bounds = np.zeros(len(self.start) + 1, np.int32)
        np.cumsum(self.end - self.start, out=bounds[1:])
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(self.start), [None, pa.py_buffer(bounds), pa.py_buffer(self.data[self.own])]).dictionary_encode()
        return digests(coded.dictionary.to_pylist(), key)[coded.indices.to_numpy()]

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return stretches(self.data, self.eights, start, end)


def blocks(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Words of rows [i, j), about a million bytes at a time."""
    for i, j in slices(offsets, BLOCK_BYTES):
        a, b = offsets[i], offsets[j]
        yield i, j, Words(data[a:b], offsets[i : j + 1] - a, is_word, lower)
