"""Cutting texts where byte-level BPE can never merge across, so that equal pieces are encoded once."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

from quarry.llm.words import LONG, LOW, stretches, unaligned

#: Stands before a text's first piece, which has no space before it; no other piece starts with white space.
FIRST = "\n"
_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
#: First bytes of characters of two and of three bytes among which there is white space.
_LEADS_2, _LEADS_3 = np.zeros(256, bool), np.zeros(256, bool)
_LEADS_2[0xC2] = True
_LEADS_3[[0xE1, 0xE2, 0xE3]] = True
_SALT = np.uint64(0x5851F42D4C957F2D)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + length[i] - 1 for each i in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the pieces of UTF-8 texts: cut at each single space that certainly has no white space on either side.

    Such a space always starts a match of the pre-tokenising pattern, and belongs to the piece after it.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[~edge[at] & ~edge[at + 1]]
    before, after = data[at - 1], data[at + 1]
    clear = ~(_WHITE[before] | _WHITE[after] | _LEADS_2[after] | _LEADS_3[after] | _LEADS_2[data[np.maximum(at - 2, 0)]] | _LEADS_3[data[np.maximum(at - 3, 0)]])
    at = at[clear]
    full = np.diff(offsets) > 0
    start = np.sort(np.concatenate([offsets[:-1][full], at + 1]))
    return start, np.sort(np.concatenate([at, offsets[1:][full]])), edge[start]


class PieceTable:
    """Ids of the pieces met so far, in one flat array; pieces are found by 64-bit hashes and compared byte by byte.

    learn(pieces) gives their ids one after another, the lengths, and the order in which they come. The table starts anew beyond
    `most` pieces or `most_bytes` of them, so its memory is bounded.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[Iterable[int], Iterable[int], Iterable[int]]], most: int = 700_000, most_bytes: int = 32 << 20):
        self.learn, self.most, self.most_bytes = learn, most, most_bytes
        self._reset()

    def _reset(self) -> None:
        self.at: dict[int, int] = {}
        self.other: dict[bytes, int] = {}  # pieces whose hash another one has
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bytes, self.begin, self.size, self.first = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.known = unaligned(self.bytes)

    def _add(self, raw: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Learns these pieces of raw; their places in the table."""
        spans = list(zip(start.tolist(), end.tolist(), strict=True))
        ids, lengths, order = self.learn([(FIRST if f else "") + raw[a:b].decode() for (a, b), f in zip(spans, first.tolist(), strict=True)])
        ids, lengths, order = np.asarray(ids, np.int32), np.asarray(lengths, np.int64), np.asarray(order, np.int64)
        where = np.empty(len(order), np.int64)
        where[order] = len(self.start) + np.arange(len(order))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.flat = np.concatenate([self.flat, ids])
        start, size = start[order], (end - start)[order]
        self.begin = np.concatenate([self.begin, len(self.bytes) + np.cumsum(size) - size])
        self.size, self.first = np.concatenate([self.size, size]), np.concatenate([self.first, first[order]])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(raw, np.uint8)[ranges(start, size)]])
        self.known = unaligned(self.bytes)
        return where

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (and the last one's end)."""
        start, end, first = cuts(data, offsets)
        eights = unaligned(data)
        h = stretches(data, eights, start, end)
        h[first] ^= _SALT
        every, index, at = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) + len(self.other) > self.most or len(self.bytes) > self.most_bytes:
            self._reset()
        names = every.tolist()
        get = self.at.get
        where = np.array([get(x, -1) for x in names], np.int64)
        new = np.flatnonzero(where < 0)
        raw = data.tobytes()
        if len(new):
            i = index[new]
            where[new] = self._add(raw, start[i], end[i], first[i])
            self.at.update(zip(map(names.__getitem__, new.tolist()), where[new].tolist(), strict=True))
        own = where[at]
        for i in np.flatnonzero(~self._same(data, eights, start, end, first, own)).tolist():
            key = (b"\1" if first[i] else b"\0") + raw[start[i] : end[i]]
            if key not in self.other:
                self.other[key] = int(self._add(raw, start[i : i + 1], end[i : i + 1], first[i : i + 1])[0])
            own[i] = self.other[key]
        lengths = self.length[own]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        pieces_before = np.searchsorted(start, offsets, "left")
        return self.flat[ranges(self.start[own], lengths)], ends[pieces_before]

    def _same(self, data: np.ndarray, eights: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each piece is, byte by byte, the one at its place in the table."""
        size = end - start
        same = (self.size[own] == size) & (self.first[own] == first)
        begin = self.begin[own]
        live, k = np.flatnonzero(same & (size > 0)), 0
        while len(live) and k < LONG:
            left = size[live] - k
            differ = ((eights[start[live] + k] ^ self.known[begin[live] + k]) & LOW[np.minimum(left, 8)]) != 0
            same[live[differ]] = False
            k += 8
            live = live[(left > 8) & ~differ]
        for i in live.tolist():
            same[i] = np.array_equal(data[start[i] : end[i]], self.bytes[begin[i] : begin[i] + size[i]])
        return same

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [x.encode() for x in texts]
        return self.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
