"""Byte-level BPE encoding and decoding in linear time.

Tokens' bytes are mapped to Latin-1 strings, so that an Aho-Corasick automaton's trie gives the longest token at a
position. The encoder walks left to right with longest matches; a token may follow another only if the merges of the two
joined would leave exactly these two (adjacent-token compatibility, memoised); where none may, it steps back and tries
the next shorter prefix token, and never visits a dead position twice. The result equals that of applying the
merges by rank.

Cases: null text is empty and has no ids; rows with equal ids stay separate rows; very long matches (a run
of letters or white space of any length) take linear time; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import buffers, map_batches, slices, texts
from quarry.llm.pieces import FIRST, PieceTable, ranges

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most entries of the memos, which are emptied beyond them.
MEMO, MATCHES = 400_000, 400_000
#: Texts are encoded so many bytes at once, and so many ids decoded.
BYTES_AT_ONCE, IDS_AT_ONCE = 1000 << 10, 1 << 18
#: A space, Latin letters, and marks that never join with either.
PLAIN = re.compile(r"( [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([.,;:!?]*)").fullmatch


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """ranks: bytes by token id, the ids in the order of the merges, single bytes first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        self.rank = ranks
        self.by_text = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.token = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.widest = max(self.length.values())
        self.trie = ahocorasick.Automaton()
        for t, i in self.by_text.items():
            self.trie.add_word(t, i)
        self.trie.make_automaton()
        self.memo: dict[tuple[int, int], bool] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int | None] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            self._learn(t, i)
        self.matches: dict[str, list[int]] = {}
        self.pieces = PieceTable(self._learn_pieces)
        self.size = np.zeros(max(self.token) + 1, np.int64)
        self.size[list(self.length)] = list(self.length.values())
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.token[i] for i in sorted(self.token)), np.uint8)

    def _learn(self, t: bytes, i: int) -> None:
        """The longest proper prefix token of t, and the two tokens whose merge makes it (itself twice if none does)."""
        self.shorter[i] = next((self.rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.rank), None)
        self.parts[i] = (i, i)
        for k in range(len(t) - 1, 0, -1):
            left, right = self.rank.get(t[:k]), self.rank.get(t[k:])
            if left is not None and right is not None and left < i and right < i and self.compatible(left, right):
                self.parts[i] = (left, right)
                self.joined[left, right] = i
                break
        self.memo.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a and b joined ends in exactly a and b."""
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of either side from the last one on; no merge across the border may come before one undone.
        before = 1 << 62
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if a > b and inner_a != a or inner_b == b:
                if inner_a == a:
                    return True
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b

    def encode_word(self, match: str) -> list[int]:
        """Ids of one match of the pattern."""
        text = match if match.isascii() else match.encode().decode("latin-1")
        ids, memo, compatible = self.by_text, self.memo, self.compatible
        if (whole := ids.get(text)) is not None:
            return [whole]
        # Longest matches one after another, as far as each may follow the one before; all of it for about every second word.
        out = [token for _, token in self.trie.iter_long(text)]
        last = out[0]
        for i in range(1, len(out)):
            token = out[i]
            if not ((known := memo.get((last, token))) or known is None and compatible(last, token)):
                break
            last = token
        else:
            return out
        path, length, shorter, widest = self.trie.longest_prefix, self.length, self.shorter, self.widest
        end, dead = len(text), set()
        del out[i:]
        at = sum(map(length.__getitem__, out))
        token = shorter[token]
        while True:
            while token is None:  # nothing fits here: step back and shorten the token before
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
            last = out[-1] if out else -1
            stop = at + length[token]
            if stop in dead or last >= 0 and not ((known := memo.get((last, token))) or known is None and compatible(last, token)):
                token = shorter[token]
                continue
            out.append(token)
            if stop == end:
                return out
            at, ahead = stop, text[stop : stop + widest]
            stop = path(ahead)
            while (token := ids.get(ahead[:stop])) is None:  # the trie's path may end inside a longer token
                stop -= 1

    def _match(self, match: str) -> list[int]:
        ids = self.matches.get(match)
        if ids is None:
            if len(self.matches) >= MATCHES:
                self.matches.clear()
            ids = self.matches[match] = self.encode_word(match)
        return ids

    def encode_matches(self, text: str) -> list[int]:
        """Ids of each match of the pattern in turn."""
        if plain := PLAIN(text):  # one match, and another of the marks after it
            word, marks = plain.groups()
            return self._match(word) + self._match(marks) if marks else self._match(word)
        return list(chain.from_iterable(map(self._match, self.pattern.findall(text))))

    def _learn_pieces(self, new: list[str]) -> tuple[list[int], list[int], range]:
        found = [self.encode_matches(x[1:] if x.startswith(FIRST) else " " + x) for x in new]
        return list(chain.from_iterable(found)), [len(x) for x in found], range(len(new))

    def encode(self, text: str) -> list[int]:
        return self.pieces.encode_texts([text])[0].tolist()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        return self.bytes[ranges(self.begin[ids], self.size[ids])]


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each Python worker and vocabulary file."""
    import public_tokenizers

    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: every whole text in token ids."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch):
        c = codec(path)
        data, offsets = buffers(batch.column(1))
        for i, j in slices(offsets, BYTES_AT_ONCE):
            ids, at = c.pieces.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return map_batches(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded binary: the bytes of the ids."""
    path = path or vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        sets = batch.column(1)
        ids, at = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
        data = b"".join(c.decode(ids[i : i + IDS_AT_ONCE]).tobytes() for i in range(0, len(ids), IDS_AT_ONCE))
        ends = np.concatenate([[0], np.cumsum(c.size[ids])])[at].astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(sets), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([batch.column(0), sets, data], ["doc_id", "ids", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")
