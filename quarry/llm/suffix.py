"""Suffix-array deduplication: bytes covered by a 100-byte string that also starts earlier are removed.

Every whole text is UTF-8 bytes; strings never cross documents; "earlier" is a smaller doc_id, or the same document and a
smaller start. The work is done in three steps, each written to the shared folder.

1. Candidates. Of a string's 69 32-byte grams, the one with the smallest hash (leftmost of equals) is its anchor, so equal strings have equal
   anchors at equal offsets. The strings that one anchor serves start side by side; the stretch they cover is its context. Rows of
   (anchor, hash of the context, place) are sorted: every context but the first of equal ones is covered as a whole, and an anchor with a
   single context has no repeated string. What is left are first occurrences of different contexts around one anchor. Contexts of one anchor
   are told apart by 128 bits of BLAKE2b under a key that is drawn for each run, so no text can be made that is taken for another.
2. Suffix arrays. Those contexts are cut into slices of neighbouring strings, dealt by the bytes that all strings of a slice share,
   so equal strings meet in one group; anchors of more than HOT contexts get narrower slices, which share more bytes, so that a
   passage in very many texts is dealt by what stands around it. Of equal slices in a batch only the first is dealt. A group's suffixes are sorted by the difference-cover algorithm:
   sampled triples (positions not divisible by three) are sorted and named, names are sorted by recursion until
   they tell 100 bytes apart, the remaining suffixes are sorted by a character and a sampled rank, and merged. Adjacent
   suffixes whose first 100 bytes are equal form a run; all of a run but its earliest are repeats. That sort is local to a task. A
   group that is still above GROUP_BYTES is read in the order of its places and only hashes of its strings are kept: two polynomials modulo
   2 ** 61 - 1 at secret points, under which any two different strings are equal with probability (100 / 2 ** 61) ** 2, 2 ** -108.
3. The intervals of both steps are gathered by document and cut out.

The characters of the suffix sort are 8-byte words; a text's words at each of the eight phases follow one another, so a
suffix of words is a suffix of bytes.

Cases: null text is empty; texts under 100 bytes are never cut; equal texts keep the first document's whole; rows with equal ids and equal
texts are one document and get one result, those with equal ids and different texts are ordered by a hash of the text; null ids
come first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import buffers, map_batches, release, slices, texts, written
from quarry.llm.pieces import ranges
from quarry.llm.words import BYTE, digests, mix, unaligned

STRING, GRAM = 100, 32
#: Anchors are found in pieces of at most so many bytes, whose positions fit the low bits of a key.
PLACE_BITS = 20
PIECE = (1 << PLACE_BITS) - 4 * STRING
#: Strings of one slice have offsets to their anchor in a range of this width.
SLICE, SLICES_AT_ONCE = 35, 1 << 14
#: Anchors of more than so many contexts, and the width of their slices.
HOT, NARROW = 512, 12
#: Groups are sorted together up to so many bytes; above GROUP_BYTES a group's strings are told apart by hashes alone.
SORT_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
NO_ID = -(1 << 63)
_U = np.uint64
_GRAMS = STRING - GRAM + 1


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` (a power of two) bytes from each position on."""
    h, power, step = BYTE[data], 0x9E3779B97F4A7C15, 1
    while step < width:
        h = h[:-step] * _U(power) + h[step:]
        power = power * power % (1 << 64)
        step *= 2
    return mix(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor's place for each start of a string, and the hashes of all grams; data: at most 2 ** PLACE_BITS bytes."""
    gram = rolling(data, GRAM)
    low = _U((1 << PLACE_BITS) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= _GRAMS:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if rest := _GRAMS - span:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & low).astype(np.int64), gram


PRIME = (1 << 61) - 1


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, for numbers below it."""
    low, b1, b0 = _U((1 << 32) - 1), _U(b >> 32), _U(b & (1 << 32) - 1)
    a1, a0 = a >> _U(32), a & low
    middle, small = a1 * b0 + a0 * b1, a0 * b0
    s = (a1 * b1 << _U(3)) + (middle >> _U(29)) + ((middle & _U((1 << 29) - 1)) << _U(32)) + (small & _U(PRIME)) + (small >> _U(61))
    return _reduced(s)


def _reduced(s: np.ndarray) -> np.ndarray:
    s = (s & _U(PRIME)) + (s >> _U(61))
    return np.where(s >= _U(PRIME), s - _U(PRIME), s)


def windows(data: np.ndarray, width: int, point: int) -> np.ndarray:
    """The polynomial of the `width` bytes from each position on, at `point`, modulo PRIME."""
    n = len(data) - width + 1
    h, size, out, done = data.astype(np.uint64) + _U(1), 1, None, width  # h: polynomials of `size` bytes
    while True:
        if width & size:  # the last bytes of the window that are still to come
            done -= size
            part = h[done : done + n]
            out = part if out is None else _reduced(_times(part, pow(point, width - done - size, PRIME)) + out)
        if 2 * size > width:
            return out
        h = _reduced(_times(h[:-size], pow(point, size, PRIME)) + h[size:])
        size *= 2


def contexts(data: np.ndarray, offsets: np.ndarray, key: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor's hash, context's digest in two columns, first start, last start, anchor's place) arrays; places are within the row."""
    cuts = []  # (row, start in row, begin, end in data): pieces that share STRING - 1 bytes with the next one
    for row in np.flatnonzero(np.diff(offsets) >= STRING).tolist():
        a, b = int(offsets[row]), int(offsets[row + 1])
        for at in range(a, b - STRING + 1, PIECE - STRING + 1):
            cuts.append((row, at - a, at, min(b, at + PIECE)))
    i = 0
    while i < len(cuts):
        j, size = i, 0
        while j < len(cuts) and (j == i or size + cuts[j][3] - cuts[j][2] <= PIECE):
            size += cuts[j][3] - cuts[j][2]
            j += 1
        part = cuts[i:j]
        length = np.array([e - b for _, _, b, e in part])
        first = np.cumsum(length) - length
        block = np.concatenate([data[b:e] for _, _, b, e in part])
        place, gram = anchors(block)
        piece = np.repeat(np.arange(len(part)), length)[: len(place)]
        start = np.arange(len(place))
        inside = start + STRING <= (first + length)[piece]
        start, place, piece = start[inside], place[inside], piece[inside]
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
        at = np.flatnonzero(new)
        lo, p, own = start[at], place[at], piece[at]
        hi = np.append(start[at[1:] - 1], start[-1])
        view = memoryview(block)
        value = digests([view[x:y] for x, y in zip(lo.tolist(), (hi + STRING).tolist(), strict=True)], key) ^ np.stack([p - lo, p - lo], axis=1).astype(np.uint64)
        base = np.array([s for _, s, _, _ in part])[own] - first[own]
        yield np.array([r for r, _, _, _ in part])[own], gram[p], value, lo + base, hi + base, p + base
        i = j


def _pack(lo: np.ndarray, hi: np.ndarray, p: np.ndarray) -> np.ndarray:
    return lo << 16 | (hi - lo) << 8 | (p - lo)


def _unpack(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = code >> 16
    return lo, lo + (code >> 8 & 255), lo + (code & 255)


#: What a context is: covered as a whole, or one of several, or of more than HOT, around its anchor; others have no row.
COVERED, RESIDUAL, CROWDED = 1, 2, 3
_CONTEXT = "anchor long, context long, context2 long, doc_id long, tie long, code long, done boolean"
_FOUND = "kind int, doc_id long, tie long, a long, b long"


def _find_contexts(key: bytes):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = buffers(batch.column(2))
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for i, j in slices(offsets, 4 << 20):
            for row, anchor, context, lo, hi, p in contexts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], key):
                doc, tie, code = ids[i:j][row], ties[i:j][row], _pack(lo, hi, p)
                one, two = np.ascontiguousarray(context.T).view(np.int64)
                order = np.lexsort((code, tie, doc, two, one, anchor))
                anchor, one, two, doc, tie, code = (x[order] for x in (anchor.view(np.int64), one, two, doc, tie, code))
                done = np.zeros(len(order), bool)  # equal to an earlier one of this block: covered already, dealt out anywhere
                done[1:] = (anchor[1:] == anchor[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                anchor = np.where(done, mix(code.astype(np.uint64) + doc.astype(np.uint64)).view(np.int64), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, one, two, doc, tie, code, done)], ["anchor", "context", "context2", "doc_id", "tie", "code", "done"])

    return run


def _found(kind: int, doc, tie, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (doc, tie, a, b))], ["kind", "doc_id", "tie", "a", "b"])


def _judge_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, context and place: what each context is (a row's a and b: an interval, or anchor and code)."""
    last, held, met = (None, None, None), None, 0  # of the last anchor: its distinct contexts if HOT at most, and their number
    told = lambda rows, kind: _found(kind, rows[1], rows[2], rows[0], rows[3])
    for batch in batches:
        if not batch.num_rows:
            continue
        done = batch.column(6).to_numpy(zero_copy_only=False)
        anchor, context, context2, doc, tie, code = (batch.column(k).to_numpy() for k in range(6))
        live = np.flatnonzero(~done)
        a, c, d = anchor[live], context[live], context2[live]
        same = np.zeros(len(live), bool)
        same[1:] = (a[1:] == a[:-1]) & (c[1:] == c[:-1]) & (d[1:] == d[:-1])
        if len(live):
            same[0] = last == (int(a[0]), int(c[0]), int(d[0]))
        covered = np.concatenate([np.flatnonzero(done), live[same]])
        lo, hi, _ = _unpack(code[covered])
        yield _found(COVERED, doc[covered], tie[covered], lo, hi + STRING)
        if not len(live):
            continue
        begins = np.ones(len(a), bool)
        begins[1:] = a[1:] != a[:-1]
        group = np.cumsum(begins) - 1
        count = np.bincount(group, ~same).astype(np.int64)
        rows = np.stack([x[live] for x in (anchor, doc, tie, code)])[:, ~same]
        of = group[~same]
        if last[0] == int(a[0]):
            count[0] += met
            if held is not None:
                rows, of = np.concatenate([held, rows], axis=1), np.concatenate([np.zeros(held.shape[1], np.int64), of])
        elif held is not None and met > 1:
            yield told(held, RESIDUAL)
        end = group[-1]
        open_end = (of == end) & (count[end] <= HOT)
        yield told(rows[:, (count[of] > 1) & (count[of] <= HOT) & ~open_end], RESIDUAL)
        yield told(rows[:, count[of] > HOT], CROWDED)
        held = rows[:, open_end] if count[end] <= HOT else None
        met, last = int(count[end]), (int(a[-1]), int(c[-1]), int(d[-1]))
    if held is not None and met > 1:
        yield told(held, RESIDUAL)


# ---- difference-cover suffix sorting


def _names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1 on, of rows of non-negative integers, compared column by column."""
    key, most = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for c in columns[1:]:
        width = int(c.max()) + 1
        if most * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            most = int(key.max()) + 1
        key, most = key * width + c, most * width
    return np.unique(key, return_inverse=True)[1] + 1


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position, the number of suffixes that are smaller; suffixes equal in their first `depth` characters may tie.

    text: integers from 1 on. Difference cover modulo 3.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.int64), np.zeros(6 - n % 3, np.int64)])
    m = n + 3 - n % 3  # a multiple of three, with at least one zero behind the text
    at1, at2, at0 = np.arange(1, m, 3), np.arange(2, m, 3), np.arange(0, m, 3)
    sample = np.concatenate([at1, at2])
    name = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if depth > 3 and name.max() < len(name):
        name = suffix_ranks(name, -(-depth // 3) + 1) + 1
    rank = np.zeros(m + 3, np.int64)
    rank[sample] = name
    top = int(name.max()) + 1
    count = np.bincount(name)
    before = np.cumsum(count) - count  # of each name: the sampled suffixes that are smaller
    # The others differ from a sampled suffix by one or two characters and a rank that both sides have.
    letters = int(padded.max()) + 1
    if letters * letters * top < 1 << 62:
        pair = padded[:m] * letters + padded[1 : m + 1]
    else:
        pair = np.zeros(m, np.int64)
        pair[np.concatenate([at0, at2])] = _names(padded[np.concatenate([at0, at2])], padded[np.concatenate([at0, at2]) + 1])
    out = np.zeros(m, np.int64)
    out[sample] = before[name]
    key0, key1 = padded[at0] * top + rank[at0 + 1], padded[at1] * top + rank[at1 + 1]
    by0, by1 = np.argsort(key0), np.argsort(key1)
    key0, key1 = key0[by0], key1[by1]
    out[at0[by0]] = np.searchsorted(key0, key0) + np.searchsorted(key1, key0)
    out[at1[by1]] += np.searchsorted(key0, key1)
    key0, key2 = pair[at0] * top + rank[at0 + 2], pair[at2] * top + rank[at2 + 2]
    by0, by2 = np.argsort(key0), np.argsort(key2)
    key0, key2 = key0[by0], key2[by2]
    out[at0[by0]] += np.searchsorted(key2, key0)
    out[at2[by2]] += np.searchsorted(key0, key2)
    return out[:n]


WORD = 8


def repeats(data: np.ndarray, start: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which of the STRING-byte strings at `start` equal one that comes before in `order` (keys, the weightiest first)."""
    size = len(data) + 2 * STRING
    size += -size % WORD
    block = np.zeros(size + WORD, np.uint8)
    block[: len(data)] = data
    words = np.lib.stride_tricks.as_strided(block, (size, WORD), (1, 1)).copy().view(">u8")[:, 0].astype(np.uint64)
    phased = words.reshape(-1, WORD).T.ravel()  # each phase's words one after another
    ranks = suffix_ranks(np.unique(phased, return_inverse=True)[1] + 1, -(-STRING // WORD))
    own = ranks.reshape(WORD, -1).T.ravel()[start]
    by = np.lexsort((*reversed(order), own))
    s = start[by]
    equal = np.ones(max(0, len(s) - 1), bool)
    for at in [*range(0, STRING - WORD, WORD), STRING - WORD]:  # adjacent prefixes, compared in full
        w = words[s + at]
        equal &= w[1:] == w[:-1]
    run = np.concatenate([[0], np.cumsum(~equal)]) if len(s) else np.zeros(0, np.int64)
    by = by[np.lexsort((*(k[by] for k in reversed(order)), run))]  # within a run suffixes may differ further on
    out = np.zeros(len(start), bool)
    out[by[1:]] = run[1:] == run[:-1]
    return out


def _cut_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A row for each slice of the documents' residual contexts; key: of the anchor, the offsets and the bytes that all strings of a slice share.

    Slices that equal an earlier one of the batch are covered: they have no bytes and are dealt out anywhere.
    """
    data, offsets = buffers(batch.column(2))
    sets = batch.column(3)
    flat = sets.flatten()
    at = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
    ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    row = np.repeat(np.arange(len(ids)), np.diff(at))
    anchor, code = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    width = np.where(flat.field(2).to_numpy(zero_copy_only=False), NARROW, SLICE)
    lo, hi, p = _unpack(code)
    first, last = (p - hi) // width, (p - lo) // width
    of = np.repeat(np.arange(len(lo)), last - first + 1)
    part = ranges(first, last - first + 1)
    middle = p[of] - part * width[of]
    begin, end = np.maximum(lo[of], middle - width[of] + 1), np.minimum(hi[of], middle)
    order = np.lexsort((begin, row[of]))
    of, part, middle, begin, end = (x[order] for x in (of, part, middle, begin, end))
    view, base = memoryview(data), offsets[row[of]]
    for i in range(0, len(of), SLICES_AT_ONCE):
        k = slice(i, i + SLICES_AT_ONCE)
        shared = (STRING + 1 - width[of[k]]).tolist()
        m = (base[k] + middle[k]).tolist()
        key = np.array([_digest(view[x : x + w], a + q) for x, w, a, q in zip(m, shared, anchor[of[k]].tolist(), part[k].tolist(), strict=True)], np.int64)
        own, strings = row[of[k]], end[k] - begin[k] + 1
        size = strings + STRING - 1
        again = np.zeros(len(own), bool)
        met, x = set(), (base[k] + begin[k]).tolist()
        for q in np.lexsort((begin[k], ties[own], ids[own])).tolist():  # by place; equal bytes around the same middle, and dealt alike
            slice_ = (key[q], middle[k][q] - begin[k][q], bytes(view[x[q] : x[q] + size[q]]))
            again[q] = slice_ in met
            met.add(slice_)
        key[again] = mix(key[again].view(np.uint64) + ids[own[again]].astype(np.uint64) + begin[k][again].astype(np.uint64)).view(np.int64)
        size = np.where(again, 0, size)
        bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        payload = data[ranges(base[k] + begin[k], size)]
        raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(payload.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[own]), pa.array(ties[own]), pa.array(begin[k]), pa.array(strings), raw], ["key", "doc_id", "tie", "start", "strings", "bytes"])


def _digest(shared: bytes, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shared, seed & (1 << 64) - 1) - (1 << 63)


def _intervals_of(part: pa.Table, again: np.ndarray, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch | None:
    """Repeated strings (of slices `row`, at `place`) as intervals; neighbours are joined."""
    at = np.flatnonzero(again)
    if not len(at):
        return None
    doc, tie = part["doc_id"].to_numpy(), part["tie"].to_numpy()
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    begin, end = at[first], at[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)]
    return _found(COVERED, doc[row[begin]], tie[row[begin]], place[begin], place[end] + STRING)


def _strings(part: pa.Table) -> tuple[np.ndarray, ...]:
    """The slices' bytes; by string: its slice, where it begins in the bytes, and in its text."""
    start, strings = part["start"].to_numpy(), part["strings"].to_numpy()
    data, offsets = buffers(part["bytes"])
    row = np.repeat(np.arange(part.num_rows), strings)
    within = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    return data, row, offsets[:-1][row] + within, start[row] + within


def _sorted_groups(part: pa.Table) -> pa.RecordBatch | None:
    """Repeats in whole groups, by a suffix array of all their bytes."""
    key = part["key"].to_numpy()
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[1:] != key[:-1]
    part = part.filter(pa.array(~alone)).combine_chunks()
    if not part.num_rows:
        return None
    data, row, at, place = _strings(part)
    return _intervals_of(part, repeats(data, at, (part["doc_id"].to_numpy()[row], part["tie"].to_numpy()[row], place)), row, place)


class _Streamed:
    """A group too large to sort, in the order of its places: the hashes of the strings met so far."""

    def __init__(self, points: tuple[int, int]):
        self.points, self.seen, self.held = points, np.zeros((2, 0), np.uint64), None

    def take(self, part: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """Slices of one document are judged together, so those of the last one wait for the next call."""
        part = part if self.held is None else pa.concat_tables([self.held, part]).combine_chunks()
        cut = part.num_rows
        if not last and cut:
            doc, tie = part["doc_id"].to_numpy(), part["tie"].to_numpy()
            cut = int(np.flatnonzero((doc != doc[-1]) | (tie != tie[-1]))[-1:].sum() + 1) if ((doc != doc[-1]) | (tie != tie[-1])).any() else 0
        self.held, part = part.slice(cut), part.slice(0, cut).combine_chunks()
        if part.num_rows:
            data, row, at, place = _strings(part)
            h, other = (windows(data, STRING, x)[at] for x in self.points)
            by = np.lexsort((place, part["tie"].to_numpy()[row], part["doc_id"].to_numpy()[row], other, h))
            h, other = h[by], other[by]
            again = np.zeros(len(h), bool)
            again[1:] = (h[1:] == h[:-1]) & (other[1:] == other[:-1])
            if self.seen.shape[1]:
                known = np.minimum(np.searchsorted(self.seen[0], h), self.seen.shape[1] - 1)
                again |= (self.seen[0][known] == h) & (self.seen[1][known] == other)
            out = np.zeros(len(h), bool)
            out[by] = again
            new = np.concatenate([self.seen, np.stack([h[~again], other[~again]])], axis=1)
            self.seen = new[:, np.argsort(new[0], kind="stable")]
            if (found := _intervals_of(part, out, row, place)) is not None:
                yield found


def _sort_slices(batches: Iterator[pa.RecordBatch], points: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """From slices sorted by key, document and start: the intervals of repeated strings."""
    held: list[pa.RecordBatch] = []
    hot, hot_key = None, None

    def groups(table: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        """Judges all groups, or all but the last one, which may go on and is left in `held`."""
        nonlocal held
        key = table["key"].to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        stop = len(key) if whole else int(cut[-1]) if len(cut) else 0
        cut = np.append(cut, len(key))
        _, lengths = buffers(table["bytes"])
        i = 0
        while i < stop:
            k = int(np.searchsorted(cut, np.searchsorted(lengths, lengths[i] + SORT_BYTES, "right"), "left"))
            j = int(cut[min(k, len(cut) - 1)])
            j = min(j, stop) if j > i else int(cut[np.searchsorted(cut, i, "right")])
            if lengths[j] - lengths[i] > 2 * SORT_BYTES:  # ends with a large group: the others first
                before = cut[(cut > i) & (cut < j)]
                j = int(before[-1]) if len(before) else j
            if lengths[j] - lengths[i] > GROUP_BYTES:
                yield from _Streamed(points).take(table.slice(i, j - i), True)
            elif (out := _sorted_groups(table.slice(i, j - i))) is not None:
                yield out
            i = j
        held = table.slice(stop).combine_chunks().to_batches()

    for batch in batches:
        sizes = np.diff(buffers(batch.column(5))[1])
        if (done := np.flatnonzero(sizes == 0)).size:
            doc, tie, start, strings = (batch.column(k).to_numpy()[done] for k in (1, 2, 3, 4))
            yield _found(COVERED, doc, tie, start, start + strings - 1 + STRING)
            batch = batch.filter(pa.array(sizes > 0))
        if hot is not None and batch.num_rows:
            n = int(np.searchsorted(batch.column(0).to_numpy() != hot_key, True))
            yield from hot.take(pa.Table.from_batches([batch.slice(0, n)]), n < batch.num_rows)
            batch = batch.slice(n)
            hot = hot if not batch.num_rows else None
        if not batch.num_rows:
            continue
        held.append(batch)
        size = sum(b.nbytes for b in held)
        if size < SORT_BYTES:
            continue
        yield from groups(pa.Table.from_batches(held), False)
        if sum(b.nbytes for b in held) > GROUP_BYTES:  # one group, which goes on
            hot, hot_key = _Streamed(points), held[0].column(0)[0].as_py()
            yield from hot.take(pa.Table.from_batches(held), False)
            held = []
    if hot is not None:
        yield from hot.take(pa.Table.from_batches([], schema=hot.held.schema), True)
    if held:
        yield from groups(pa.Table.from_batches(held), True)


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of intervals doc_id, tie, a, b (bytes a to b are covered), for documents doc_id, tie, text."""
    spark = docs.sparkSession
    key, points = os.urandom(16), (2 + secrets.randbelow(PRIME - 2), 2 + secrets.randbelow(PRIME - 2))
    found = map_batches(docs, _find_contexts(key), _CONTEXT)
    judged = written(found.repartition("anchor").sortWithinPartitions("anchor", "context", "context2", "doc_id", "tie", "code").mapInArrow(_judge_contexts, _FOUND), "contexts")
    release(spark)
    residual = judged.where(F.col("kind") != COVERED).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "b", (F.col("kind") == CROWDED).alias("hot"))).alias("contexts"))
    cut = map_batches(docs.join(residual, ["doc_id", "tie"]).select("doc_id", "tie", "text", "contexts"), _cut_slices, "key long, doc_id long, tie long, start long, strings long, bytes binary")
    again = written(cut.repartition("key").sortWithinPartitions("key", "doc_id", "tie", "start").mapInArrow(lambda batches: _sort_slices(batches, points), _FOUND), "repeats")
    release(spark)
    return judged.where(F.col("kind") == COVERED).select("doc_id", "tie", "a", "b"), again.select("doc_id", "tie", "a", "b")


def _tie(docs: DataFrame) -> Column:
    """Tells documents of one id apart; a constant where ids don't repeat."""
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return F.xxhash64("text") if repeated else F.lit(0).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    return rows.select("doc_id", _tie(rows).alias("tie"), "text")


def spans(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A flag for each byte of a text of this size that an interval covers."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, begin, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0


def _intervals(docs: DataFrame) -> DataFrame:
    first, second = covered(docs)
    return first.union(second).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))


def _flags(text: pa.Array, cuts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By row: the bytes, and which of them are covered."""
    data, offsets = buffers(text)
    flat = cuts.flatten()
    a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    at = np.concatenate([[0], np.cumsum(cuts.value_lengths().fill_null(0).to_numpy())])
    for r in range(len(text)):
        own = data[offsets[r] : offsets[r + 1]]
        yield own, spans(len(own), a[at[r] : at[r + 1]], b[at[r] : at[r + 1]])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left) of every row."""
    rows = _keyed(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(len(own), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), own[~gone].tobytes()) for own, gone in _flags(batch.column(1), batch.column(2))]
        size, removed, runs, kept = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(_intervals(rows), ["doc_id", "tie"], "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "cuts")
    return map_batches(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated strings cut out of the text (and what is left of a code point that was cut); all columns and rows stay."""
    names = docs.columns
    marks = F.struct(*[F.col(c) for c in names]).alias("row")
    rows = docs.select(marks, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", _tie(rows).alias("tie"))
    joined = rows.join(_intervals(_keyed(docs, id_col, text_col)), ["doc_id", "tie"], "left").select("row", "cuts")
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.column(0).flatten()
        left = [own[~gone].tobytes().decode("utf-8", "ignore") for own, gone in _flags(columns[at], batch.column(1))]
        columns[at] = pa.array(left, pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(joined, run, docs.schema)
