"""Phrase collocations: frequent word sequences by language that hold together better than their parts.

Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends, and pieces into words at spaces and tabs.

1. Counts. Rows (lang, n, phrase, f) of all phrases of 1 to max_n words within pieces, already summed within a block of texts, are
   hash-aggregated by language. All phrases of all lengths at once would be several times the table. Since a phrase is at
   most as frequent as its parts, a pass over the texts counts words, a second one pairs of frequent words, and further ones two lengths each,
   from phrases that may be frequent. Which are is told by a bitmap of the hashes of the frequent phrases one shorter: 16 bits for each, up
   to MOST_BITS (32 MB) in all, so what is broadcast is bounded. A bit that is set by chance lets a phrase be counted that turns out to be
   rare; none that is frequent is left out, and counts are by the phrase itself, so the result is exact whatever the bitmap holds.
2. Scores. A candidate of a occurrences is joined to the counts l and r of its parts at each cut; 2000000 * a / (l + r), rounded down, in
   Decimal(38); the lowest cut counts, the first one among equals.
3. A candidate goes if a phrase longer by one word that contains it has at least 80 % of its occurrences. Phrases longer by more need no look: one
   of the length between has as many occurrences or more.
4. A window ranks the candidates of each language; tasks hand on no more than `most` rows of a language.

Cases: null and empty texts have no words; a null language is "und"; repeated rows and rows of equal ids all count; long texts are
taken whole; ties go to the higher count, then to the smaller phrase in byte order; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import _lean, buffers, release, slices, small_batches, written
from quarry.llm.words import Words, mix, stretches, unaligned

MAX_WORDS, LEAST, MOST = 4, 30, 2_000
SCALE, SWALLOWED = 2_000_000, (80, 100)
#: Texts are counted in blocks of so many bytes; the bitmaps of frequent phrases have at most so many bits.
BLOCK_BYTES, MOST_BITS = 8 << 20, 1 << 28
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
IS_WORD = ~ENDS
IS_WORD[[9, 32]] = False
_ROWS = "lang string, n int, phrase string, f long"


class Bits:
    """A bitmap over the highest bits of 64-bit hashes."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, _U(64 - (len(words) * 64).bit_length() + 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)


def _hashes(strings: pa.Array) -> np.ndarray:
    data, offsets = buffers(strings)
    return mix(stretches(data, unaligned(data), offsets[:-1], offsets[1:]))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(h * _STEP + word)


def _dictionary(w: Words) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the words by number."""
    payload = w.data[IS_WORD[w.data]]
    offsets = np.zeros(len(w.start) + 1, np.int32)
    np.cumsum(w.end - w.start, out=offsets[1:])
    coded = pa.StringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(payload)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _numbered(key: np.ndarray, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys: a place of each, the number of the key at each place, and counts; keys below `most`, if given, without sorting."""
    if most:
        count = np.bincount(key, minlength=most)
        found = np.flatnonzero(count)
        number = np.zeros(most, np.int64)
        number[found] = np.arange(len(found))
        place = np.zeros(most, np.int64)
        place[key] = np.arange(len(key))
        return place[found], number[key], count[found]
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    begins = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[begins], number, np.diff(np.append(begins, len(key)))


def count_block(lang: pa.Array, data: np.ndarray, offsets: np.ndarray, lengths: range, frequent: dict[int, Bits]) -> Iterator[pa.RecordBatch]:
    """Rows of the block's phrases of these lengths, of which parts one shorter may be frequent where `frequent` has a bitmap of that length.

    With length 1 also a row by language of n 0 and the phrase "": all words.
    """
    w = Words(data, offsets, IS_WORD)
    if not len(w.start):
        return
    langs = lang.dictionary_encode()
    names = langs.dictionary
    word, spelt = _dictionary(w)
    piece = np.cumsum(ENDS[w.data], dtype=np.int32)[w.start] + w.row  # ascends from piece to piece and from text to text
    of_lang = langs.indices.to_numpy()[w.row].astype(np.int64)

    def rows(n: int, places: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        parts = [spelt.take(pa.array(word[places + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        return pa.RecordBatch.from_arrays([names.take(pa.array(of_lang[places])), pa.array(np.full(len(f), n, np.int32)), phrase, pa.array(f)], ["lang", "n", "phrase", "f"])

    first, number, f = _numbered(of_lang * len(spelt) + word, len(names) * len(spelt))
    if 1 in lengths:
        yield rows(1, first, f)
        total = np.bincount(of_lang, minlength=len(names))
        yield pa.RecordBatch.from_arrays([names, pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(total)], ["lang", "n", "phrase", "f"])
    distinct, one = len(first), number  # one: each word, with its language, as a number
    of_word = mix(_hashes(spelt)[word[first]] + _hashes(names)[of_lang[first]])
    h = of_word
    places = np.arange(len(word))
    for n in range(2, max(lengths) + 1):
        # the phrases of n - 1 words at `places` are numbered; those that may be frequent, at neighbouring places of a piece, make one of n
        kept = frequent[n - 1].has(h)[number] if n - 1 in frequent else np.ones(len(places), bool)
        places, number = places[kept], number[kept]
        if len(places) < 2:
            return
        follows = np.flatnonzero((places[1:] == places[:-1] + 1) & (piece[np.minimum(places[1:] + n - 2, len(piece) - 1)] == piece[places[:-1]]))
        places, number = places[follows], number[follows]
        if not len(places):
            return
        last = one[places + n - 1]
        first, new, f = _numbered(number * distinct + last)
        h = _longer(h[number[first]], of_word[last[first]])
        number = new
        if n in lengths:
            yield rows(n, places[first], f)


def _frequent_bits(table: DataFrame, n: int, count: int) -> Bits:
    """The bitmap of the phrases of n words in table, of which there are `count`."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (16 * count - 1).bit_length()))
    shift = _U(64 - bits.bit_length() + 1)
    space = np.ones(256, bool)
    space[32] = False

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(1))
            w = Words(data, offsets, space, lower=False)
            each = mix(mix(w.hashes(w.start, w.end)) + np.repeat(_hashes(batch.column(0)), n)).reshape(-1, n)
            h = each[:, 0]
            for k in range(1, n):
                h = _longer(h, each[:, k])
            at = h >> shift
            yield pa.RecordBatch.from_arrays([pa.array((at >> _U(6)).astype(np.int64)), pa.array((_U(1) << (at & _U(63))).view(np.int64))], ["at", "bit"])

    found = table.where(F.col("n") == n).select("lang", "phrase").mapInArrow(places, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(bits // 64, _U)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(_U)
    return Bits(words)


def counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, n, phrase, f of all phrases of 1 to max_words words that occur at least `least` times; rows of n 0: all words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tables, frequent = [], {}
    for lengths in [range(1, 2), range(2, 3), *(range(n, min(n + 2, max_words + 1)) for n in range(3, max_words + 1, 2))]:
        if lengths[0] > max_words:
            break
        known = spark.sparkContext.broadcast(frequent)  # bounded by MOST_BITS

        def run(batches: Iterator[pa.RecordBatch], lengths=lengths, known=known) -> Iterator[pa.RecordBatch]:
            _lean()

            def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table = pa.Table.from_batches(held).combine_chunks()
                data, offsets = buffers(table["text"])
                lang = table["lang"].combine_chunks()
                for i, j in slices(offsets, BLOCK_BYTES):
                    yield from count_block(lang.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths, known.value)

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size >= BLOCK_BYTES:
                    yield from told(held)
                    held, size = [], 0
            if held:
                yield from told(held)

        each = base.mapInArrow(run, _ROWS).groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f"))
        tables.append(written(each.where((F.col("f") >= least) | (F.col("n") == 0)), "phrases"))
        known.unpersist()
        release(spark)
        if lengths[-1] < max_words:
            sizes = dict(tables[-1].groupBy("n").count().collect())  # a row for each length
            frequent = frequent | {n: _frequent_bits(tables[-1], n, sizes[n]) for n in lengths if n in sizes}
            if lengths[-1] not in frequent:
                break
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def scored(table: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of each phrase of several words; table: counts()."""
    part = table.where("n > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    cuts = table.where("n > 1").select("lang", "phrase", F.col("n").alias("n_words"), F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("right"))
    both = cuts.join(part.toDF("lang", "left", "l"), ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(25,0)")
    exact = F.lit(SCALE).cast("decimal(7,0)") * whole("a")
    both = both.withColumn("total", whole("l") + whole("r")).withColumn("times", exact).withColumn("score", F.expr("times div total"))
    best = both.groupBy("lang", "phrase").agg(F.first("n_words").alias("n_words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "n_words", "a", "cut.l", "cut.r", "cut.score")


def without_swallowed(found: DataFrame) -> DataFrame:
    """found without the phrases of which a phrase longer by one word has nearly all occurrences."""
    part, whole = SWALLOWED
    words = F.split("phrase", " ")
    longer = found.where("n_words > 2").select("lang", F.col("a").alias("f"), F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("n_words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("n_words") - 1), " "))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    big = lambda c, k: F.lit(k).cast("decimal(3,0)") * F.col(c).cast("decimal(25,0)")
    swallowed = found.select("lang", "phrase", "a").join(most, ["lang", "phrase"]).where(big("f", whole) >= big("a", part))
    return found.join(swallowed.select("lang", "phrase"), ["lang", "phrase"], "left_anti")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, most: int = MOST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases."""
    spark = docs.sparkSession
    threshold = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(threshold, str(max(most, int(spark.conf.get(threshold, "1000")))))  # so that each task hands on `most` rows of a language
    table = counts(docs, max_words, least, lang_col, text_col)
    found = written(scored(table, max_words), "scored")
    of_lang = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = without_swallowed(found).withColumn("rank", F.row_number().over(of_lang)).where(F.col("rank") <= most)
    totals = table.where("n = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
