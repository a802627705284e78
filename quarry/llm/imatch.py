"""Document fingerprints by I-Match, in DataFrame functions only.

Terms are lower-cased runs of letters and digits. The lexicon holds the terms in a band of inverse document frequency, counted
over all documents: a term in at least LEAST and at most MOST of them. Since a document has finitely many distinct terms, at
most (mean distinct terms) / LEAST terms lie above the lower bound whatever the corpus. It is kept as an array of SLOTS short lists of
terms' 64-bit hashes, in which a term is looked up by its slot and compared in full. SUBSETS randomised subsets of the lexicon keep a term with probability 1/4 to
1/512; the sorted distinct terms of a text in a subset are hashed into one part of its fingerprint (0: no such term).
Likeness is the share of equal parts among those where either text has terms.

Cases: null text is empty; a text without any lexicon term is fingerprinted by all its terms, one without terms by zeros, and
two of these have likeness 1; equal texts have equal fingerprints; rows with equal ids stay separate rows, in
the order of their texts' hashes; null ids sort lowest; long texts are taken whole; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import texts

LEAST, MOST = 0.005, 0.25
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
SUBSETS, RATES = 64, 8
NO_ID = -(1 << 63)
#: Bytes of text in a range of ids; beyond RANGES of them ranges grow instead (a task sorts its range and spills), so that what the driver holds and
#: what is broadcast are at most so many rows.
RANGE_BYTES = 16 << 20
RANGES = 20_000


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often it is used; plain columns would be computed anew at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


def _slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - SLOT_BITS)


def lexicon(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: slots, an array of SLOTS arrays with the hashes of the band's terms."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2, LEAST * n)) & (F.col("df") <= max(2, MOST * n))).select("term", _slot(F.col("term")).alias("id"))
    words = band.groupBy("id").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # bounded by the band
    every = docs.sparkSession.range(SLOTS).join(words, "id", "left")  # as many rows whatever the corpus
    return every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")))).getField("terms").alias("slots"))


def in_lexicon(found: Column, slots: Column) -> Column:
    """The sorted terms of the lexicon, or all where there is none."""
    holds = lambda t: F.array_contains(F.get(slots, _slot(t).cast("int")), t)
    return F.sort_array(let(found, lambda every: let(F.filter(every, holds), lambda known: F.when(F.size(known) > 0, known).otherwise(every))))


def parts(known: Column) -> Column:
    """A hash for each lexicon subset, 0 where the text has no term in it."""

    # A seed's subsets lie in one that keeps a quarter of the terms; each takes further bits of its own from the hash.
    masks = F.array(*[F.lit(((1 << rate) - 1) << 2 + rate * (rate - 1) // 2).cast("long") for rate in range(RATES)])
    seeds = F.sequence(F.lit(1), F.lit(SUBSETS // RATES))

    def part(own: Column, mask: Column) -> Column:
        found = F.filter(own, lambda h: h.bitwiseAND(mask) == 0)
        return let(found, lambda f: F.when(F.size(f) == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(f)))

    def of_seed(every: Column, seed: Column) -> Column:
        quarter = F.filter(F.transform(every, lambda t: F.xxhash64(t, seed)), lambda h: h.bitwiseAND(F.lit(3)) == 0)
        return let(quarter, lambda own: F.transform(masks, lambda mask: part(own, mask)))

    return let(known, lambda every: F.flatten(F.transform(seeds, lambda seed: of_seed(every, seed))))


def likeness(a: Column, b: Column) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    return let(F.filter(both, lambda x: x.isNotNull()), lambda said: F.when(F.size(said) == 0, F.lit(1.0)).otherwise(F.aggregate(said, F.lit(0), lambda s, x: s + x) / F.size(said)))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda p: F.lpad(F.lower(F.hex(p)), 16, "0")), "")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, bucket, donor and next_text, the text of the next document in descending doc_id (after the last: the first).

    Documents are dealt by ranges of ids, as many as the table's bytes call for and RANGES at most; the last of each range gets a copy of the next range's first
    (a donor), so no window spans more than a range.
    """
    spark = docs.sparkSession
    docs = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = min(RANGES, max(8, -(-n_bytes // RANGE_BYTES)))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / count for i in range(1, count)], max(20_000, 10 * count)).alias("b")).first().b or []
    dealt = _range_of(F.col("doc_id"), sorted(set(bounds)))
    rows = docs.withColumn("bucket", dealt)
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()  # a row for each range
    gives = [(r.top, tops[(i + 1) % len(tops)].bucket) for i, r in enumerate(tops)]  # to the range above; the highest to the lowest
    donors = docs.join(F.broadcast(spark.createDataFrame(gives, "doc_id long, bucket int")), "doc_id")
    both = rows.withColumn("donor", F.lit(False)).unionByName(donors.withColumn("donor", F.lit(True)))
    return both.withColumn("next_text", F.lead("text").over(_order())).withColumn("n_chars", F.char_length("text").cast("long"))


def _range_of(value: Column, edges: list[int]) -> Column:
    """How many of the ascending edges are at most value: first among every so many, then within that stretch."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    heads, rows = edges[step::step], [edges[i : i + step] for i in range(0, len(edges), step)]
    literal = lambda x, kind: F.from_json(F.lit(str(x)), kind)
    below = lambda e: F.size(F.filter(e, lambda b: b <= value))
    return let(below(literal(heads, "array<bigint>")), lambda row: row * step + below(F.get(literal(rows, "array<array<bigint>>"), row)))


def _order():
    return Window.partitionBy("bucket").orderBy("donor", F.col("doc_id").desc(), F.xxhash64("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document and its edited text."""
    base = texts(docs, id_col, text_col)
    # the lexicon is bounded for any corpus; as a constant it is held once a task, not copied by row
    slots = F.from_json(F.lit(str(lexicon(base).first().slots)), "array<array<bigint>>")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), F.coalesce(F.substring("next_text", F.lit(1), half), F.lit("")))
    rows = with_next(base).withColumn("edited", edited)
    rows = rows.select("bucket", "donor", "doc_id", F.xxhash64("text").alias("text"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), in_lexicon(terms(F.col("text")), slots).alias("own"), in_lexicon(terms(F.col("edited")), slots).alias("other"))
    rows = rows.select("bucket", "donor", "doc_id", "text", "n_chars", "edited_sha256", parts(F.col("own")).alias("own"), parts(F.col("other")).alias("other"))
    rows = rows.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("donor", F.col("doc_id").desc(), "text"))).where("not donor")
    return rows.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.coalesce("next", "own")).alias("near_next"))
