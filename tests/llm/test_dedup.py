"""Near-duplicates, repeated passages and I-Match against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import components, imatch, neardup, queries, suffix, words

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sets_of(docs):
    out = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(LOWER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(sets):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    have = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            have[s].append(i)
    for a, b in {(x, y) for v in have.values() for k, y in enumerate(v) for x in v[:k]}:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def family(seed=0, size=120):
    """Copies of one text with more and more edits: links and non-links around the threshold."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(100)]
    docs = [(0, " ".join(words))]
    for i in range(1, size):
        own = list(words)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(100)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    return docs


def test_op5_on_the_table(spark, small):
    sets = sets_of([(r.doc_id, r.text) for r in small.collect()])
    parts = brute_components(sets)
    got = {r.doc_id: r for r in queries.op5_minhash(spark, SF).collect()}
    assert all(tuple(got[i])[1:] == (len(sets[i]), parts[i], parts[i] == i) for i in sets)


@pytest.mark.parametrize("small_bucket", [16, 2])
def test_hot_family(spark, monkeypatch, small_bucket):
    """A group of near copies, with pairs and blockwise (several blocks) alike."""
    monkeypatch.setattr(neardup, "SMALL", small_bucket)
    monkeypatch.setattr(neardup, "BLOCK_ELEMENTS", 2_000)
    docs = family()
    parts = brute_components(sets_of(docs))
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == parts


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_few_words(spark, n):
    """One document and few of them, with fewer words in all than a shingle has."""
    words = "one two three four five six".split()
    assert [r.n_shingles for r in neardup.classes(spark.createDataFrame([(7, " ".join(words[:n]))], "doc_id long, text string")).collect()] == [max(1, n - 4)]
    docs = [(i, " ".join(words[: n - i % 2])) for i in range(4)]
    got = {r.doc_id: r for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    sets = sets_of(docs)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), c if sets[i] else i) for i, c in brute_components(sets).items()}


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_collide_under_polynomials(spark, n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    docs = [(1, a), (2, b), (3, f"{a} x y z {b} u"), (4, f"{b} x y z {a} u"), (5, a)]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_components(sets_of(docs))


def twins(size, want, seed=1):
    """Pairs of texts of 16 letters that hash alike without a secret, once the same bytes follow up to `size`."""
    r, u = random.Random(seed), np.uint64
    number = lambda b: np.frombuffer(b, "<u8")
    after = lambda e: words.mix((np.array([size], u) * u(0xC2B2AE3D27D4EB4F) ^ number(e)) * u(words.BASE))
    out, first = [], b"suffixes"
    begin = b"vgchkvlc"
    while len(out) < want:
        other = bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=8))
        second = (number(first) ^ after(begin) ^ after(other)).tobytes()
        if all(33 <= x < 127 and not 65 <= x <= 90 for x in second) and other != begin:
            out.append(((begin + first).decode(), (other + second).decode()))
            begin = bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=8))
    return out


@pytest.fixture(scope="module")
def short_twins():
    pairs = twins(16, 4)
    for a, b in pairs:
        data = np.frombuffer((a + b).encode(), np.uint8)
        h = words.stretches(data, words.unaligned(data), np.array([0, 16]), np.array([16, 32]))
        assert h[0] == h[1]
    return pairs


def test_op5_with_words_that_collide(spark, short_twins):
    """As whole sets, as words of shingles in a pair, and blockwise."""
    docs = [(1, "bvlmcsqisuffixes"), (2, "drzdzzpl`|+7t\""), *((10 + 2 * k + j, x) for k, pair in enumerate(short_twins) for j, x in enumerate(pair))]
    a, b = short_twins[0]
    body = [f"w{k}" for k in range(40)]
    for k in range(30):  # 5 of 36 shingles differ by a twin alone, and some more: links only if twins were taken for equal
        own = list(body)
        own[20] = (a, b)[k % 2]
        own[3 + k // 2 % 2] = f"v{k // 2}"
        docs.append((100 + k, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.classes(df).collect()}
    sets = sets_of(docs)
    assert got == {i: (len(sets[i]), c) for i, c in brute_components(sets).items()} and got[1][1] == 1 and got[2][1] == 2


@pytest.mark.parametrize(("hot", "group_bytes", "sort_bytes"), [(512, 4 << 20, 1 << 20), (1, 300, 100)])
def test_op8_with_strings_that_collide(spark, monkeypatch, hot, group_bytes, sort_bytes):
    """Contexts, slices and streamed groups that only a secret tells apart."""
    for name, value in (("HOT", hot), ("GROUP_BYTES", group_bytes), ("SORT_BYTES", sort_bytes)):
        monkeypatch.setattr(suffix, name, value)
    tail = "".join(random.Random(4).choice("abcdefgh") for _ in range(84))
    docs = [(2 * k + j, x + tail) for k, pair in enumerate(twins(100, 3)) for j, x in enumerate(pair)]
    docs += [(50 + k, t + "zz") for k, (_, t) in enumerate(docs[:3])] + [(60 + k, f"{k % 7}yy" + t) for k, (_, t) in enumerate(docs[:6])]
    want = brute_cut([(i, t.encode()) for i, t in docs])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and got[1][1] == 0


def test_windows():
    """Polynomials by doubling equal those by their sum."""
    data = np.random.default_rng(2).integers(0, 256, 300, dtype=np.uint8)
    for width in (1, 7, 64, 100):
        point = 1234567890123456789 % suffix.PRIME
        want = [sum((int(x) + 1) * pow(point, width - 1 - k, suffix.PRIME) for k, x in enumerate(data[i : i + width])) % suffix.PRIME for i in range(300 - width + 1)]
        assert suffix.windows(data, width, point).tolist() == want


def test_many_small_sets(spark):
    """Templated lines share a bucket but link with none; memory stays that of a block."""
    import resource

    lines = spark.range(50_000).selectExpr("id as doc_id", "concat('one two three four five ', id) as text")
    got = neardup.classes(lines.union(spark.range(6_000).selectExpr("id + 50000", "concat('a b c d e f ', id, case when id < 3000 then '' else ' g' end)")))
    assert got.where("not kept").count() == 0 and got.where("n_shingles between 2 and 4").count() == 56_000
    sets = [np.unique(np.append(np.array([1, 2, 3, 4, 5, 6], np.uint64), np.uint64(100 + i // 2))) for i in range(neardup.BLOCK_SETS)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(neardup.block_links(np.arange(len(sets)), np.arange(len(sets)), sets)) == len(sets) - 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10


def test_components_of_a_chain(spark):
    e = spark.range(500).selectExpr("id as a", "id + 1 as b")
    assert [r[0] for r in components.components(e).select("component").distinct().collect()] == [0]


def test_keep_one(spark, odd, none):
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 6, 7, 7]
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0
    got = {r.doc_id: r for r in neardup.classes(odd).collect()}
    assert got[3].n_shingles == 0 and got[3].kept and got[2].component_id == 1 and got[5].n_shingles == 1


def brute_cut(docs):
    first, out = set(), {}
    for i, b in docs:
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in first:
                gone[s] += 1
                gone[s + 100] -= 1
            first.add(w)
        gone = np.cumsum(gone)[:-1] > 0
        a = np.frombuffer(b, np.uint8)
        out[i] = (len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(a[~gone].tobytes()).hexdigest())
    return out


def test_suffix_ranks():
    r = random.Random(3)
    for _ in range(200):
        t = np.array([r.randint(1, 3) for _ in range(r.randint(1, 60))])
        ranks = suffix.suffix_ranks(t, 1000)
        order = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert np.argsort(ranks).tolist() == order


def test_op8_on_the_table(spark, small):
    docs = sorted((r.doc_id, r.text.encode()) for r in small.collect())
    want = brute_cut(docs)
    assert {r.doc_id: tuple(r)[1:] for r in queries.op8_suffix_array(spark, SF).collect()} == want


def test_op8_on_passages_and_runs(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcd ") for _ in range(400))
    docs = [(i, "".join(r.choice("xyz ü") for _ in range(r.randint(0, 300))) + passage[r.randint(0, 150) : r.randint(200, 400)] + "q" * r.randint(0, 250)) for i in range(80)]
    docs += [(100, "a" * 1000), (101, "ab" * 500), (102, passage * 3), (103, ""), (104, "é" * 120)]
    want = brute_cut([(i, t.encode()) for i, t in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.deduplicate(df).collect()}
    assert got == want


def test_op8_small_pieces(spark, monkeypatch):
    """Long texts cut into pieces, groups sorted alone: the same result."""
    r = random.Random(6)
    body = "".join(r.choice("abcde ") for _ in range(3000))
    docs = [(1, body), (2, body[500:1500] + "!" + body[1400:2600]), (3, body[:99]), (4, body[1000:1100])]
    monkeypatch.setattr(suffix, "PIECE", 700)
    data = [t.encode() for _, t in docs]
    offsets = np.cumsum([0, *map(len, data)])
    flat = np.frombuffer(b"".join(data), np.uint8)
    starts = defaultdict(list)
    for row, _, _, lo, hi, p in suffix.contexts(flat, offsets, b"key"):
        for k, a, b in zip(row.tolist(), lo.tolist(), hi.tolist(), strict=True):
            starts[k] += range(a, b + 1)
        assert ((p >= lo - 0) & (p - lo <= 68)).all()
    assert all(sorted(starts[k]) == list(range(max(0, len(t) - 99))) for k, t in enumerate(data))
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_cut([(i, t.encode()) for i, t in docs])


@pytest.mark.parametrize(("hot", "group_bytes", "sort_bytes"), [(3, 4 << 20, 1 << 20), (512, 3_000, 1_000), (3, 2_000, 1_000)])
def test_op8_hot_passages(spark, monkeypatch, hot, group_bytes, sort_bytes):
    """A passage of 66, 95 and 300 bytes in very many texts with other bytes around it, in all ways that a hot group may take."""
    for name, value in (("HOT", hot), ("GROUP_BYTES", group_bytes), ("SORT_BYTES", sort_bytes)):
        monkeypatch.setattr(suffix, name, value)
    r = random.Random(8)
    passages = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (66, 95, 300)]
    around = lambda: "".join(r.choice("xyz") for _ in range(r.choice([0, 2, 40])))
    docs = [(i, around() + r.choice(passages) + around() + (r.choice(passages) if i % 7 == 0 else "") + around()) for i in range(400)]
    want = brute_cut([(i, t.encode()) for i, t in docs])
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in suffix.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == want


def test_op8_memory_of_a_hot_key():
    """100,000 slices of one key, every second one a repeat of strings."""
    import resource

    import pyarrow as pa

    def batches():
        for lo in range(0, 100_000, 5_000):
            ids = np.arange(lo, lo + 5_000)
            raw = [b"%08d" % (i // 2) + b"p" * 66 + b"%026d" % (i // 2) + b"tail" for i in ids.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(5_000, 7)), pa.array(ids), pa.array(ids * 0), pa.array(ids * 0), pa.array(ids * 0 + 5), pa.array(raw, pa.binary())], ["key", "doc_id", "tie", "start", "strings", "bytes"])

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = pa.Table.from_batches(list(suffix._sort_slices(batches(), (12345678901234567, 98765432109876543))))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500 << 10
    assert found["doc_id"].to_pylist() == list(range(1, 100_000, 2)) and set(found["b"].to_pylist()) == {104}


def test_op8_long_text(spark):
    """A text above the size of a piece, twice, the second time with a byte changed."""
    r = random.Random(11)
    text = "".join(r.choice("abcdefghijklmnop ") for _ in range((1 << suffix.PLACE_BITS) + 200_000))
    docs = [(1, text), (2, text[:700_000] + "!" + text[700_001:])]
    got = {x.doc_id: (x.n_removed, x.n_spans, bytes(x.kept).decode()) for x in suffix.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][:2] == (0, 0) and got[2] == (len(text) - 1, 2, "!")


def test_cut_odd_tables(odd, none):
    cut = suffix.cut_texts(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    by = defaultdict(list)
    for r in cut.collect():
        by[r.doc_id].append(r.text)
    assert by[3] == [""] and len(by[5][0]) < 200 and sorted(by[7]) == ["one more", "one more"]
    assert suffix.deduplicate(none).count() == 0 and suffix.cut_texts(none).count() == 0


def test_op4(spark, small):
    docs = sorted(((r.doc_id, r.text) for r in small.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op4_imatch(spark, SF).collect()}
    prints = {}
    for i, (k, text) in enumerate(docs):
        half = len(text) // 2
        edited = text[: len(text) - half] + docs[(i + 1) % len(docs)][1][:half]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, got[k].fingerprint) == got[k].fingerprint
        assert 0 <= got[k].near_edited <= 1 and 0 <= got[k].near_next <= 1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.7 * len(got)


def xxh64(data, seed=42):
    import xxhash

    return xxhash.xxh64_intdigest(data, seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xxh64_long(value, seed):
    """Spark's hash of a long: of its eight bytes."""
    return xxh64((value & (1 << 64) - 1).to_bytes(8, "little"), seed)


def brute_prints(texts, corpus):
    """Fingerprints of texts by plain sets; corpus: the texts that the lexicon is counted over."""
    of = lambda text: {w for w in re.split(r"[\W_]+", text.lower()) if w}
    df = defaultdict(int)
    for text in corpus:
        for w in of(text):
            df[w] += 1
    n = len(corpus)
    lexicon = {w for w, k in df.items() if max(2, imatch.LEAST * n) <= k <= max(2, imatch.MOST * n)}
    masks = [((1 << r) - 1) << 2 + r * (r - 1) // 2 for r in range(imatch.RATES)]
    out = []
    for text in texts:
        own = of(text) & lexicon or of(text)
        hashes = sorted(signed(xxh64(w.encode())) for w in own)
        parts = []
        for seed in range(1, imatch.SUBSETS // imatch.RATES + 1):
            # a term's draw: the hash of the seed, itself seeded by the hash of the term
            drawn = [xxh64(seed.to_bytes(4, "little"), xxh64_long(h, 42)) for h in hashes]
            for mask in masks:
                kept = [signed(d) for d in drawn if not d & 3 and not d & mask]
                h = 42
                for d in kept:
                    h = xxh64_long(d, h)
                parts.append(h if kept else 0)
        out.append(parts)
    return out


def test_op4_by_brute_force(spark, small):
    docs = sorted(((r.doc_id, r.text) for r in small.collect()), reverse=True)
    ascii_only = [(i, t) for i, t in docs if t.isascii()]
    got = {r.doc_id: r for r in queries.op4_imatch(spark, SF).collect()}
    want = dict(zip([i for i, _ in docs], brute_prints([t for _, t in docs], [t for _, t in docs])))
    for i, _ in ascii_only:
        assert got[i].fingerprint == "".join(f"{p:016x}" for p in want[i]), i
    for (i, _), (j, _) in zip(docs, docs[1:] + docs[:1]):
        said = [x == y for x, y in zip(want[i], want[j]) if x or y]
        if i in dict(ascii_only) and j in dict(ascii_only):
            assert abs(got[i].near_next - (sum(said) / len(said) if said else 1)) < 1e-9


def test_op4_many_ranges(spark, small, monkeypatch):
    whole = sorted(map(tuple, imatch.fingerprints(small).collect()))
    monkeypatch.setattr(imatch, "RANGE_BYTES", 20_000)
    assert sorted(map(tuple, imatch.fingerprints(small).collect())) == whole
    monkeypatch.setattr(imatch, "RANGES", 3)  # ranges that may not become more grow
    assert sorted(map(tuple, imatch.fingerprints(small).collect())) == whole
    assert imatch.with_next(small).select("bucket").distinct().count() <= 3


def test_op4_odd_tables(odd, none, spark):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == odd.count() and imatch.fingerprints(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and set(by[4].fingerprint) == {"0"}
    one = imatch.fingerprints(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"alone" + b"alone").hexdigest() and one.near_next == 1.0


def test_op4_runs_no_python(spark):
    plan = queries.op4_imatch(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
