"""Importance resampling, collocations and line de-duplication against brute force, with odd tables, hot keys and deletions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quarry.llm import lines, phrases, queries, resample
from quarry.llm.common import scratch

SF = "/root/testdata/sf0.001"
LOWER = {k: k + 32 for k in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_resample", "op12_phrases", "op13_lines"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in df.collect())
    assert str(rows) == str(sorted(want.fetchall())) or sorted(map(str, rows)) == sorted(map(str, want.fetchall()))


# ---- resampling


def brute_resample(docs, target, orders=(1, 1), share=(10, 100), least=20, buckets=10_000):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_t * 0 + all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], -(1 << 63) if x[0] is None else x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: len(able) * share[0] // share[1]])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
def test_resample_on_the_table(spark, small, orders):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = resample.resample(small, target, orders, (30, 100))
    assert by_text(map(tuple, got.collect())) == by_text(brute_resample(docs, [r.text for r in target.collect()], orders, (30, 100)))


@pytest.mark.parametrize("orders", [(1, 1), (1, 2)])
def test_resample_odd(spark, odd, none, orders):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([(None,), ("the fox",), ("",)], "text string")
    got = resample.resample(odd, target, orders, (1, 1), 5)
    assert by_text((*r[:4], r[4] is None) for r in got.collect()) == by_text((*r[:4], r[4] is None) for r in brute_resample(docs, ["", "the fox", ""], orders, (1, 1), 5))
    assert resample.resample(none, target).collect() == []
    empty_target = resample.resample(odd, target.where("false")).collect()
    assert len(empty_target) == len(docs)
    kept = resample.keep_drawn(odd, target, share=(1, 1), least_words=5)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 5, 6, 6} | {r[0] for r in brute_resample(docs, [], least=5, share=(1, 1)) if r[4]}


# ---- collocations


def brute_phrases(docs, max_words=4, least=30, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * found[p[i : i + k]]}
        rows = []
        for p in found.keys() - gone:
            score, k = min((2_000_000 * own[p] // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -own[p], " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, x, y, n[lang], -s) for k, (s, a, p, x, y) in enumerate(sorted(rows)[:most])]
    return out


@pytest.mark.parametrize(("words", "least", "most"), [(4, 30, 2000), (2, 5, 50), (5, 8, 3), (3, 2, 2000)])
def test_phrases_on_the_table(spark, small, words, least, most):
    docs = [(r.lang, r.text) for r in small.collect()]
    assert sorted(map(tuple, phrases.collocations(small, words, least, most).collect())) == sorted(brute_phrases(docs, words, least, most))


def test_phrases_with_full_bitmaps(spark, small, monkeypatch):
    """Bits that are set by chance, and blocks of a few texts, change nothing."""
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    docs = [(r.lang, r.text) for r in small.collect()]
    assert sorted(map(tuple, phrases.collocations(small, 4, 8).collect())) == sorted(brute_phrases(docs, 4, 8))


def test_phrases_odd(spark, odd, none):
    from pyspark.sql import functions as F

    rows = [(None, "A b. a B, a\tb  a b a b\n"), ("und", "a b"), ("x", None), ("x", ""), ("x", ". , ;"), ("y", "é É É é é É " * 9), ("", "a\x00 a\x00 a\x00 a\x00"), ("z", "w " * 70_000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("phrase", F.lit(None).cast("int"))
    got = sorted(map(tuple, phrases.collocations(df, 4, 2).collect()))
    assert got == sorted(brute_phrases(rows, 4, 2)) and got
    assert phrases.collocations(none.withColumn("lang", F.lit("a"))).collect() == []
    docs = [("q", r.text) for r in odd.collect()]
    assert sorted(map(tuple, phrases.collocations(odd.withColumn("lang", F.lit("q")), 3, 2).collect())) == sorted(brute_phrases(docs, 3, 2))


# ---- lines


def brute_lines(docs, least=10):
    low = lambda i: -(1 << 63) if i is None else i
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(LOWER)
    held = defaultdict(set)
    for i, text in docs:
        for x in (text or "").split("\n"):
            held[key(x)].add(low(i))
    out = []
    for i, text in docs:
        each = (text or "").split("\n")
        kept = [x for x in each if len(key(x)) < least or min(held[key(x)]) == low(i)]
        out.append((i, len(each), len(each) - len(kept), "\n".join(kept)))
    return out


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def made(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i, "\n".join(r.choice(["A common line here ", " a COMMON line here", "short", "", f"line number {r.randrange(60)}", f"own {r.random()}", "Zwölf Zeichen ß\t"]) for _ in range(r.randrange(9)))) for i in range(n)]


def test_lines_odd(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()] + [(9, "x" * 9), (10, "X" * 10 + "\r"), (11, " " + "x" * 10 + "\n" + "x" * 9), (12, "é" * 10), (13, "É" * 10 + "\n" + "é" * 10 + "\n\n"), (14, "line of fourteen\n" * 40_000), (15, "line of fourteen")]
    df = frame(spark, docs)
    got = lines.deduplicate(df, scratch(spark, "t"), 2)
    assert by_text(map(tuple, got.collect())) == by_text(brute_lines(docs))
    assert lines.deduplicate(none, scratch(spark, "t"), 2).collect() == []


def test_lines_are_reversible(spark):
    """After each insertion and deletion: what a new store of the documents that are left would say; filters hold what the counts ask for."""
    store = lines.LineStore(spark, scratch(spark, "t"))
    docs = dict(made(1, 60))

    def agrees():
        rows = sorted(docs.items())
        assert by_text(map(tuple, store.clean(frame(spark, rows)).collect())) == by_text(brute_lines(rows))
        copies = store._filters(store._snapshot()[1]).agg({"copies": "sum"}).first()[0]
        assert copies == sum(min(2, r.documents) for r in store.counts().collect())

    store.insert(frame(spark, list(docs.items())))
    agrees()
    for step in range(3):
        gone = [i for i in docs if i % 3 == step]
        docs = {i: t for i, t in docs.items() if i not in gone}
        store.delete(frame(spark, [(i, "") for i in [*gone, 9999]]))
        if docs:
            agrees()
        new = dict(made(10 + step, 20, 100 * step))  # ids that were deleted come back with other texts
        docs = {**{i: t for i, t in docs.items() if i not in new}, **new}
        old = [i for i in new]
        store.delete(frame(spark, [(i, "") for i in old]))
        store.insert(frame(spark, list(new.items())))
        agrees()
    assert store.compact() and store.references().count() == sum(len(lines_of) for lines_of in [[x for t in docs.values() for x in t.split("\n") if len(x.strip()) >= 10]])
    agrees()


def test_only_some_documents(spark):
    docs = made(5, 50)
    store = lines.LineStore(spark, scratch(spark, "t"))
    store.insert(frame(spark, docs))
    every = {tuple(r) for r in store.repeats().collect()}
    some = {tuple(r) for r in store.repeats(frame(spark, docs).where("doc_id % 4 = 0")).collect()}
    assert some == {x for x in every if x[0] % 4 == 0} and some


def test_filters_grow(spark, monkeypatch):
    """Filters that fill up are built anew; the results stay."""
    monkeypatch.setattr(lines, "FULL", 40)
    docs = made(2, 80)
    store = lines.LineStore(spark, scratch(spark, "t"))
    sizes = []
    for part in (docs[:20], docs[20:50], docs[50:]):
        store.insert(frame(spark, part))
        sizes.append(store._filters(store._snapshot()[1]).count())
    assert sizes == sorted(sizes) and sizes[-1] > sizes[0]
    assert by_text(map(tuple, store.clean(frame(spark, docs)).collect())) == by_text(brute_lines(docs))


def test_cuckoo(monkeypatch):
    monkeypatch.setattr(lines, "BUCKETS", 1 << 8)
    keys = np.random.default_rng(3).integers(0, 1 << 63, (900, 4), dtype=np.uint64)
    c = lines.Cuckoo()
    assert c.add(keys[:500]) and c.add(keys[:200])
    assert (c.copies(keys[:200]) == 2).all() and (c.copies(keys[200:500]) >= 1).all() and (c.copies(keys[500:]) == 0).mean() > 0.9
    c.remove(keys[:200])
    c.remove(keys[100:400])
    assert (c.cells != 0).sum() == 200 and (c.copies(keys[:100]) >= 1).all() and (c.copies(keys[400:500]) >= 1).all()
    assert not lines.Cuckoo().add(np.concatenate([keys, keys]))  # more than there are cells
    with pytest.raises(ValueError, match="not in its filter"):
        c.remove(keys[600:700])
