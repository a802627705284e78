"""Classifier, mixing, language models and shards: held-out accuracy, fitted totals, counts and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import lmscore, mixing, queries, shards, toxicity
from quarry.llm.common import scratch

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op1_toxicity(spark, SF)
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits >= 0.75 * sum(r.toxic for r in rows)
    assert sum((1 - r.toxic) * r.predicted for r in rows) <= 0.01 * len(rows)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_rows_are_not_learned(small, labels):
    known = {r.doc_id for r in toxicity.toxic_labels(labels).collect()}
    import zlib

    assert known and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in known)


def test_toxicity_odd_tables(odd, none, labels, small, spark):
    model = toxicity.fit_toxic(small, labels)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(none, model).count() == 0
    blind = toxicity.fit_toxic(small, labels.where("false"))
    assert {r.score < 1e-9 for r in toxicity.score(odd, blind).collect()} == {True}
    clash = toxicity.fit_toxic(small, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    assert clash.bias.shape == (1,)


def test_ftrl_is_sparse():
    m, r = toxicity.Ftrl(0.5), np.random.default_rng(1)
    for _ in range(400):
        label = float(r.integers(0, 2))
        m.learn(np.array([7 if label else 9, *r.integers(100, 100_000, 20), toxicity.BUCKETS]), label)
    w = m.weights(slice(None))
    assert w[7] > 1 and w[9] < -1 and (w != 0).sum() < 50


def test_mix_meets_targets(small, labels):
    mix, rows = mixing.fit_mix(small, labels, {"high": 0.6, "low": 0.3, "toxic": 0.1})
    assert np.allclose(mix.after, mix.asked, rtol=1e-3)
    out = mixing.rates(rows, mix).collect()
    assert min(r.rate for r in out) >= 0 and all(abs(r.copies - r.rate) < 1 for r in out)
    total = sum(np.array(r.p) * r.rate * r.tokens for r in out)
    assert np.allclose(total, mix.after, rtol=1e-6)


def test_mix_keeps_every_row(small, labels, odd, none):
    mix, _ = mixing.fit_mix(small, labels, {"high": 0.9, "low": 0.1}, least=1.0, of=mixing.domain(toxic=None))
    assert mix.met and np.allclose(mix.after, mix.asked, rtol=1e-3)
    got = mixing.mixed(small, mix)
    assert got.columns == small.columns and got.select("doc_id").distinct().count() == small.count() <= got.count()
    assert mixing.mixed(odd, mix).count() >= odd.count() and mixing.mixed(none, mix).count() == 0
    mixing.fit_mix(none, labels, {"high": 1.0, "low": 1.0})


def test_ftrl_by_the_book():
    """Against the published update, coordinate by coordinate."""
    r = np.random.default_rng(4)
    examples = [(sorted(set(r.integers(0, 30, 6).tolist())), int(r.random() < 0.4)) for _ in range(300)]
    m, z, n = toxicity.Ftrl(0.4), {}, {}
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    bias = toxicity.BUCKETS
    z[bias], n[bias] = -np.log(0.4 / 0.6) * (b / a + l2), 0.0

    def weight(i):
        own = 0 if i == bias else l1
        if abs(z.get(i, 0.0)) <= own:
            return 0.0
        return -(z[i] - np.sign(z[i]) * own) / ((b + np.sqrt(n[i])) / a + l2)

    for own, label in examples:
        own = [*own, bias]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in own:
            sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / a
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
        m.learn(np.array(own), label)
    assert np.allclose(m.weights(np.array([*range(30), bias])), [weight(i) for i in [*range(30), bias]])
    assert any(weight(i) for i in range(30)) and not all(weight(i) for i in range(30))


def test_scores_are_sums_of_distinct_features(spark, small, labels):
    from quarry.llm.words import Words

    model = toxicity.fit_toxic(small, labels)
    weights = dict(zip(model.bucket.tolist(), model.weight[:, 0].tolist()))
    for r in toxicity.score(small, model).join(small, "doc_id").limit(30).collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        found = {x for _, bucket in toxicity.features(Words(raw, np.array([0, len(raw)]), toxicity.IS_WORD)) for x in bucket.tolist()}
        assert abs(r.score - 1 / (1 + np.exp(-(model.bias[0] + sum(weights.get(x, 0.0) for x in found))))) < 1e-5


def nnls(p, tokens, asked, least, rounds=4000):
    """Plain coordinate descent on the whitened least squares; what the domains get."""
    a = (p * tokens[:, None]).T
    w = np.linalg.pinv((p.T @ (p * tokens[:, None])) / tokens.sum() + 1e-9 * np.eye(p.shape[1]))
    r = np.maximum(np.ones(len(p)), least)
    scale = np.einsum("ki,kl,li->i", a, w, a)
    gap = a @ r - asked
    for _ in range(rounds):
        for i in np.flatnonzero(tokens):
            new = max(least, r[i] - a[:, i] @ w @ gap / scale[i])
            gap += a[:, i] * (new - r[i])
            r[i] = new
    return gap + asked, float(gap @ w @ gap) / tokens.sum() ** 2


class Names:
    names = ("a", "b", "c")


@pytest.mark.parametrize(("weights", "least", "reachable"), [((0.2, 0.3, 0.5), 0.0, True), ((0.9, 0.05, 0.05), 0.0, False), ((0.5, 0.3, 0.2), 1.0, True), ((0.0, 0.5, 0.5), 0.0, False)])
def test_mix_against_plain_least_squares(spark, monkeypatch, weights, least, reachable):
    monkeypatch.setattr(mixing, "REPLAYED", 3)
    rng = np.random.default_rng(2)
    p = rng.dirichlet([2, 2, 2], 60)
    tokens = rng.integers(0, 400, 60)
    rows = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    mix = mixing.solve(rows, Names, dict(zip(Names.names, weights)), least)
    want, squares = nnls(p, tokens.astype(float), mix.asked, least, 300)
    assert mix.met == reachable
    if reachable:
        assert np.allclose(mix.after, mix.asked, atol=1e-5 * tokens.sum())
    got = (mix.after - mix.asked) / tokens.sum()
    w = np.linalg.pinv((p.T @ (p * tokens[:, None])) / tokens.sum() + 1e-9 * np.eye(3))
    assert got @ w @ got <= squares * 1.25 + 1e-9
    assert np.allclose(mix.after, (tokens * mixing.replay(p, mix.steps, least)[0]) @ p)


def test_mix_refuses(spark):
    rows = spark.createDataFrame([(1, 5, [0.2, 0.3, 0.5])], "doc_id long, tokens long, p array<double>")
    for weights, least in (((0, 0, 0), 0.0), ((-1, 1, 1), 0.0), ((0, 0.5, 0.5), 1.0)):
        with pytest.raises(ValueError):
            mixing.solve(rows, Names, dict(zip(Names.names, weights)), least)
    with pytest.raises(mixing.NotSettled):
        mixing.solve(rows, Names, {"a": 1, "b": 1, "c": 1}, rounds=0)


def test_mix_odd_tables(odd, none, small, labels):
    mix, _ = mixing.fit_mix(small, labels)
    rows = mixing.rates(mixing.memberships(odd, mix.model), mix)
    assert rows.count() == odd.count() and rows.where("rate < 0 or copies < 0 or rate is null").count() == 0
    assert mixing.rates(mixing.memberships(none, mix.model), mix).count() == 0


def words_of(text):
    import re

    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


def brute_losses(docs, chosen, queries=None):
    """(id, tokens, target loss, background loss) by dictionaries; docs, queries: (id, text)."""
    from collections import Counter

    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for i, text in docs:
        t = words_of(text)
        for k in (0, 1)[: 1 + (i in chosen)]:
            words[k].update(t)
            pairs[k].update(zip(t, t[1:]))
    size = [sum(w.values()) for w in words]
    scale = [size[1] / size[0] if all(size) else 1, 1]
    out = []
    for i, text in docs if queries is None else queries:
        t, loss = words_of(text), []
        for k in (0, 1):
            own = queries is None and (k == 0 or i in chosen)
            ow, op = (Counter(t), Counter(zip(t, t[1:]))) if own else (Counter(), Counter())
            total, each = scale[k] * (size[k] - len(t) * own), []
            for a, b in zip([None, *t], t):
                single = (scale[k] * (words[k][b] - ow[b]) + lmscore.ADDED) / (total + lmscore.ADDED * (len(words[0]) + 1))
                each.append(-np.log(single if a is None else (scale[k] * (pairs[k][a, b] - op[a, b]) + lmscore.PRIOR * single) / (scale[k] * (words[k][a] - ow[a]) + lmscore.PRIOR)))
            loss.append(sum(each) / max(len(each), 1))
        out.append((i, len(t), loss[1], loss[0]))
    return out


def test_lm_prefers_its_target(spark):
    good = [(i, " ".join(f"alpha{(i + k) % 20} beta{k % 20}" for k in range(60))) for i in range(60)]
    bad = [(100 + i, " ".join(f"gamma{(i * k) % 20} delta{k % 20}" for k in range(60))) for i in range(60)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string")
    s = {r.doc_id: r.score for r in lmscore.score(docs, spark.range(30).withColumnRenamed("id", "doc_id")).collect()}
    assert max(s[i] for i in range(30, 60)) < min(s[i] for i in range(100, 160))


def test_lm_odd_tables(odd, none):
    got = lmscore.score(odd, odd.where("doc_id < 3")).collect()
    assert len(got) == odd.count() and {r.score for r in got if r.doc_id in (3, 4)} == {0.0}
    assert lmscore.score(none, none).count() == 0
    unseen = lmscore.score(odd, none).collect()
    assert len(unseen) == odd.count() and all(np.isfinite(r.score) for r in unseen)


def test_lm_target_counts_all_wanted(spark):
    n = 24_100
    docs = spark.range(n + 100).select(F.col("id").alias("doc_id"), F.lit("alpha beta").alias("text"))
    fitted = lmscore.fit(docs, docs.where(F.col("doc_id") < n))
    assert fitted.models.total.tolist() == [2 * (n + 100), 2 * n]


@pytest.mark.parametrize("chunk_bytes", [1 << 13, 16 << 20])
def test_lm_losses_by_brute_force(spark, small, labels, monkeypatch, chunk_bytes):
    monkeypatch.setattr(lmscore, "PART_BYTES", 1 << 14)
    monkeypatch.setattr(lmscore, "CHUNK_BYTES", chunk_bytes)
    wanted = labels.where("quality = 1")
    chosen = {r.doc_id for r in wanted.collect()}
    docs = [(r.doc_id, r.text) for r in small.collect()]
    same = lambda got, want: all(np.allclose(a, b, atol=1e-9) for a, b in zip(sorted(got), sorted(want), strict=True))
    assert same([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in lmscore.score(small, wanted).collect()], brute_losses(docs, chosen))
    other = small.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" neverseen words")))
    got = lmscore.score(small, wanted, queries=other).collect()
    assert same([(r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got], brute_losses(docs, chosen, [(r.doc_id, r.text) for r in other.collect()]))


def test_store(spark, small, odd, none, monkeypatch):
    monkeypatch.setattr(shards, "BASE_BYTES", 20_000)
    store = shards.ingest(small, scratch(spark, "store"), 9, target_bytes=60_000)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, small.collect()))
    tiers = [r.tier for r in store.runs()]
    assert max(tiers.count(t) for t in tiers) < shards.FANOUT and len(tiers) < 9 and sum(r.rows for r in store.runs()) == small.count()
    assert store.version() > 9


def test_store_commits_once(spark, small):
    store = shards.Store(spark, scratch(spark, "store"))
    assert store.version() == 0 and store.runs() == []
    store.append(small.limit(5))
    with pytest.raises(shards.Conflict):
        store._commit(1, [])
    lost = store._write(small.limit(3))  # written, never committed
    assert store.read().count() == 5
    assert store.vacuum() == 0 and store.fs.exists(store.path(lost.path))
    assert store.vacuum(lease=0) == 1 and not store.fs.exists(store.path(lost.path)) and store.read().count() == 5
    store._create(f"{store.root}/versions/{2:012d}", "")  # a writer that was lost while committing
    assert store.version() == 1 and store.read().count() == 5
    with pytest.raises(shards.Conflict):
        store._commit(2, store.runs())
    store.vacuum(lease=0)
    store.append(small.limit(2))
    assert store.version() == 2 and store.read().count() == 7


def test_store_readers_and_writers_go_on(spark, small):
    """Through a compaction: a reader of an earlier version, an older version, and a writer that commits afterwards."""
    store, other = (shards.Store(spark, root) for root in [scratch(spark, "store")] * 2)
    for _ in range(3):
        store.append(small.limit(5))
    early = store.read()
    late = other._write(small.limit(7))
    store.append(small.limit(5))
    assert store.compact() == 1 and len(store.runs()) == 1
    assert store.vacuum() == 0
    assert early.count() == 15 and store.read(3).count() == 15 and store.read().count() == 20
    version, runs = other._snapshot()
    other._commit(version + 1, [*runs, late])
    assert store.read().count() == 27
    store.vacuum(keep=1, lease=0)
    assert store.read().count() == 27
    with pytest.raises(KeyError):
        store.read(3)


def test_store_concurrent_appends(spark, small):
    import threading

    root = scratch(spark, "store")
    threads = [threading.Thread(target=lambda: shards.Store(spark, root).append(small.limit(4))) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = shards.Store(spark, root)
    assert store.version() == 6 and store.read().count() == 24


def test_store_odd_tables(spark, odd, none):
    store = shards.ingest(odd, scratch(spark, "store"), 3)
    assert store.read().count() == odd.count() and store.read().columns == odd.columns
    empty = shards.ingest(none, scratch(spark, "store"), 2)
    assert empty.read().count() == 0


def test_op9(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    got = queries.op9_sharding(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.ORACLES["op9_sharding"]).fetchall())
