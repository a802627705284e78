"""Program text, macro bodies, tables in buckets and notes with timers on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.operators import batching, evaluation, guidance, macros, memory, merge, text
from quarry.streaming import events, lives
from quarry.streaming.buckets import Buckets


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def found(spark, body):
    return one(spark, *text.datasets(F.lit(body)))


@pytest.mark.parametrize(
    ("body", "reads", "writes"),
    [
        ("data a; set x3-x5 y7-y6; run;", ["work.x3", "work.x4", "work.x5", "work.y7-y6"], ["work.a"]),
        ("proc sql; create table t as select * from a where k in (select k from (select * from b, c));", ["work.a", "work.b", "work.c"], ["work.t"]),
        ("data w; input x; datalines4;\nset b;\n;;;;\nset c;", ["work.c"], ["work.w"]),
        ("", [], []),
    ],
)
def test_datasets(spark, body, reads, writes):
    assert found(spark, body) == (reads, writes)


@pytest.mark.parametrize(("code", "ok"), [("f(a[1], {'x': \"y\"})", 1), (")(", 0), ("(]", 0), ("([)]", 0), ('x = "it\'s"', 1), ("x = 'open", 0), ("", 1), ("((", 0)])
def test_balanced(spark, code, ok):
    assert one(spark, text.balanced(F.lit(code)))[0] == ok


@pytest.mark.parametrize(
    ("body", "names"), [("%let a = 1; %global b c;", ["a", "b", "c"]), ("select x into :p1 - :p3 from t", ["p1", "p2", "p3"]), ("select x, y into :p1-:p2, :z separated by ',' from t", ["p1", "p2", "z"]), ("call symputx('k', 1);", ["k"])]
)
def test_produced(spark, body, names):
    assert one(spark, macros.produced(F.lit(body)))[0] == names


def test_body_datasets_of_odd_calls(spark):
    """Missing and surplus arguments, unknown macros, names that stay open, a dollar sign in a value, a recursion of two."""
    bodies = spark.createDataFrame([("p", 1, "%macro a(x, y=); data &x; set &y lib.&x..t; run; %b(&x) %mend;"), ("p", 2, "%macro b(z); %a(&z, y=&z) data &other; set fixed; run; %mend;"), ("q", 1, "%macro a; data c; run; %mend;")], "source_id string, idx int, text string")
    calls = spark.createDataFrame([("p", 5, "%a(one, two, three)"), ("p", 6, "%a"), ("p", 7, "%a(n$1, y=lib.s)"), ("p", 8, "%nobody(x)"), ("q", 9, "%a(x)"), ("p", 10, "%b(w)")], "source_id string, idx int, text string")
    got = sorted((r.idx, r.direction, r.name) for r in macros.body_datasets(bodies, calls).collect())
    assert got == [(5, "in", "lib.one.t"), (5, "out", "work.one"), (6, "in", "lib..t"), (7, "in", "lib.n$1.t"), (7, "in", "lib.s"), (7, "out", "work.n$1"), (10, "in", "lib.w.t"), (10, "in", "work.w"), (10, "out", "work.w")]
    assert macros.body_datasets(bodies.where("false"), calls).count() == 0 and macros.body_datasets(bodies, calls.where("false")).count() == 0


def test_edges_of_nothing(spark):
    d = batching.described(spark.createDataFrame([], "source_id string, idx int, kind string, text string"))
    assert batching.edges(d).count() == 0 and batching.batches(d, batching.edges(d)).count() == 0


def units(spark, *bodies):
    return text.units(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "source_id string, text string"))


def test_split_tears_no_statement(spark):
    long = "".join(f"x{k} = {' + '.join(map(str, range(k % 23)))} 1;" + (" " if k % 3 else "") for k in range(200))
    u = units(spark, f"data a; set b; {long} run;", "data small; run;", "%let x = " + "w " * 90 + ";")
    parts = text.split_steps(u, text.chunks(u), 40).orderBy("source_id", "part").collect()
    texts_ = {(r.source_id, r.unit_no): r.text for r in u.collect()}
    by = [r for r in parts if r.source_id == "0" and r.part]
    assert by[0].first_unit == 1 and by[-1].last_unit == 203 and len(by) > 20
    for r in by:
        assert r.text == "".join(texts_["0", k] for k in range(r.first_unit, r.last_unit + 1)) and r.words == len(r.text.split()) and r.writes == ["work.a"]
    for a, b in zip(by, by[1:], strict=False):
        sizes = [len(texts_["0", k].split()) for k in range(max(a.first_unit, a.last_unit - 2), a.last_unit + 1)]
        assert b.first_unit == a.last_unit + 1 - next(k for k in (3, 2, 1) if k <= len(sizes) and (sum(sizes[-k:]) <= 100 or k == 1))
        assert a.words + len(texts_["0", a.last_unit + 1].split()) > 40
    assert [(r.part, r.parent, r.oversized) for r in parts if r.source_id == "1"] == [(0, None, False)]
    assert [(r.part, r.parent, r.oversized) for r in parts if r.source_id == "2"] == [(0, None, True)]


def test_rewriting_swaps(spark):
    table = spark.createDataFrame([("a", "b"), ("b", "a"), ("lib.x", "cat$1.x")], "source string, target string")
    bodies = ["select * from a join B on a.k = b.k", "from lib.x, a as q, a, b where a.z", "insert into A select a from c", "update lib.x set a = 1", "spark.table( 'lib.X' ) /* from a */ 'from a'"]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = [r.new_text for r in text.rewrite_tables(df, "k", "body", table).orderBy("k").collect()]
    assert got == ["select * from b join a on a.k = b.k", "from cat$1.x, b as q, b, a where a.z", "insert into b select a from c", "update cat$1.x set a = 1", "spark.table( 'cat$1.x' ) /* from a */ 'from a'"]


def test_translation_section(spark):
    got = one(spark, *[evaluation.translation(F.lit(x)) for x in ("a\n## Translation\nb\n## C\nd", "## translation (1)\n", "no heading", "### Translation\nx")])
    assert [x.strip() for x in got] == ["b", "", "no heading", "### Translation\nx"]


def test_repeated_transactions_are_refused_whatever_is_asked_for(spark):
    master, changes = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    for ask in (lambda d: d.select("k").collect(), lambda d: d.count(), lambda d: d.collect()):
        with pytest.raises(Exception, match="transaction key repeats"):
            ask(merge.update(master, changes, "k"))


def test_buckets_leave_what_no_key_falls_into(spark, tmp_path):
    """A change of one key in a hundred: other buckets keep their files; the same version again, older versions, vacuum."""
    rows = spark.range(400).select(F.concat(F.lit("k"), "id").alias("kv_key"), F.lit("old").alias("value"), F.lit(None).cast("string").alias("tags"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"), F.lit("s").alias("source"))
    table = events.keyed(spark, str(tmp_path / "t"))
    table.create(rows)
    before = table.folders()
    change = rows.where("substring(kv_key, 2) % 100 = 0").select("kv_key", F.lit("new").alias("value"), "tags", "source")
    upsert = lambda old, new: memory.upsert(old, new, 2.0)
    touched = table.change(0, change, upsert)
    after = table.folders()
    assert 1 <= len(touched) <= 4 and {k for k in before if before[k] != after[k]} == set(touched) and len(before) > 50
    assert table.read().where("value = 'new'").count() == 4 and table.read().count() == 400 and table.read(-1).where("value = 'new'").count() == 0
    assert table.change(0, change, upsert) == touched and table.versions() == [-1, 0] and table.read().count() == 400
    table.change(1, change.limit(0), upsert)
    assert table.folders() == table.folders(0)
    assert table.vacuum(1) > 0 and table.versions() == [1] and table.read().where("value = 'new'").count() == 4
    with pytest.raises(ValueError, match="64 buckets"):
        Buckets(spark, str(tmp_path / "t"), "kv_key", table.schema, 8).folders()


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_lives_expire_and_come_back(spark, tmp_path):
    """Two keys that expire, come back and expire again; a row out of order, one that is too late, and a restart between files."""
    log, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    schema = "k string, ts timestamp"
    write = lambda rows: spark.createDataFrame([(k, at(h)) for k, h in rows], schema).coalesce(1).write.mode("append").parquet(log)

    def run(name):
        df = lives.expiries(spark.readStream.schema(schema).parquet(log), ["k"], "ts", 3600.0, "30 minutes")
        q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        hour = lambda us: (us / 1e6 - at(0).replace(tzinfo=dt.UTC).timestamp()) / 3600
        return sorted((r.k, round(hour(r.opened), 3), round(hour(r.until), 3), r.notes) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write([("a", 0), ("a", 0.5), ("b", 0.2), ("a", 5)])
    assert run("x") == [("a", 0, 1.5, 2), ("b", 0.2, 1.2, 1)]
    write([("a", 4.8), ("b", 0.3), ("b", 6)])  # 4.8 is in time and opens a's second life earlier, 0.3 is too late
    assert run("x") == [("a", 0, 1.5, 2), ("b", 0.2, 1.2, 1)]
    write([("c", 10)])
    assert run("x") == [("a", 0, 1.5, 2), ("a", 4.8, 6, 2), ("b", 0.2, 1.2, 1), ("b", 6, 7, 1)]


def test_merged_lives():
    assert lives.merged([(0, 5, 2), (20, 20, 1)], [9, 30, 12], 10) == [(0, 20, 5), (30, 30, 1)]
    assert lives.merged([], [], 10) == []


def test_index_follows_changes(spark, tmp_path):
    """After random puts and deletes a search gives what BM25 from scratch gives, and reads the buckets of its words only."""
    import random

    from quarry.operators import index, retrieval

    rng, words = random.Random(5), ["alpha", "beta", "gamma", "delta", "the"]
    body = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    schema = "kv_key string, value string, tags string"
    store = {f"k{i}": (body(), None if i % 3 else '["beta"]') for i in range(30)}
    frame = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], schema)
    own = index.Index(spark, str(tmp_path / "i"))
    own.create(frame(store))
    for version in range(2):
        puts = {f"k{rng.randint(0, 40)}": (rng.choice([body(), None, "beta the"]), None) for _ in range(8)}
        gone = [f"k{rng.randint(0, 40)}" for _ in range(6)]
        for _ in range(1 + version):  # the second time as after a failure
            own.change(version, frame(puts), spark.createDataFrame([(k,) for k in [*gone, gone[0]]], "kv_key string"))
        for k in gone:
            store.pop(k, None)
        store.update(puts)
        now = frame(store).select("kv_key", F.concat_ws("\n", "kv_key", F.coalesce("value", F.lit("")), F.coalesce("tags", F.lit(""))).alias("t"))
        for asked in ("beta the", "zeta"):
            want = {r.kv_key: round(r.score, 9) for r in retrieval.bm25(now, "kv_key", "t", asked).collect()}
            assert {r.kv_key: round(r.score, 9) for r in own.search(asked).collect()} == want, (version, asked)
    found = own.search("beta")
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "/postings/" in f}
    assert found.count() and len(read) <= index.SPREAD and all("/keys/" not in f for f in found.inputFiles())
    assert own.search("").count() == 0
    dense = spark.createDataFrame([("k1", 0.9), ("no such key", 1.0)], "kv_key string, score double")
    assert "no such key" not in {r.kv_key for r in own.hybrid("beta", dense, 50).collect()}
    own.postings.change(5, own.postings.read().limit(0), lambda old, new: old)
    with pytest.raises(ValueError, match="not completed"):
        own.change(6, frame({"a": ("b", None)}))
    own.vacuum(1)
    empty = index.Index(spark, str(tmp_path / "e"))
    empty.create(frame({"x": ("y", None)}).limit(0))
    assert empty.search("y").count() == 0


def test_claims_and_budgets(spark):
    """Tiers, turns of constructs, gates and a second claim; then both budgets against a plain loop, wider ones dropping less."""
    schema = "chunk_id int, scope string, langs array<string>, kinds array<string>, metas array<string>, constructs array<string>, size int"
    chunks = spark.createDataFrame(
        [
            (1, "reference", None, [], [], ["proc:sort"], 10), (2, "reference", [], [], [], ["proc:sort"], 10), (3, "reference", [], [], [], ["proc:means"], 10), (4, "reference", [], [], [], ["call:symput", "proc:sort"], None),
            (5, "pinned", [], [], [], [], 10), (6, "always", ["sql"], [], [], [], 10), (7, "always", [], ["K"], [], [], 10), (8, "always", [], ["other"], [], [], 10), (9, "when", [], [], ["hazard"], ["proc:means", "proc:sort"], 10),
            (10, "example", [], [], [], [], 10), (11, "example", [], [], [], ["proc:sort"], 10), (12, "topic", [], [], [], [], 10), (13, "reference", [], [], [], [], 10), (14, "reference", [], [], [], ["proc:print"], 10), (None, "always", [], [], [], [], 1),
        ],
        schema,
    )
    items = spark.createDataFrame([("a", "sql", ["K"], ["hazard"], ["proc:sort", "proc:means", "call:symput", "proc:print", "proc:sort"]), ("b", "py", None, None, None), ("c", None, [], [], [])], "item_id string, lang string, kinds array<string>, metas array<string>, constructs array<string>")
    ranking = spark.createDataFrame([("a", 13, 1), ("a", 12, 9), ("a", 1, 2), ("a", 6, 1), ("b", 12, 3), ("b", 1, 1), ("b", 1, 4)], "item_id string, chunk_id int, rank int")
    claimed = guidance.claims(chunks, items, ranking, ["call:symput"], ["proc:print"])
    got = {}
    for r in claimed.orderBy("item_id", "claim_no").collect():
        got.setdefault(r.item_id, []).append((r.chunk_id, r.tier, r.construct))
    assert got["a"] == [(6, "user_always", None), (9, "user_when", "proc:sort"), (7, "user_gated", None), (10, "user_example", None), (11, "user_example", "proc:sort"), (5, "pinned", None), (4, "hazard", "call:symput"), (1, "construct", "proc:sort"), (3, "construct", "proc:means"), (2, "construct", "proc:sort"), (12, "user_topic", None), (13, "topical", None)]
    assert [x[:2] for x in got["b"]] == [(10, "user_example"), (5, "pinned"), (12, "user_topic"), (1, "topical")]
    assert [x[0] for x in got["c"]] == [6, 10, 5]
    shares = []
    for budget, own, k in ((25, 15, 6), (60, 40, 1), (80, 40, 6), (200, 100, 6)):
        taken, used, mine, topics = set(), 0, 0, 0
        for r in sorted((x for x in claimed.collect() if x.item_id == "a"), key=lambda x: x.claim_no):
            topic = r.tier in ("topical", "user_topic")
            if used + r.size <= budget and not (r.is_user and mine + r.size > own) and not (topic and topics >= k):
                taken.add(r.chunk_id)
                used, mine, topics = used + r.size, mine + r.size * r.is_user, topics + topic
        out = guidance.selected(claimed, budget, own, k).where("item_id = 'a'").collect()
        assert {r.chunk_id for r in out if r.taken} == taken and len(out) == 12
        shares.append((sum(r.size for r in out if r.taken), sum(not r.taken for r in out)))
    assert [s <= b for (s, _), b in zip(shares, (25, 60, 80, 200), strict=True)] == [True] * 4
    assert sorted(shares) == shares and shares[-1][1] == 0 and shares[0][1] > shares[2][1] > 0
    assert guidance.selected(guidance.claims(chunks.limit(0), items, ranking), 1, 1, 1).count() == 0


def test_catalogues_inherit_over_levels(spark):
    """Three levels, a group below an entry, a long chain; closed chains, two parents and unknown ones are refused; the allow-list."""
    from quarry.operators import scoring

    profiles = spark.createDataFrame([("base", None), ("mid", "base"), ("leaf", "mid")], "profile string, parent string")
    entries = spark.createDataFrame([("base", "function", "MD5", "LOW", "DIRECT"), ("base", "proc", "sort", "LOW", "DIRECT"), ("leaf", "function", "md5", "HIGH", None), ("mid", "function", None, "LOW", None)], "profile string, kind string, name string, tier string, parity string")
    groups = spark.createDataFrame([("mid", 1, "function", ["md5", "sha256"], "MEDIUM", "HARD"), ("base", 1, "function", ["md5", "hmac"], "MEDIUM", "PARTIAL"), ("base", 2, "function", ["hmac"], "HIGH", "MANUAL"), ("leaf", 1, "x", None, "LOW", None)], "profile string, group_no int, kind string, names array<string>, tier string, parity string")
    got = scoring.catalogue(profiles, entries, groups, ["tier", "parity"])
    want = {
        "base": {("hmac", "HIGH", "MANUAL", "base"), ("md5", "LOW", "DIRECT", "base"), ("sort", "LOW", "DIRECT", "base")},
        "mid": {("hmac", "HIGH", "MANUAL", "base"), ("md5", "MEDIUM", "HARD", "mid"), ("sha256", "MEDIUM", "HARD", "mid"), ("sort", "LOW", "DIRECT", "base")},
        "leaf": {("hmac", "HIGH", "MANUAL", "base"), ("md5", "HIGH", None, "leaf"), ("sha256", "MEDIUM", "HARD", "mid"), ("sort", "LOW", "DIRECT", "base")},
    }
    rows_ = got.collect()
    assert {p: {(r.name, r.tier, r.parity, r.stated_by) for r in rows_ if r.profile == p} for p in want} == want
    uses = spark.createDataFrame([("mid", "function", "SHA256", 3), ("mid", "function", "zip", 1), ("base", "function", "sha256", 2)], "profile string, kind string, name string, n int")
    assert {(r.profile, r.name, r.n, r.tier, r.listed) for r in scoring.allowed(uses, got, ["tier"]).collect()} == {("mid", "SHA256", 3, "MEDIUM", True), ("mid", "zip", 1, None, False), ("base", "sha256", 2, None, False)}
    stated = spark.createDataFrame([("base", "f", "LOW", 1), ("mid", "f", None, 2), ("leaf", "f", "HIGH", None), ("leaf", "g", None, None)], "profile string, name string, tier string, weight int")
    assert {tuple(r) for r in scoring.flags(profiles, stated, ["tier", "weight"]).collect()} == {("base", "f", "LOW", 1), ("mid", "f", "LOW", 2), ("leaf", "f", "HIGH", 2), ("leaf", "g", None, None)}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "profile int, parent int")
    assert scoring.lineage(chain).count() == 40 * 41 // 2
    for bad, what in (([("a", "b"), ("b", "a")], "itself"), ([("a", "a")], "itself"), ([("a", None), ("a", "b"), ("b", None)], "two parents"), ([("a", "z")], "no profile")):
        with pytest.raises(ValueError, match=what):
            scoring.lineage(spark.createDataFrame(bad, "profile string, parent string"))


def test_chunks_as_a_table_function(spark):
    """A state for each source: SQL gives the rows of text.chunks; tables without the columns, and scalars, are refused."""
    from quarry.functions import hooks

    bodies = ["data a; set b; run; %let x = 1; proc sort data=a; by k; data c; set a;", "%macro m; data q; %macro n; run; %mend; %mend; foo; bar; /* c */ %m", "", "run; quit;", "proc sql; select 1; quit; title 'x';", None]
    units = text.units(spark.createDataFrame([(f"s{i}", b) for i, b in enumerate(bodies)], "source_id string, text string"))
    hooks.register(spark)
    text.described_units(units).createOrReplaceTempView("some_units")
    got = spark.sql("select * from chunk_units(TABLE(some_units) PARTITION BY source_id ORDER BY unit_no)")
    want = text.chunks(units)
    assert got.columns == want.columns
    plain = lambda d: sorted(tuple(r) for r in d.collect())
    assert plain(got) == plain(want) and got.count() > 8
    for bad in ("TABLE(select 1 as source_id)", "'data a;'"):
        with pytest.raises(Exception, match="chunk_units"):
            spark.sql(f"select * from chunk_units({bad})").collect()


def test_turns_and_profiles(spark):
    from quarry.operators import graph, retrieval

    x = spark.createDataFrame([("a", i, s) for i, s in enumerate([5.0, None, 1.0, 9.0, None, None], 1)] + [("b", i, None) for i in range(1, 7)] + [("c", 1, None), ("c", 2, 1.0)] + [(None, i, float(i == 1)) for i in range(1, 5)], "g string, seq int, score double")
    kept = lambda *n: {g: [r.seq for r in sorted(retrieval.select_turns(x, "g", "seq", "score", *n).collect(), key=lambda r: r.seq) if r.g == g] for g in ("a", "b", "c", None)}
    assert kept(3, 1) == {"a": [1, 4, 6], "b": [4, 5, 6], "c": [1, 2], None: [1, 3, 4]}
    assert kept(5, 1)["a"] == [1, 3, 4, 6] and kept(2, 5)["a"] == [5, 6] and kept(6, 1)["a"] == [1, 2, 3, 4, 5, 6]
    uses = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("q", "z"), ("p", "x"), ("s", "std")], "source string, name string")
    makes = spark.createDataFrame([("q", "x"), ("r", "x"), ("p", "w")], "source string, name string")
    got = {r.source: tuple(r)[1:] for r in graph.profiles(uses, makes, 3, ["std"]).collect()}
    assert got == {"p": (["q", "r"], [], ["x"], [], ["y"]), "q": ([], ["p"], [], ["x"], ["z"]), "r": ([], ["p"], [], ["x"], []), "s": ([], [], [], [], [])}
