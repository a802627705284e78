"""Queries on functions that the other modules leave out: order statistics, characters, clocks, distances, the key-value store, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.base import ORACLES, query
from quarry.catalog.corpus import _KV, _kv
from quarry.functions import char, dates, hooks, numeric, patterns
from quarry.operators import memory, merge, retrieval, scoring, step
from quarry.sources import files
from quarry.streaming import events as stream

ORACLES["running_headers_all"] = r"""with p as (select coalesce(source, '') as doc, doc_id as page, string_split(coalesce(text, ''), chr(10)) as ls from documents),
    n as (select doc, count(*) as n from p group by 1),
    l as (select doc, page, unnest(ls) as line, unnest(range(len(ls))) as pos, len(ls) - 1 as top from p),
    c as (select doc, line from l join n using (doc) where pos in (0, top) group by doc, line, n having count(distinct page) >= greatest(3, floor(n * 0.5)))
    select doc, page, string_agg(line, chr(10) order by pos) as text from l
    where not (pos in (0, top) and ((doc, line) in (select (doc, line) from c) or regexp_matches(trim(line), '^\d+$'))) group by 1, 2"""


@query("""with x as (select l_orderkey, l_linenumber, case when l_orderkey % 4 = 0 then null else l_quantity end as a, nullif(l_discount, 0) as b, l_tax as c from lineitem),
    y as (select *, list_sort([v for v in [a, b, c] if v is not null]) as v from x)
    select l_orderkey, l_linenumber, round(v[-1] - v[1], 6) as spread, case when len(v) > 1 then round(list_aggregate(v, 'stddev_samp'), 6) end as sd,
    v[2] as second, case when len(v) > 1 then v[len(v) - 1] end as last_but_one, factorial(l_linenumber::integer)::bigint as f from y""")
def fn_order_statistics(t):
    x = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "case when l_orderkey % 4 = 0 then null else l_quantity end as a", "nullif(l_discount, 0) as b", "l_tax as c")
    xs = ("a", "b", "c")
    return x.select(
        "l_orderkey", "l_linenumber", F.round(numeric.range_of(*xs), 6).alias("spread"), F.round(numeric.std_of(*xs), 6).alias("sd"), numeric.smallest(2, *xs).alias("second"),
        numeric.largest(2, *xs).alias("last_but_one"), numeric.fact(F.col("l_linenumber").cast("int")).alias("f"),
    )


@query(r"""select doc_id, cast(len(regexp_extract_all(text, '[.,;]')) as integer) as marks, cast(case when regexp_matches(text, '[.,;]') then length(regexp_extract(text, '^[^.,;]*')) + 1 else 0 end as integer) as first_mark,
    cast(case when regexp_matches(text, '[0-9]+') then length(regexp_extract(text, '^[^0-9]*')) + 1 else 0 end as integer) as at, cast(length(regexp_extract(text, '[0-9]+')) as integer) as digits from documents""")
def fn_char_classes(t):
    found = patterns.prxsubstr("/[0-9]+/", "text")
    return t.documents.select("doc_id", char.countc("text", ".,;").alias("marks"), char.indexc("text", ".,;").alias("first_mark"), found["position"].alias("at"), found["length"].alias("digits"))


@query("select o_orderkey, timestamp '1960-01-01' + to_seconds(o_orderkey * 977) as at, cast((o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + 5 as double) as clock from orders")
def fn_clock(t):
    return t.orders.select("o_orderkey", dates.from_seconds(F.col("o_orderkey") * 977).alias("at"), dates.hms(F.col("o_orderkey") % 24, F.col("o_custkey") % 60, F.lit(5)).alias("clock"))


@query("""with c as (select c_custkey, radians(c_nationkey) as a, radians(c_custkey % 180) as b, radians(52.5) as p, radians(13.4) as q from customer)
    select c_custkey, round(2 * 6371.0 * asin(sqrt(power(sin((p - a) / 2), 2) + cos(a) * cos(p) * power(sin((q - b) / 2), 2))), 4) as km from c""")
def fn_distance(t):
    return t.customer.select("c_custkey", F.round(numeric.geodist_km(F.col("c_nationkey"), F.col("c_custkey") % 180, F.lit(52.5), F.lit(13.4)), 4).alias("km"))


@query(f"select kv_key from {_KV} where not contains(tags, '\"purchase\"')")
def kv_delete_tagged(t):
    store = _kv(t)
    return memory.delete_keys(store, memory.with_tag(store, "purchase")).select("kv_key")


@query(f"select kv_key from {_KV} where starts_with(kv_key, 'kv::1') and kv_key > 'kv::12' order by kv_key limit 25")
def kv_scan_page(t):
    """A page of 25 keys after a given one."""
    return memory.with_prefix(_kv(t), "kv::1", "kv::12").select("kv_key").orderBy("kv_key").limit(25)


@query("select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O')")
def interleave_set(t):
    return merge.interleave(*[t.orders.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_orderstatus") for s in "FO"], by=["o_orderkey", "o_orderstatus"])


@query("select doc_id, round(n_chars * 0.5 + coalesce(case when doc_id % 3 > 0 then doc_id % 3 end, 0) * 2.0, 6)::double as score from documents")
def weighted_sum(t):
    x = t.documents.selectExpr("doc_id", "n_chars", "case when doc_id % 3 > 0 then doc_id % 3 end as r")
    return x.select("doc_id", F.round(scoring.weighted({"n_chars": 0.5, "r": 2.0}), 6).alias("score"))


@query("select c_custkey, 2 as run, c_acctbal + 1 as score from customer where c_custkey % 3 = 0 union all select c_custkey, 1, c_acctbal from customer where c_custkey % 3 <> 0")
def history_newest(t):
    """Two runs appended to a history; the newest result of each key."""
    path = files.scratch(t.spark)
    x = t.customer.select("c_custkey", F.lit(1).alias("run"), F.col("c_acctbal").alias("score"))
    again = x.where("c_custkey % 3 = 0").select((F.col("score") + 1).alias("score"), F.lit(2).alias("run"), "c_custkey")
    for df in (x, again):
        files.append_history(df, path, ["c_custkey", "run", "score"])
    return files.latest(t.spark.read.parquet(path), "c_custkey", "run")


@query("select s_nationkey, count(*) as lines, sum(s_suppkey)::bigint as keys from supplier group by 1")
def corpus_of_files(t):
    """A file for each nation, read whole with its name as the source."""
    path = files.scratch(t.spark)
    t.supplier.select("s_nationkey", F.col("s_suppkey").cast("string").alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    keys = F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")
    read = files.read_corpus(t.spark, f"{path}/*/").select(F.regexp_extract("source_id", r"s_nationkey=(\d+)", 1).cast("int").alias("s_nationkey"), F.explode(keys.cast("array<bigint>")).alias("k"))
    return read.groupBy("s_nationkey").agg(F.count("*").alias("lines"), F.sum("k").alias("keys"))


@query("select p_partkey, p_retailprice * 2 as p_retailprice from part")
def replaced_table(t):
    """A new version beside the old one; readers take the path that comes back."""
    path = files.scratch(t.spark)
    old = files.replace_table(t.part.select("p_partkey", "p_retailprice"), path)
    new = files.replace_table(t.spark.read.parquet(old).withColumn("p_retailprice", F.col("p_retailprice") * 2), path)
    return t.spark.read.parquet(new)


@query("select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def stream_window_counts(t):
    e = stream.read_log(t.spark, t.dir, "events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.run_to_end(stream.window_counts(e, "400 days"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(ORACLES["rerank_window"].replace("doc_id % 17", "length(text) - length(replace(text, 'the', ''))"))
def hook_reranker(t):
    """The best 20 by length in the order of a user's own score."""
    score = hooks.reranker(lambda q, x: x.str.count(q) * len(q), "the")
    x = step.row_counter(t.documents.select("doc_id", "n_chars", "text"), ["-n_chars", "doc_id"], name="pos").withColumn("s", score(F.col("text")))
    return retrieval.rerank_window(x, "pos", "s", 20).select("doc_id", F.col("place").cast("int").alias("place"))
