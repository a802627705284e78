"""Queries over dependency graphs, retrieval, memory, evaluation, sizing, text and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.catalog.base import ORACLES, query
from quarry.operators import batching, evaluation, graph, macros, memory, merge, retrieval, scoring, step, text
from quarry.sources import files
from quarry.streaming import events as stream

_R = lambda c, n=6: F.round(c, n)

# ---- graph


def _flow(t):
    e = t.events.selectExpr("user_id", "event_id", "event_type = 'signup' as makes", "event_type = 'purchase' as uses")
    return graph.nearest_preceding(e, "user_id", "event_id", "makes", "uses")


@query("select c.user_id, p.event_id as from_idx, c.event_id as to_idx from (select * from events where event_type = 'purchase') c asof join (select * from events where event_type = 'signup') p on c.user_id = p.user_id and c.event_id > p.event_id")
def asof_nearest_preceding(t):
    return _flow(t)


@query("select event_id, first_value(case when event_type <> 'view' then event_id end ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) as next_idx from events")
def next_substantive(t):
    x = t.events.withColumn("real", F.col("event_type") != "view")
    return graph.next_row(x, ["user_id"], "event_id", "real").select("event_id", "next_idx")


@query("select event_id, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as last from events")
def implicit_last(t):
    x = t.events.withColumn("made", F.expr("case when event_type = 'click' then event_id end"))
    return graph.last_before(x, ["user_id"], "event_id", "made").select("event_id", "last")


_KEYS = [("https:", "any"), ("https://example.com", "site"), ("https://example.com/page/1", "one"), ("http://x", "x")]


@query("with k(k, v) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _KEYS) + ") select p.page_id, (select arg_max(v, length(k)) from k where p.url = k or starts_with(p.url, rtrim(k, '/') || '/')) as target from pages p")
def prefix_map_longest(t):
    keys = t.spark.createDataFrame(_KEYS, "key string, value string")
    return graph.longest_prefix(t.pages.select("page_id", "url"), "url", keys, "key", "value", "target").select("page_id", "target")


@query("select p_partkey, case when p_brand = 'Brand#11' then 'gold.eleven' when p_size > 25 then 'big.' || lower(p_brand) else 'lib.' || p_brand end as target from part")
def name_map_fallback(t):
    names = t.part.select("p_partkey", F.when(F.col("p_brand") == "Brand#11", "X.Brand#11").when(F.col("p_size") > 25, F.concat(F.lit("BIG."), "p_brand")).otherwise(F.concat(F.lit("lib."), "p_brand")).alias("name"))
    exact = t.spark.createDataFrame([("x.brand#11", "gold.eleven")], "source string, target string")
    libs = t.spark.createDataFrame([("big", "big")], "source string, target string")
    return files.name_mapping(names, "name", exact, libs).select("p_partkey", "target")


#: Orders, parts and suppliers of all line items; keys of the three kinds stay apart.
_DEP = "(select distinct l_orderkey * 4 as upstream, l_partkey * 4 + 1 as downstream from lineitem union select l_partkey * 4 + 1, l_suppkey * 4 + 2 from lineitem)"


def _dep(t):
    return t.lineitem.selectExpr("l_orderkey * 4 as upstream", "l_partkey * 4 + 1 as downstream").union(t.lineitem.selectExpr("l_partkey * 4 + 1", "l_suppkey * 4 + 2")).distinct()


@query("select l_orderkey * 4 as upstream, l_partkey * 4 + 1 as downstream, list_sort(list(distinct l_returnflag)) as subjects from lineitem group by 1, 2")
def dep_edges(t):
    e = t.lineitem.select((F.col("l_orderkey") * 4).alias("src"), (F.col("l_partkey") * 4 + 1).alias("dst"), F.col("l_returnflag").alias("subject"), F.lit("export").alias("kind"))
    return graph.fold_edges(e.union(e.select("dst", "src", "subject", F.lit("import"))))


@query("select o_orderkey as node, -1000000000000 - c_nationkey as component from orders join customer on c_custkey = o_custkey union select -1 - c_custkey, -1000000000000 - c_nationkey from customer union select distinct -1000000000000 - c_nationkey, -1000000000000 - c_nationkey from customer")
def components(t):
    return graph.components(t.orders.selectExpr("o_orderkey as a", "-1 - o_custkey as b").union(t.customer.selectExpr("-1 - c_custkey", "-1000000000000 - c_nationkey")))


_WEAK = "(select distinct l_partkey as src, l_suppkey as dst from lineitem)"


@query(f"with e as (select src, src % 20 as p, dst % 7 as c from {_WEAK}) select p as producer_root, count(distinct c) as consumers, case when count(distinct c) = 1 then 'absorb' else 'promote' end as decision from e where p <> c group by 1")
def weak_edges_promote(t):
    weak = t.lineitem.selectExpr("l_partkey as src", "-1 - l_suppkey as dst").distinct()  # keys of suppliers and parts stay apart
    parts = weak.selectExpr("src as node", "src % 20 as component").distinct().union(weak.selectExpr("dst as node", "(-1 - dst) % 7 as component").distinct())
    return graph.promote_weak(weak, parts)


@query(ORACLES["weak_edges_promote"])
def weak_edges_promote_all(t):
    return weak_edges_promote(t)


@query("select node, cast(max(layer) as integer) as layer from (select l_orderkey * 4 as node, 0 as layer from lineitem union select l_partkey * 4 + 1, 1 from lineitem union select l_suppkey * 4 + 2, 2 from lineitem) group by 1")
def kahn_layers(t):
    return graph.layers(_dep(t))


@query("select o_orderkey * 5 + k as node, o_orderkey * 5 as cycle from orders, range(0, 4) r(k)")
def graph_cycles(t):
    n = t.orders.select((F.col("o_orderkey") * 5).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return graph.cycles_near(n.selectExpr("n + k as upstream", "n + case when k = 4 then 0 else (k + 1) % 4 end as downstream"))


@query(f"with e as {_DEP}, n as (select upstream as node from e union select downstream from e) select node, cast(node not in (select downstream from e) as integer) as is_root, cast(node not in (select upstream from e) as integer) as is_leaf from n")
def roots_leaves(t):
    return graph.roots_leaves(_dep(t))


@query("with u as (select distinct l_suppkey % 5 as source, l_partkey % 40 as name from lineitem), m as (select distinct p_size % 5 as source, p_partkey % 40 as name from part where p_partkey % 40 < 30) select u.source, u.name, case when max(cast(m.source = u.source as integer)) = 1 then 'own' when count(m.source) > 0 then 'import' else 'unresolved' end as status from u left join m on m.name = u.name group by 1, 2")
def crossfile_refs(t):
    uses = t.lineitem.selectExpr("l_suppkey % 5 as source", "l_partkey % 40 as name")
    makes = t.part.where("p_partkey % 40 < 30").selectExpr("p_size % 5 as source", "p_partkey % 40 as name")
    return graph.references(uses, makes, 5)


@query("with e as (select n_regionkey as a, n_nationkey % 5 as b, n_name as s from nation) select a as upstream, b as downstream, list_sort(list(distinct s)) as subjects from e group by 1, 2")
def graph_fold(t):
    e = t.nation.selectExpr("n_regionkey as src", "n_nationkey % 5 as dst", "n_name as subject", "'export' as kind")
    mirrored = t.nation.selectExpr("n_nationkey % 5 as src", "n_regionkey as dst", "n_name as subject", "'import' as kind")
    return graph.fold_edges(e.union(mirrored))


# ---- packing and retrieval


@query("with n as (select conv_id, turn, length(text) < 120 as alone from conversations), f as (select *, case when not alone or not coalesce(lag(alone) over w, false) then 1 else 0 end as fresh from n window w as (partition by conv_id order by turn)), g as (select *, sum(fresh) over (partition by conv_id order by turn) as island from f), h as (select *, (row_number() over (partition by conv_id, island order by turn) - 1) % 4 = 0 as cut from g) select conv_id, turn, cast(sum(cut::int) over (partition by conv_id order by turn) - 1 as bigint) as batch from h")
def singleton_runs(t):
    x = t.conversations.select("conv_id", "turn", (F.length("text") < 120).alias("alone"))
    return batching.runs(x, ["conv_id"], "turn", "alone", 4, "batch").select("conv_id", "turn", "batch")


_FOLD = "with recursive x as (select conv_id, turn, length(text)::bigint as size, row_number() over (partition by conv_id order by {order}) as k from conversations), "
_OVER = "r.used + x.size > 400 or r.n >= 8"


@query(_FOLD.format(order="turn") + f"r(conv_id, k, batch, used, n) as (select conv_id, k, 0::bigint, size, 1 from x where k = 1 union all select x.conv_id, x.k, case when {_OVER} then r.batch + 1 else r.batch end, case when {_OVER} then x.size else r.used + x.size end, case when {_OVER} then 1 else r.n + 1 end from r join x on x.conv_id = r.conv_id and x.k = r.k + 1) select conv_id, turn, size, batch from r join x using (conv_id, k)")
def pack_greedy(t):
    x = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return retrieval.pack_windows(x, "conv_id", "turn", "size", 400, 8)


@query(_FOLD.format(order="length(text) desc, turn") + "r(conv_id, k, take, room) as (select conv_id, k, size <= 500, case when size <= 500 then 500 - size else 500 end from x where k = 1 union all select x.conv_id, x.k, x.size <= r.room, case when x.size <= r.room then r.room - x.size else r.room end from r join x on x.conv_id = r.conv_id and x.k = r.k + 1) select conv_id, turn, size from r join x using (conv_id, k) where take")
def pack_best_first(t):
    x = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return retrieval.pack_best_first(x, "conv_id", F.struct(-F.col("size"), "turn").asc(), "size", 500)


_BM = """with d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') as tk from documents), s as (select count(*) as n, avg(len(tk)) as a from d),
 tf as (select doc_id, len(tk) as l, w, count(*) as tf from (select doc_id, tk, unnest(tk) as w from d) where w in ('the', 'license', 'and') group by 1, 2, 3), df as (select w, count(*) as df from tf group by 1),
 sc as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * l / a))) as score from tf join df using (w), s group by 1)"""


def _bm(t):
    return retrieval.bm25(t.documents, "doc_id", "text", "The license and")


@query(_BM + " select doc_id, round(score, 6) as score from sc")
def bm25_topk(t):
    return _bm(t).select("doc_id", _R("score").alias("score"))


_COS = "(select e.vec_id as doc_id, list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))) as score from embeddings e, (select embedding from embeddings where vec_id = 7) q)"


def _cos(t):
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))
    return retrieval.cosine(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", q)


@query(f"select doc_id, round(score, 5) as score from {_COS} order by score desc, doc_id limit 20")
def cosine_topk(t):
    return retrieval.ranked(_cos(t), "doc_id", 20, later_wins=False).select("doc_id", _R("score", 5).alias("score"))


@query(_BM + f", a as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id desc) as r from sc qualify r <= 30), b as (select doc_id, row_number() over (order by round(score, 9) desc, doc_id desc) as r from {_COS} qualify r <= 30) select doc_id, round(sum(1.0 / (60 + r)), 9) as score from (select * from a union all select * from b) group by 1")
def rrf_hybrid(t):
    a, b = (retrieval.ranked(x.withColumn("score", F.round("score", 9)), "doc_id", 30) for x in (_bm(t), _cos(t)))
    return retrieval.fuse(a, b, key="doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query("select page_id, round(case when contains(lower(url), 'page') then 2.0 else 0.0 end + (length(html) - length(replace(lower(html), 'page', ''))) / 4.0 + 0.0, 4) as score from pages")
def keyword_score(t):
    return t.pages.select("page_id", F.round(retrieval.keyword_score(F.col("url"), F.col("html"), F.array().cast("array<string>"), ["Page"]), 4).alias("score"))


@query("with r as (select doc_id, cast(row_number() over (order by n_chars desc, doc_id) as integer) as pos, doc_id % 17 as s from documents) select doc_id, cast(row_number() over (order by case when pos <= 20 then 0 else 1 end, case when pos <= 20 then -s end, pos) as integer) as place from r")
def rerank_window(t):
    x = step.row_counter(t.documents.select("doc_id", "n_chars"), ["-n_chars", "doc_id"], name="pos").withColumn("s", F.expr("doc_id % 17"))
    return retrieval.rerank_window(x, "pos", "s", 20).select("doc_id", F.col("place").cast("int").alias("place"))


@query(ORACLES["rerank_window"])
def rerank_window_all(t):
    return rerank_window(t).withColumn("place", F.col("place").cast("long"))


@query("with a as (select conv_id, turn, length(text) as s, row_number() over (partition by conv_id order by turn desc) as tl from conversations), b as (select *, row_number() over (partition by conv_id, tl <= 2 order by s desc, turn desc) as bs from a) select conv_id, turn from b where tl <= 2 or bs <= 1")
def history_select(t):
    x = t.conversations.select("conv_id", "turn", F.length("text").alias("s"))
    return retrieval.select_history(x, "conv_id", "turn", "s", 2, 1).select("conv_id", "turn")


# ---- memory


@query("select conv_id, turn, sum(case when role = 'user' or rn = 1 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as turn_id from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)")
def turn_groups(t):
    return memory.turns(t.conversations, "conv_id", "turn", "role").select("conv_id", "turn", "turn_id")


@query("with a as (select conv_id, turn, length(text) // 4 as s, row_number() over (partition by conv_id order by turn desc) as e from conversations), b as (select *, sum(case when e > 2 then s else 0 end) over (partition by conv_id) as p from a) select conv_id, turn, cast(e > 2 and p >= 60 as integer) as folded from b")
def rolling_frontier(t):
    return memory.frontier(t.conversations, "conv_id", "turn", evaluation.token_estimate(F.col("text")), 60, 2).select("conv_id", "turn", "folded")


@query("select event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where ts >= timestamp '2024-01-05') where rn <= 10")
def retention_newest_n(t):
    x = t.events.where("ts >= timestamp_ntz'2024-01-05'")
    return memory.newest(x, "user_id", [F.col("ts"), F.col("event_id")], 10).select("event_id")


@query("select event_id from (select *, row_number() over (partition by user_id order by event_id) as rn from events) where rn <= 5")
def rewind_oldest_n(t):
    return memory.rewind(t.events, "user_id", [F.col("event_id")], 5).select("event_id")


@query("select cast(9999 as bigint) as conv_id, turn, role from (select *, row_number() over (order by turn) as rn from conversations where conv_id = 3) where rn <= 3")
def thread_fork(t):
    return memory.fork(t.conversations, "conv_id", 3, 9999, "turn", 3).select("conv_id", "turn", "role")


@query("select event_id from events where event_id % 4 = 0 or ts + interval 3 day > timestamp '2024-01-20'")
def ttl_live_notes(t):
    x = t.events.withColumn("expires", F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("interval 3 days")))
    return memory.live_notes(x, "expires", F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")).select("event_id")


@query("select conv_id, turn from (select *, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as s from conversations) where s <= 300")
def tail_overlap(t):
    return memory.tail_overlap(t.conversations, "conv_id", "turn", F.length("text"), 300).select("conv_id", "turn")


@query("select event_id from (select *, min(case when event_type = 'purchase' then event_id end) over (partition by user_id) as b from events) where b is null or event_id < b")
def ledger_resume(t):
    return memory.completed(t.events, "user_id", "event_id", F.col("event_type") != "purchase").select("event_id")


def _kv(t):
    return t.events.selectExpr("concat('kv::', user_id, '_', event_type, '%', event_id % 3) as kv_key", "props as value", "concat('[\"', event_type, '\"]') as tags", "cast(event_id as double) as created_at", "cast(event_id as double) as updated_at", "'log' as source").groupBy("kv_key").agg(*[F.max_by(c, "created_at").alias(c) for c in ("value", "tags", "source")], F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


_KV = "(select 'kv::' || user_id || '_' || event_type || '%' || event_id % 3 as kv_key, arg_max(props, event_id) as value, '[\"' || arg_max(event_type, event_id) || '\"]' as tags, min(event_id)::double as created_at, max(event_id)::double as updated_at, 'log' as source from events group by 1)"


@query(f"with s as {_KV}, n as (select case when user_id % 2 = 0 then kv_key else kv_key || 'new' end as kv_key, 'v' as value from (select *, cast(regexp_extract(kv_key, '([0-9]+)_', 1) as integer) as user_id from s)) select coalesce(n.kv_key, s.kv_key) as kv_key, coalesce(n.value, s.value) as value, s.tags, coalesce(created_at, 1e6) as created_at, case when n.kv_key is not null then 1e6 else updated_at end as updated_at, s.source from s full join n on s.kv_key = n.kv_key")
def kv_upsert(t):
    s = _kv(t)
    user = F.regexp_extract("kv_key", "([0-9]+)_", 1).cast("int")
    n = s.select(F.when(user % 2 == 0, F.col("kv_key")).otherwise(F.concat("kv_key", F.lit("new"))).alias("kv_key"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("tags"), F.lit(None).cast("string").alias("source"))
    return memory.upsert(s, n, 1e6)


@query(f"select kv_key from {_KV} where not starts_with(kv_key, 'kv::1_')")
def kv_prefix_delete(t):
    return memory.delete_prefix(_kv(t), "kv::1_").select("kv_key")


@query(f"select tag, count(*) as n from (select unnest(from_json(tags, '[\"varchar\"]')) as tag from {_KV}) group by 1")
def kv_tags(t):
    return memory.all_tags(_kv(t))


# ---- evaluation


@query("select conv_id, sum(length(text) // 4)::bigint + 3 * count(*) + 3 as tokens from conversations group by 1")
def token_estimate(t):
    return evaluation.message_tokens(t.conversations, "conv_id", "text")


@query("""with p as (select item_id, b.text as a, (select text from documents where doc_id = item_id) as b from benchmark b), x as (select item_id, w, count(*) as x from (select item_id, unnest(regexp_extract_all(lower(a), '[a-z0-9_.]+')) as w from p) group by 1, 2), y as (select item_id, w, count(*) as y from (select item_id, unnest(regexp_extract_all(lower(b), '[a-z0-9_.]+')) as w from p) group by 1, 2),
 j as (select item_id, sum(least(coalesce(x, 0), coalesce(y, 0))) as c, sum(x) as nx, sum(y) as ny from x full join y using (item_id, w) group by 1) select p.item_id, round(coalesce(2.0 * (c / ny) * (c / nx) / nullif(c / ny + c / nx, 0), 0), 6) as f1 from p left join j using (item_id)""")
def token_f1(t):
    p = t.benchmark.select("item_id", F.col("text").alias("a")).join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("b")), "item_id", "left")
    return evaluation.token_f1(p, "item_id", "a", "b").select("item_id", _R("f1").alias("f1"))


@query("with d as (select conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') as k from conversations), w as (select conv_id, turn, unnest(range(1, greatest(len(k) - 2, 1) + 1)) as i, k from d) select conv_id, turn, round(max((least(len(list_filter(k[i:i+2], lambda x: x = 'the')), 1) + least(len(list_filter(k[i:i+2], lambda x: x = 'of')), 1) + least(len(list_filter(k[i:i+2], lambda x: x = 'and')), 1)) / 3.0), 6) as overlap from w group by 1, 2")
def leakage_window(t):
    x = t.conversations.select(F.struct("conv_id", "turn").alias("key"), "text")
    return evaluation.leakage(x, "key", "text", "the of and").select("key.conv_id", "key.turn", _R("overlap").alias("overlap"))


@query("select doc_id, round((contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'zzz')::int) / 3.0, 6) as score from documents")
def required_terms(t):
    return t.documents.select("doc_id", _R(evaluation.required_terms(F.col("text"), ["The", "LICENSE", "zzz"])).alias("score"))


@query("select doc_id, cast(contains(lower(text), 'work.the') or regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') as integer) as hit from documents")
def mentions_boundary(t):
    return t.documents.select("doc_id", evaluation.mentioned(F.col("text"), "work.the").cast("int").alias("hit"))


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k, cast(event_type = 'purchase' as integer) as rel from events), c as (select *, sum(rel) over (partition by user_id order by k rows unbounded preceding) as u from r) select user_id, round(coalesce(sum(case when rel = 1 then u / k else 0.0 end) / nullif(sum(rel), 0), 0), 6) as score from c group by 1")
def weighted_precision(t):
    x = step.row_counter(t.events, ["event_id"], ["user_id"], "k").withColumn("rel", (F.col("event_type") == "purchase").cast("int"))
    return evaluation.contextual_precision(x, "user_id", "k", "rel").select("user_id", _R("score").alias("score"))


@query("select lang, round(avg(case when quality = 1 then 1.0 else 0.0 end), 6) as score from labels join documents using (doc_id) group by 1")
def verdict_ratio(t):
    x = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").withColumn("v", F.when(F.col("quality") == 1, "yes").otherwise("no"))
    return evaluation.verdict_ratio(x, "lang", "v", ["yes", "idk"]).select("lang", _R("score").alias("score"))


@query("select doc_id % 50 as case_id, round(coalesce(avg(case when toxic = 0 then quality::double end), 1.0), 6) as score, bool_and(toxic = 1 or quality >= 0.5) as passed from labels group by 1")
def report_rollup(t):
    x = t.labels.select((F.col("doc_id") % 50).alias("case_id"), F.col("quality").cast("double").alias("score"), F.lit(0.5).alias("threshold"), (F.col("toxic") == 1).alias("skipped"))
    return evaluation.roll_up(x, "case_id").select("case_id", _R("score").alias("score"), "passed")


@query("with recursive p as (select a.conv_id, a.turn as l, b.turn as r, 1 - abs(length(a.text) - length(b.text)) / greatest(length(a.text), length(b.text)) as score from conversations a join conversations b on a.conv_id = b.conv_id and a.role = 'user' and b.role = 'assistant'), x as (select *, row_number() over (partition by conv_id order by score desc, l, r) as k from p where score >= 0.6), f(conv_id, k, n, ul, ur) as (select conv_id, k, 1, [l], [r] from x where k = 1 union all select x.conv_id, x.k, case when list_contains(ul, l) or list_contains(ur, r) then n else n + 1 end, case when list_contains(ul, l) or list_contains(ur, r) then ul else list_append(ul, l) end, case when list_contains(ul, l) or list_contains(ur, r) then ur else list_append(ur, r) end from f join x on x.conv_id = f.conv_id and x.k = f.k + 1), m as (select conv_id, max(n) as n from f group by 1), s as (select conv_id, count(*) filter (role = 'user') as a, count(*) filter (role = 'assistant') as b from conversations group by 1) select conv_id, round(case when a + b = 0 then 1.0 else 2.0 * coalesce(n, 0) / (a + b) end, 6) as score from s left join m using (conv_id)")
def greedy_match_f1(t):
    pairs = t.conversations.alias("a").join(t.conversations.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.role") == "user") & (F.col("b.role") == "assistant"))
    x = pairs.select(F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("l"), F.col("b.turn").alias("r"), (1 - F.abs(F.length("a.text") - F.length("b.text")) / F.greatest(F.length("a.text"), F.length("b.text"))).alias("score"))
    sizes = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("l"), F.count_if(F.col("role") == "assistant").alias("r"))
    return evaluation.match_f1(evaluation.greedy_matches(x, "conv_id", "l", "r", "score", 0.6), sizes, "conv_id", "l", "r").withColumn("score", F.round("score", 6))


# ---- sizing

_N = "least(greatest((ln(1 + x) - ln(1 + 87.5 * {lo})) / (ln(1 + 87.5 * {hi}) - ln(1 + 87.5 * {lo})), 0), 1)"
_BL = "least(1, 0.88 * " + _N.format(lo=0.35, hi=2.4).replace("x)", "n_chars / 40.0)", 1) + " + 0.5 * " + _N.format(lo=0.35, hi=1.4).replace("x)", "n_chars / 60.0)", 1) + " + 0.2 * " + _N.format(lo=0.0, hi=0.5).replace("x)", "(doc_id % 5)::double)", 1) + ")"


@query(f"select doc_id, round(2 * power(4, {_BL}), 2) as points, case when round(2 * power(4, {_BL}), 2) <= 2.5 then 'SMALL' when round(2 * power(4, {_BL}), 2) <= 4 then 'MEDIUM' when round(2 * power(4, {_BL}), 2) <= 6.5 then 'LARGE' else 'EXTRA_LARGE' end as size from documents")
def file_size_points(t):
    p = scoring.points(scoring.blend(F.col("n_chars") / 40.0, F.col("n_chars") / 60.0, (F.col("doc_id") % 5).cast("double")))
    return t.documents.select("doc_id", p.alias("points"), scoring.band(p).alias("size"))


@query("with d(f) as (values (1.0),(2.0),(3.0),(5.0),(8.0),(13.0),(21.0),(34.0),(55.0),(89.0),(144.0),(233.0),(377.0)) select doc_id, (select arg_min(f::double, abs(ln(f::double / least(greatest(n_chars / 10.0, 1), 377))) order by f) from d) as points from documents".replace(" order by f)", ")"))
def fibonacci_snap(t):
    return t.documents.select("doc_id", scoring.snap(F.col("n_chars") / 10.0).alias("points"))


@query("select o_custkey, count(distinct d) as lines from (select o_custkey, unnest(range(o_orderkey % 200, o_orderkey % 200 + 20)) as d from orders) group by 1")
def line_span_union(t):
    x = t.orders.selectExpr("o_custkey", "o_orderkey % 200 as s", "o_orderkey % 200 + 19 as e")
    return scoring.covered_lines(x, "o_custkey", "s", "e")


@query("with s as (select distinct l_orderkey, l_shipdate is null as z, l_returnflag from lineitem) select l_orderkey, case when max(case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end) = 3 then 'HIGH' when max(case l_returnflag when 'R' then 3 when 'A' then 2 else 1 end) = 2 then 'MEDIUM' else 'LOW' end as tier, sum(case l_returnflag when 'R' then 5.0 when 'A' then 2.5 else 1.0 end)::double as score from s group by 1")
def signal_rollup(t):
    x = t.lineitem.select("l_orderkey", "l_returnflag", F.when(F.col("l_returnflag") == "R", "HIGH").when(F.col("l_returnflag") == "A", "MEDIUM").otherwise("LOW").alias("tier"))
    return scoring.roll_up_signals(x, "l_orderkey", "l_returnflag", "tier")


@query("select coalesce(c.k, p.k) as k, coalesce(c.tier, p.tier) as tier, p.parity from (select n_name as k, 'LOW' as tier, 'DIRECT' as parity from nation where n_nationkey < 20) p full join (select n_name as k, case when n_nationkey % 2 = 0 then 'HIGH' end as tier from nation where n_nationkey > 10) c on p.k = c.k")
def catalogue_inherit(t):
    p = t.nation.where("n_nationkey < 20").selectExpr("n_name as k", "'LOW' as tier", "'DIRECT' as parity")
    return scoring.inherit(p, t.nation.where("n_nationkey > 10").selectExpr("n_name as k", "case when n_nationkey % 2 = 0 then 'HIGH' end as tier"), "k")


# ---- text


@query("select doc_id % 10 as doc, doc_id as page, 'body ' || doc_id as text from documents")
def running_headers(t):
    x = t.documents.select((F.col("doc_id") % 10).alias("doc"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("body "), "doc_id", F.lit("\n17"))).otherwise(F.concat(F.lit("head\nbody "), "doc_id")).alias("text"))
    return text.running_headers(x, "doc", "page", "text")


@query()
def running_headers_all(t):
    x = t.documents.select(F.coalesce("source", F.lit("")).alias("doc"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return text.running_headers(x, "doc", "page", "text")


@query()
def html_sections(t):
    return text.html_sections(t.pages, "page_id", "html")


@query()
def para_windows(t):
    return text.paragraph_windows(t.documents, "doc_id", "text")


#: A program for each customer: statements (# is the customer's key) with what is to be found in them: text, comment?, chunk, kind, reads, writes.
_STATEMENTS = [
    ("/* load; it's # */\n", True, 1, None, [], []),
    ("%let cut = #;\n", False, 2, "GLOBAL_STATEMENT", [], []),
    ("data work.big# (keep=id x) lib.side#; ", False, 3, "DATA_STEP", [], ["lib.side#", "work.big#"]),
    ("merge raw# (in=a where=(x > 1)) lib.other (in=b) end=eof; ", False, 3, None, ["lib.other", "work.raw#"], []),
    ("by id; ", False, 3, None, [], []),
    ("note = 'retain; set z'; ", False, 3, None, [], []),
    ("if amount >= &cut then do i = 1 to 3; ", False, 3, None, [], []),
    ("end; ", False, 3, None, [], []),
    ("run;\n", False, 3, "STEP_BOUNDARY", [], []),
    ("proc sort data=work.big#; ", False, 4, "PROC_STEP", ["work.big#"], ["work.big#"]),
    ("by id; ", False, 4, None, [], []),
    ("run;\n", False, 4, "STEP_BOUNDARY", [], []),
    ("proc sql; ", False, 5, "PROC_STEP", [], []),
    ("create table sum# as select a.id from big# a, lib.dim b left join extra c on a.id = c.id; ", False, 5, None, ["lib.dim", "work.big#", "work.extra"], ["work.sum#"]),
    ("quit;\n", False, 5, "STEP_BOUNDARY", [], []),
    ("%load(sum#, 'x)y', out=fin#);\n", False, 6, "MACRO_CALL", [], []),
    ("proc means data=inv# sum; ", False, 7, "PROC_STEP", ["work.inv#"], []),
    ("var x; ", False, 7, None, [], []),
    ("run;\n", False, 7, "STEP_BOUNDARY", [], []),
]


def _sql(v):
    return "null" if v is None else str(v).lower() if isinstance(v, (bool, int)) else "[" + ", ".join(map(_sql, v)) + "]::varchar[]" if isinstance(v, list) else "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_EXPECTED = f"(select c_custkey as k, u.*, replace(t, '#', c_custkey::varchar) as text from customer, (values {', '.join(f'({i}, {", ".join(map(_sql, x))})' for i, x in enumerate(_STATEMENTS, 1))}) u(no, t, comment, chunk, kind, reads, writes))"


def _programs(t):
    body = F.replace(F.lit("".join(x[0] for x in _STATEMENTS)), F.lit("#"), F.col("c_custkey").cast("string"))
    return t.customer.select(F.col("c_custkey").cast("string").alias("source_id"), body.alias("text"))


def _chunk_rows(t):
    return text.chunks(text.units(_programs(t))).withColumnRenamed("chunk_no", "idx")


@query(f"select k::varchar as source_id, no as unit_no, coalesce(sum(length(text)) over (partition by k order by no rows between unbounded preceding and 1 preceding), 0)::integer as start_char, sum(length(text)) over (partition by k order by no)::integer as end_char, text, comment as is_comment, true as terminated, false as unclosed_comment from {_EXPECTED}")
def lex_units(t):
    return text.units(_programs(t))


@query(f"select k::varchar as source_id, chunk as chunk_no, case when bool_or(comment) then 'COMMENT_BLOCK' else arg_min(kind, no) end as kind, min(no) as first_unit, max(no) as last_unit, min(a)::integer as start_char, max(b)::integer as end_char, string_agg(text, '' order by no) as text from (select *, coalesce(sum(length(text)) over (partition by k order by no rows between unbounded preceding and 1 preceding), 0) as a, sum(length(text)) over (partition by k order by no) as b from {_EXPECTED}) group by 1, 2")
def chunk_program(t):
    return text.chunks(text.units(_programs(t)))


@query(f"select distinct k::varchar as source_id, chunk as chunk_no, case when chunk = 3 then ['do_loop', 'merge'] else [] end as constructs, case when chunk in (3, 4, 5, 7) then 1 else 0 end as steps from {_EXPECTED}")
def detect_constructs(t):
    return text.chunks(text.units(_programs(t))).select("source_id", "chunk_no", text.constructs(F.col("text")).alias("constructs"), text.step_count(F.col("text")).alias("steps"))


def _named(column):
    return f"list_transform({column}, lambda x: replace(x, '#', k::varchar))"


@query(f"select k::varchar as source_id, no as unit_no, kind, {_named('reads')} as reads, {_named('writes')} as writes from {_EXPECTED} where not comment")
def metadata_extract(t):
    reads, writes = text.datasets(F.col("text"))
    u = text.units(_programs(t)).where("not is_comment")
    return u.select("source_id", "unit_no", text.kind(F.col("text")).alias("kind"), reads.alias("reads"), writes.alias("writes"))


_CHAIN = "(values (3, 4, 'dataset_flow', 'work.big#'), (4, 5, 'dataset_flow', 'work.big#'), (2, 3, 'macro_var_flow', 'cut'), (5, 6, 'macro_arg_dataset', 'work.sum#')) e(f, g, kind, subject)"


@query(f"select c_custkey::varchar as source_id, f as from_idx, g as to_idx, kind, replace(subject, '#', c_custkey::varchar) as subject from customer, {_CHAIN}")
def chunk_edges(t):
    return batching.edges(batching.described(_chunk_rows(t)))


@query("select c_custkey::varchar as source_id, i as idx, r as role, b as batch_no from customer, (values (1, 'context', 1), (2, 'member', 1), (3, 'member', 1), (4, 'member', 1), (5, 'member', 1), (6, 'member', 1), (7, 'member', 2)) v(i, r, b)")
def program_batches(t):
    rows = batching.described(_chunk_rows(t))
    return batching.batches(rows, batching.edges(rows))


@query("select doc_id, i as part, i * 900 as start, substr(text, i * 900 + 1, 1000) as text from (select doc_id, text, unnest(range(0, greatest(ceil((length(text) - 100) / 900.0)::integer, 1))) as i from documents)")
def oversized_split(t):
    return text.split_oversized(t.documents, ["doc_id"], "text", 1000, 100)


_TIDY = r"regexp_replace(regexp_replace(regexp_replace(translate(html, '‘’“”–—' || chr(160), chr(39) || chr(39) || chr(34) || chr(34) || '-- '), '(\w)-\n(\w)', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"select page_id, sha256({_TIDY}) as tidy from pages")
def text_normalise(t):
    return t.pages.select("page_id", F.sha2(text.tidy(F.col("html")).cast("binary"), 256).alias("tidy"))


@query("with p as (select distinct 'a/' || p_size || '/' || p_brand as path from part), e as (select path, path as e3, regexp_replace(path, '^[^/]*/', '') as e2, regexp_replace(path, '^.*/', '') as e1 from p) select path, case when count(*) over (partition by e1) = 1 then e1 else e2 end as name from e")
def shortest_suffix(t):
    return text.shortest_suffix(t.part.select(F.concat(F.lit("a/"), "p_size", F.lit("/"), "p_brand").alias("path")), "path")


@query("select doc_id, case when doc_id % 4 = 0 then 'uncached' when doc_id % 4 = 1 then 'stale' else 'fresh' end as status from documents union all select -1, 'missing'")
def extraction_cache(t):
    f = t.documents.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    m = t.documents.where("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 4 == 1, "old").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    m = m.union(t.spark.createDataFrame([("-1", "x")], "name string, sha string"))
    return files.cache_status(f, m).select(F.col("name").cast("long").alias("doc_id"), "status")


@query("select user_id, count(*) as n, round(sum(cast(json_extract(props, '$.k') as bigint)), 2) as total from events group by 1".replace("round(sum(cast(json_extract(props, '$.k') as bigint)), 2)", "cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint)"))
def usage_totals(t):
    return t.events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# ---- streams


@query("with g as (select *, case when lag(ts) over w is null or ts >= lag(ts) over w + interval 30 minute then 1 else 0 end as s from events window w as (partition by user_id order by ts)), n as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, count(*) as n, round(sum(value), 4) as total from n group by user_id, k")
def stream_session_counts(t):
    e = stream.read_log(t.spark, t.dir, "events.parquet", t.events.schema)
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.run_to_end(stream.session_counts(e), "complete")
    return out.select("user_id", "n", F.round("total", 4).alias("total"))


@query("select distinct user_id, event_type from events")
def stream_ttl(t):
    e = stream.read_log(t.spark, t.dir, "events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.run_to_end(stream.first_within(e, ["user_id", "event_type"], "400 days")).select("user_id", "event_type")


# ---- macros and guidance


@query(f"select distinct k::varchar as source_id, chunk as idx, case when chunk = 2 then ['cut'] else [] end as made, case when chunk = 3 then ['cut'] else [] end as used, null::varchar as macro, []::varchar[] as parameters from {_EXPECTED}")
def macro_variables(t):
    c = _chunk_rows(t)
    return c.select("source_id", "idx", macros.produced(F.col("text")).alias("made"), macros.consumed(F.col("text"), macros.signature(F.col("text"))).alias("used"), macros.macro_name(F.col("text")).alias("macro"), macros.signature(F.col("text")).alias("parameters"))


@query("select c_custkey::varchar as source_id, 'load' as macro, p as pos, q as param, replace(v, '#', c_custkey::varchar) as value from customer, (values (1, null, 'sum#'), (2, null, chr(39) || 'x)y' || chr(39)), (3, 'out', 'fin#')) a(p, q, v)")
def macro_calls(t):
    return macros.calls(_chunk_rows(t).where("kind = 'MACRO_CALL'"), "source_id")


@query("select l_orderkey as to_idx, m.from_idx, cast(l_suppkey as varchar) as macro from (select distinct l_orderkey, l_suppkey from lineitem) join (select l_suppkey as s, max(l_orderkey) as from_idx from lineitem where l_linenumber = 1 group by 1) m on m.s = l_suppkey")
def macro_invocation(t):
    c = t.lineitem.selectExpr("l_orderkey as idx", "cast(l_suppkey as string) as macro")
    return macros.invocations(c, t.lineitem.where("l_linenumber = 1").selectExpr("l_orderkey as idx", "cast(l_suppkey as string) as macro"))


@query("select idx, direction, name from (select o_orderkey as idx, 'in' as direction, 'work.' || lower(o_orderstatus) as name from orders union select o_orderkey, 'out', 'lib.fixed' from orders)")
def macro_body_io(t):
    c = t.orders.selectExpr("o_orderkey as idx", "'m' as macro", "1 as pos", "cast(null as string) as param", "o_orderstatus as value")
    b = t.spark.createDataFrame([("m", "in", 1, None, "src"), ("m", "out", 0, "lib.fixed", None)], "macro string, direction string, pos int, name string, param string")
    return macros.resolve_bodies(c, b)


@query("select c_custkey as item_id, p_size as chunk_id, cast(min(case when p_partkey % 2 = 0 then 0 else 4 end) as integer) as tier_no from customer join part on p_size % 25 = c_nationkey group by 1, 2")
def guidance_gates(t):
    from quarry.operators import guidance

    none = F.array().cast("array<string>")
    chunks = t.part.select(F.col("p_size").alias("chunk_id"), F.when(F.col("p_partkey") % 2 == 0, "user_rule").otherwise("construct").alias("tier"), none.alias("langs"), none.alias("kinds"), F.array((F.col("p_size") % 25).cast("string")).alias("constructs"))
    items = t.customer.select(F.col("c_custkey").alias("item_id"), F.lit("x").alias("lang"), F.lit("k").alias("kind"), F.array(F.col("c_nationkey").cast("string")).alias("constructs"))
    return guidance.gated(chunks, items)


@query("select user_id as instruction from (select user_id, event_type, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn = 1 and event_type = 'click'")
def approval_queue(t):
    from quarry.operators import guidance

    q = t.events.select(F.col("user_id").alias("instruction"), F.when(F.col("event_type") == "click", "approved").otherwise("pending").alias("status"), F.col("event_id").alias("seq"))
    return guidance.standing(q)


@query("select conv_id, substr(sha256(string_agg(n || '. ' || text, chr(10) order by turn)), 1, 16) as fingerprint from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by 1")
def content_fingerprint(t):
    from quarry.operators import guidance

    return guidance.fingerprint(t.conversations, "conv_id", "turn", "text")


@query("select event_id, user_id, bool_and(event_type <> 'purchase') over (partition by user_id) as attributed from events")
def cells_attributed(t):
    from quarry.operators import guidance

    return guidance.whole_items(t.events.withColumn("ok", F.col("event_type") != "purchase"), "user_id", "ok").select("event_id", "user_id", "attributed")
