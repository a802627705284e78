"""Queries over row steps, merges, look-ups, windows, sorting and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.functions import formats
from quarry.operators import merge, procs, step
from quarry.plans import expand, params

_R = lambda c, n=4: F.round(c, n)


@query("""with m as (select o.o_orderkey, o.o_orderstatus, o.o_totalprice, c.c_mktsegment from orders o left join customer c on o.o_custkey = c.c_custkey),
 f as (select *, o_totalprice * 0.9 as net from m where o_totalprice * 0.9 >= 1000),
 g as (select c_mktsegment, o_orderstatus, cast(3 - grouping(c_mktsegment, o_orderstatus) as integer) as _type_, count(*) as _freq_, avg(net) as mean_net from f where c_mktsegment is not null and o_orderstatus is not null group by cube(c_mktsegment, o_orderstatus)),
 r as (select *, row_number() over (partition by _type_ order by mean_net) as rn from g)
 select c_mktsegment, o_orderstatus, _type_, _freq_, round(mean_net, 4) as mean_net, avg(rn) over (partition by _type_, mean_net) as rank_net from r""")
def entry_segment_means(t):
    m = merge.match_merge(t.orders.withColumnRenamed("o_custkey", "c_custkey"), t.customer, "c_custkey", "left")
    f = m.withColumn("net", F.col("o_totalprice") * 0.9).where("net >= 1000")
    g = procs.means(f, ["c_mktsegment", "o_orderstatus"], {"mean_net": ("mean", "net")}, nway=False)
    r = procs.rank(g, "mean_net", "rank_net", ["_type_"])
    return r.select("c_mktsegment", "o_orderstatus", "_type_", "_freq_", _R("mean_net").alias("mean_net"), "rank_net")


@query("select l_orderkey as order_id, l_linenumber as line, l_quantity as qty from lineitem")
def scan_keep_drop_rename(t):
    kept = step.keep(t.lineitem, "l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return step.rename(step.drop(kept, "l_tax"), {"l_orderkey": "order_id", "l_linenumber": "line", "l_quantity": "qty"})


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem where l_shipdate < timestamp '1996-01-01'")
def where_read_time(t):
    return t.lineitem.where("l_shipdate < timestamp_ntz'1996-01-01'").select("l_orderkey", "l_linenumber", _R(F.expr("l_extendedprice * (1 - l_discount)")).alias("revenue"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem where l_extendedprice * (1 - l_discount) >= 20000")
def subsetting_if(t):
    x = t.lineitem.withColumn("revenue", F.expr("l_extendedprice * (1 - l_discount)")).where("revenue >= 20000")
    return x.select("l_orderkey", "l_linenumber", _R("revenue").alias("revenue"))


@query("select c_custkey, case when c_nationkey > 20 then 'far' when c_acctbal < 0 then 'debt' when c_acctbal > 5000 then 'rich' else 'plain' end as grade from customer")
def if_chain_independent(t):
    grade = step.independent_ifs("grade", [(F.col("c_acctbal") > 5000, F.lit("rich")), (F.col("c_acctbal") < 0, F.lit("debt")), (F.col("c_nationkey") > 20, F.lit("far"))], F.lit("plain"))
    return t.customer.select("c_custkey", grade)


@query("select c_custkey, case when c_acctbal > 5000 and c_nationkey > 12 then 3 when c_acctbal > 5000 then 2 else 1 end as level from customer")
def if_chain_dependent(t):
    x = t.customer.withColumn("level", F.lit(1))
    x = step.dependent_ifs(x, "level", [(lambda: F.col("c_acctbal") > 5000, F.lit(2)), (lambda: (F.col("level") == 2) & (F.col("c_nationkey") > 12), F.lit(3))])
    return x.select("c_custkey", "level")


@query("select l_orderkey, l_linenumber, 'price' as kind, l_extendedprice as amount from lineitem union all select l_orderkey, l_linenumber, 'discount', l_extendedprice * l_discount from lineitem where l_discount > 0")
def output_multi_rows(t):
    return step.output_rows(t.lineitem, [(None, {"kind": F.lit("price"), "amount": F.col("l_extendedprice")}), (F.col("l_discount") > 0, {"kind": F.lit("discount"), "amount": F.expr("l_extendedprice * l_discount")})], ["l_orderkey", "l_linenumber"])


@query("select 'big' as target, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem where l_quantity >= 25 union all select 'returned', count(*), round(sum(l_quantity), 2) from lineitem where l_returnflag = 'R'")
def output_routing(t):
    parts = step.route(t.lineitem, {"big": F.col("l_quantity") >= 25, "returned": F.col("l_returnflag") == "R"})
    return merge.stack(*[d.agg(F.lit(n).alias("target"), F.count("*").alias("n"), _R(F.sum("l_quantity"), 2).alias("qty")) for n, d in parts.items()])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 91 offset 9")
def obs_firstobs(t):
    return step.obs(t.orders, ["-o_totalprice", "o_orderkey"], 10, 100).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_custkey, cast(row_number() over w as integer) as _n_, cast(case when lead(1) over w is null then 1 else 0 end as integer) as eof from orders window w as (partition by o_custkey order by o_orderkey)")
def row_counter_eof(t):
    return step.row_counter(t.orders, ["o_orderkey"], ["o_custkey"], end="eof").select("o_orderkey", "o_custkey", "_n_", "eof")


@query("select o_orderkey, round(o_totalprice * 1.2, 4) as gross, round(o_totalprice * 1.2 * 0.05, 4) as fee from orders where o_totalprice * 1.2 > 50000")
def calculated_alias(t):
    x = t.orders.withColumn("gross", F.col("o_totalprice") * 1.2).withColumn("fee", F.col("gross") * 0.05)
    return x.where("gross > 50000").select("o_orderkey", _R("gross").alias("gross"), _R("fee").alias("fee"))


@query("select p_partkey, p_name[1:2] || 'ZZ' || p_name[5:] as p_name from part")
def substr_left_assign(t):
    from quarry.functions import char

    return t.part.select("p_partkey", char.assign_substr("p_name", 3, "ZZ").alias("p_name"))


@query("select l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) * 2 + 1, 4) as l_quantity, round(coalesce(l_tax, 0) * 2 + 1, 4) as l_tax, round(coalesce(l_discount, 0) * 2 + 1, 4) as l_discount from lineitem")
def array_do_loop(t):
    x = step.array_loop(t.lineitem, ["l_quantity", "l_tax", "l_discount"], lambda c: _R(F.coalesce(c, F.lit(0)) * 2 + 1))
    return x.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")


@query("select 'A' as flag, count(*) as n from lineitem where l_returnflag = 'A' union all select 'N', count(*) from lineitem where l_returnflag = 'N' union all select 'R', count(*) from lineitem where l_returnflag = 'R'")
def macro_do_expand(t):
    return expand.do_over(["A", "N", "R"], lambda f: t.lineitem.where(F.col("l_returnflag") == f).agg(F.lit(f).alias("flag"), F.count("*").alias("n")))


@query("select o_orderstatus, count(*) as n from orders group by 1")
def macro_if_branch(t):
    return expand.choose(True, lambda: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")), lambda: t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'O'")
def param_identifier(t):
    return params.run(t.spark, "select o_orderkey, o_totalprice from {orders} where IDENTIFIER(:col) > :low and o_orderstatus = :status", {"col": "o_totalprice", "low": 100000, "status": "O"}, orders=t.orders)


@query("select o_orderpriority, round(sum(o_totalprice) / (select sum(o_totalprice) from orders), 8) as share from orders group by 1")
def scalar_publish_share(t):
    total = params.publish(t.orders.agg(F.sum("o_totalprice").alias("total")))
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice") / F.lit(total["total"]), 8).alias("share"))


_CUST = "select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 <> 0"
_TXN = "select c_custkey + 1 as c_custkey, case when c_custkey % 2 = 0 then c_acctbal + 1 end as c_acctbal, c_mktsegment from customer where c_custkey % 4 = 0"


def _cust(t):
    return t.customer.where("c_custkey % 3 <> 0").select("c_custkey", "c_name", "c_acctbal")


def _txn(t):
    return t.customer.where("c_custkey % 4 = 0").selectExpr("c_custkey + 1 as c_custkey", "case when c_custkey % 2 = 0 then c_acctbal + 1 end as c_acctbal", "c_mktsegment")


@query(f"select coalesce(b.c_custkey, a.c_custkey) as c_custkey, c_name, case when b.c_custkey is not null then b.c_acctbal else a.c_acctbal end as c_acctbal, c_mktsegment from ({_CUST}) a full join ({_TXN}) b on a.c_custkey = b.c_custkey")
def merge_full_outer(t):
    return merge.match_merge(_cust(t), _txn(t), "c_custkey")


@query(f"select a.c_custkey, c_name, case when b.c_custkey is not null then b.c_acctbal else a.c_acctbal end as c_acctbal, c_mktsegment from ({_CUST}) a left join ({_TXN}) b on a.c_custkey = b.c_custkey")
def merge_if_a(t):
    return merge.match_merge(_cust(t), _txn(t), "c_custkey", "left")


@query(f"select a.c_custkey, c_name, b.c_acctbal, c_mktsegment from ({_CUST}) a join ({_TXN}) b on a.c_custkey = b.c_custkey")
def merge_if_ab(t):
    return merge.match_merge(_cust(t), _txn(t), "c_custkey", "inner")


@query(f"select cast(a.c_custkey is not null as integer) as in_a, cast(b.c_custkey is not null as integer) as in_b, count(*) as n from ({_CUST}) a full join ({_TXN}) b on a.c_custkey = b.c_custkey group by 1, 2")
def merge_in_flags(t):
    return merge.match_merge(_cust(t), _txn(t), "c_custkey", flags=("in_a", "in_b")).groupBy("in_a", "in_b").agg(F.count("*").alias("n"))


@query(f"select b.c_custkey, b.c_acctbal from ({_TXN}) b")
def merge_last_wins(t):
    return merge.match_merge(_cust(t), _txn(t), "c_custkey", "right").select("c_custkey", "c_acctbal")


@query("with s as (select s_name, row_number() over (order by s_suppkey) as r from supplier), n as (select n_name, row_number() over (order by n_nationkey) as r from nation) select s_name, n_name from s full join n using (r)")
def merge_positional_ordered(t):
    return merge.positional_merge(t.supplier.select("s_suppkey", "s_name"), t.nation.select("n_nationkey", "n_name"), "s_suppkey", "n_nationkey").select("s_name", "n_name")


@query("select r_name, n_name, count(*) as n, round(sum(o_totalprice), 2) as total from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2")
def sql_join_multi(t):
    j = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), _R(F.sum("o_totalprice"), 2).alias("total"))


@query("select r_name, n_name from region, nation")
def cross_join_explicit(t):
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))  # both tables are of fixed size


_FIRST = "select * from (select l_partkey as p_partkey, l_orderkey, l_quantity, row_number() over (partition by l_partkey order by l_orderkey nulls first, l_linenumber nulls first, l_quantity nulls first) as rn from lineitem) where rn = 1"


@query(f"select p.p_partkey, p_brand, l_orderkey, l_quantity from part p left join ({_FIRST}) f on p.p_partkey = f.p_partkey")
def hash_find_first_match(t):
    table = t.lineitem.selectExpr("l_partkey as p_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return merge.find_first(t.part.select("p_partkey", "p_brand"), table, "p_partkey", ["l_orderkey", "l_linenumber", "l_quantity"]).drop("l_linenumber")


@query("select p_partkey, p_brand, l_orderkey, l_linenumber from part left join lineitem on l_partkey = p_partkey")
def hash_multidata(t):
    return merge.find_all(t.part.select("p_partkey", "p_brand"), t.lineitem.selectExpr("l_partkey as p_partkey", "l_orderkey", "l_linenumber"), "p_partkey")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def hash_check_semi(t):
    return merge.check(t.customer.select("c_custkey", "c_name"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def hash_check_anti(t):
    return merge.check(t.customer.select("c_custkey", "c_name"), t.orders.where("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", negate=True)


@query("select event_id, user_id, cast(row_number() over (partition by user_id order by event_id) > 1 as integer) as seen from events")
def hash_seen_key(t):
    return merge.seen(t.events, "user_id", "event_id").select("event_id", "user_id", "seen")


@query("select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by 1")
def hash_output_set(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), _R(F.sum("l_quantity"), 2).alias("qty"))


@query("select n_regionkey, n_name, cast(row_number() over (partition by n_regionkey order by n_name) as integer) as step from nation")
def hiter_walk(t):
    return step.row_counter(t.nation, ["n_name"], ["n_regionkey"], "step").select("n_regionkey", "n_name", "step")


@query(f"select coalesce(a.c_custkey, b.c_custkey) as c_custkey, c_name, coalesce(b.c_acctbal, a.c_acctbal) as c_acctbal, c_mktsegment from ({_CUST}) a full join ({_TXN}) b on a.c_custkey = b.c_custkey")
def update_upsert(t):
    return merge.update(_cust(t), _txn(t), "c_custkey")


@query(f"select a.c_custkey, c_name, coalesce(b.c_acctbal, a.c_acctbal) as c_acctbal, c_mktsegment from ({_CUST}) a left join ({_TXN}) b on a.c_custkey = b.c_custkey")
def modify_matched_only(t):
    return merge.modify(_cust(t), _txn(t), "c_custkey")


@query("select o_orderkey, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end as status from orders")
def format_value_map(t):
    return t.orders.select("o_orderkey", formats.put_values("o_orderstatus", {"O": "open", "F": "filled"}, "other").alias("status"))


@query("select l_orderkey, l_linenumber, case when l_quantity < 10 then 'small' when l_quantity >= 10 and l_quantity <= 30 then 'medium' when l_quantity > 30 then 'large' end as size from lineitem")
def format_range_exclusive(t):
    ranges = [formats.Range(None, 10, "small", high_open=True), formats.Range(10, 30, "medium"), formats.Range(30, None, "large", low_open=True)]
    return t.lineitem.select("l_orderkey", "l_linenumber", formats.put_ranges("l_quantity", ranges).alias("size"))


@query("select c_custkey, coalesce(n_name, 'unknown') as nation from customer left join (select * from nation where n_nationkey < 15) on n_nationkey = c_nationkey")
def format_cntlin(t):
    return formats.put_table(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation.where("n_nationkey < 15"), "n_nationkey", "n_name", "nation", "unknown").select("c_custkey", "nation")


@query("select o_orderkey, case o_orderstatus when 'O' then 1 when 'F' then 2 else 9 end as code from orders")
def informat_reverse(t):
    return t.orders.select("o_orderkey", formats.input_values("o_orderstatus", {1: "O", 2: "F"}, 9).alias("code"))


@query("select event_id, user_id, cast(case when lag(1) over w is null then 1 else 0 end as integer) as first_user_id, cast(case when lead(1) over w is null then 1 else 0 end as integer) as last_user_id from events window w as (partition by user_id order by event_id)")
def by_first_last(t):
    return step.first_last(t.events, "user_id", "event_id").select("event_id", "user_id", "first_user_id", "last_user_id")


@query("select event_id, user_id, round(sum(coalesce(case when event_id % 5 = 0 then null else value end, 0)) over (partition by user_id order by event_id rows unbounded preceding), 4) as running from events")
def retain_running_sum(t):
    x = t.events.withColumn("value", F.expr("case when event_id % 5 = 0 then null else value end"))
    return step.running_sum(x, "value", "event_id", ["user_id"]).select("event_id", "user_id", _R("running").alias("running"))


@query("""with e as (select event_id, event_type, cast(round(value * 100) as bigint) as cents, case when event_id % 3 = 0 then user_id end as u from events)
    select event_id, (sum(cents) over w)::bigint as running, last_value(u ignore nulls) over w as held from e window w as (order by event_id rows unbounded preceding)""")
def retain_chain(t):
    """RETAIN without BY: one chain over the whole table, by ranges."""
    x = t.events.select("event_id", F.round(F.col("value") * 100).cast("long").alias("cents"), F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("u"))
    return step.carry_forward(step.running_sum(x, "cents", "event_id"), "u", "event_id", name="held").select("event_id", "running", "held")


@query("""with o as (select o_orderkey, o_custkey, o_orderstatus, lag(o_custkey, 5) over w as lag_o_custkey, lag(o_orderstatus) over w as p from orders window w as (order by o_orderkey))
    select o_orderkey, o_orderstatus, lag_o_custkey, o_custkey - lag_o_custkey as dif_o_custkey from o where p is distinct from o_orderstatus""")
def lag_chain(t):
    """LAG5 and NODUPRECS without BY: rows before, over the ends of ranges."""
    x = step.lag_dif(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderkey", n=5).drop("o_custkey")
    return step.nodup_adjacent(x, ["o_orderstatus"], "o_orderkey")


@query("select event_id, user_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as held from events")
def retain_carry_forward(t):
    x = t.events.withColumn("v", F.expr("case when event_type = 'purchase' then value end"))
    return step.carry_forward(x, "v", "event_id", ["user_id"], "held").select("event_id", "user_id", "held")


@query("select event_id, user_id, lag(value) over w as lag_value, round(value - lag(value) over w, 6) as dif_value from events window w as (partition by user_id order by event_id)")
def lag_dif(t):
    return step.lag_dif(t.events, "value", "event_id", ["user_id"]).select("event_id", "user_id", "lag_value", F.round("dif_value", 6).alias("dif_value"))


@query("select e.event_id, q.lagged from events e left join (select event_id, lag(value) over (partition by user_id order by event_id) as lagged from events where event_type = 'click') q using (event_id)")
def lag_conditional_queue(t):
    return step.lag_when(t.events, F.col("event_type") == "click", "value", ["event_id"], ["event_id"], ["user_id"]).select("event_id", "lagged")


@query("select o_orderkey, o_custkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as integer) as seq from orders")
def by_sequence(t):
    return step.row_counter(t.orders, ["o_orderdate", "o_orderkey"], ["o_custkey"], "seq").select("o_orderkey", "o_custkey", "seq")


@query("select event_id, v, row_number() over (order by v nulls first, event_id) as place from (select event_id, case when event_id % 7 = 0 then null else value end as v from events)")
def sort_missing_low(t):
    x = t.events.selectExpr("event_id", "case when event_id % 7 = 0 then null else value end as v")
    return step.row_counter(x, [F.col("v").asc_nulls_first(), "event_id"], name="place")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1")
def nodupkey_first(t):
    return step.nodupkey(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) as b, row_number() over (partition by user_id order by event_id) as rn from events) where rn = 1 or b is distinct from event_type")
def nodup_adjacent(t):
    return step.nodup_adjacent(t.events, ["user_id", "event_type"], ["event_id"], ["user_id"]).select("event_id", "user_id", "event_type")


@query("select event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn > 1")
def dupout_removed(t):
    return step.nodupkey(t.events, ["user_id", "event_type"], ["ts", "event_id"], dupout=True).select("event_id")


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id desc limit 25")
def topk_recency_tie(t):
    return step.top_k(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id", 25)


@query("select c_custkey as key, c_name as name, c_acctbal as bal, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier")
def set_union_by_name(t):
    return merge.stack(t.customer.selectExpr("c_custkey as key", "c_name as name", "c_acctbal as bal", "c_mktsegment as segment"), t.supplier.selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as bal"))


@query("select key, src, row_number() over (order by key, src) as place from (select c_custkey as key, 0 as src from customer union all select s_suppkey, 1 from supplier)")
def interleave_by(t):
    both = merge.stack(t.customer.selectExpr("c_custkey as key"), t.supplier.selectExpr("s_suppkey as key"), source="src")
    return step.row_counter(both, ["key", "src"], name="place")


@query("select l_returnflag, max(case when l_linestatus = 'F' then n end) as \"n_F\", max(case when l_linestatus = 'O' then n end) as \"n_O\" from (select l_returnflag, l_linestatus, count(*) as n from lineitem group by 1, 2) group by 1")
def transpose_wide(t):
    return merge.transpose_wide(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), "l_returnflag", "l_linestatus", "n", ["F", "O"], "n_")


@query("select l_orderkey, l_linenumber, 'l_tax' as _name_, l_tax as col1 from lineitem union all select l_orderkey, l_linenumber, 'l_discount', nullif(l_discount, 0) from lineitem")
def transpose_long(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_tax", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return merge.transpose_long(x, ["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"])
