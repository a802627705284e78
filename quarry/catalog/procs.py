"""Queries over summary procedures and scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.functions import char, dates, numeric, patterns
from quarry.operators import merge, procs

_R = lambda c, n=4: F.round(c, n)


@query("select l_returnflag, l_linestatus, count(l_quantity) as n, round(sum(l_quantity), 2) as qty, round(avg(l_extendedprice), 4) as price, round(stddev_samp(l_tax), 8) as tax_std from lineitem group by 1, 2")
def means_nway(t):
    x = procs.means(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": ("n", "l_quantity"), "qty": ("sum", "l_quantity"), "price": ("mean", "l_extendedprice"), "tax_std": ("std", "l_tax")})
    return x.select("l_returnflag", "l_linestatus", "n", _R("qty", 2).alias("qty"), _R("price").alias("price"), _R("tax_std", 8).alias("tax_std"))


@query("select l_returnflag, l_linestatus, cast(3 - grouping(l_returnflag, l_linestatus) as integer) as _type_, count(*) as _freq_, round(sum(l_quantity), 2) as qty from lineitem group by cube(l_returnflag, l_linestatus)")
def means_all_types(t):
    x = procs.means(t.lineitem, ["l_returnflag", "l_linestatus"], {"qty": ("sum", "l_quantity")}, nway=False)
    return x.select("l_returnflag", "l_linestatus", "_type_", "_freq_", _R("qty", 2).alias("qty"))


@query("select l_returnflag, l_linestatus, cast(3 - grouping(l_returnflag, l_linestatus) as integer) as _type_, count(*) as _freq_, max(l_quantity) as top from lineitem group by grouping sets ((), (l_linestatus))".replace("select l_returnflag, l_linestatus, cast(3 - grouping(l_returnflag, l_linestatus) as integer)", "select cast(null as varchar) as l_returnflag, l_linestatus, cast(1 - grouping(l_linestatus) as integer)"))
def means_types_list(t):
    return procs.means(t.lineitem, ["l_returnflag", "l_linestatus"], {"top": ("max", "l_quantity")}, types=[[], ["l_linestatus"]]).select("l_returnflag", "l_linestatus", "_type_", "_freq_", "top")


@query("select s, n, 'kept' as policy from (select nullif(c_mktsegment, 'BUILDING') as s, count(*) as n from customer group by 1) union all select s, n, 'dropped' from (select nullif(c_mktsegment, 'BUILDING') as s, count(*) as n from customer where c_mktsegment <> 'BUILDING' group by 1)")
def means_missing_class(t):
    x = t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), "c_acctbal")
    both = [procs.means(x, ["s"], {"n": ("n", "c_acctbal")}, missing=m).withColumn("policy", F.lit(p)) for m, p in ((True, "kept"), (False, "dropped"))]
    return merge.stack(*both)


@query("select l_returnflag, count(nullif(l_discount, 0)) as n, count(*) - count(nullif(l_discount, 0)) as nmiss from lineitem group by 1")
def n_vs_nmiss(t):
    x = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    return procs.means(x, ["l_returnflag"], {"n": ("n", "d"), "nmiss": ("nmiss", "d")})


@query("select o_orderstatus, count(*) as count, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from orders group by 1")
def freq_oneway(t):
    return procs.freq(t.orders, ["o_orderstatus"]).select("o_orderstatus", "count", _R("percent", 6).alias("percent"))


@query("select o_orderstatus, o_orderpriority, count(*) as count, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from orders group by 1, 2")
def freq_crosstab(t):
    return procs.freq(t.orders, ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "count", _R("percent", 6).alias("percent"))


@query("select event_type, count(*) as count, row_number() over (order by count(*) desc, event_type) as place from events group by 1")
def freq_order_freq(t):
    from quarry.operators import step

    return step.row_counter(procs.freq(t.events, ["event_type"]), ["-count", "event_type"], name="place").select("event_type", "count", "place")


@query("select e, count(*) as count from (select nullif(event_type, 'view') as e from events) group by 1")
def freq_missing_option(t):
    return procs.freq(t.events.select(F.nullif("event_type", F.lit("view")).alias("e")), ["e"], missing=True).select("e", "count")


@query("""with m as (select avg(l_extendedprice) as mu, count(*) as n from lineitem), d as (select l_extendedprice - mu as d, n from lineitem, m)
 select count(l_extendedprice) as n, round(avg(l_extendedprice), 4) as mean, round(stddev_samp(l_extendedprice), 4) as std, round(var_samp(l_extendedprice), 2) as var, min(l_extendedprice) as min, max(l_extendedprice) as max, round(sum(l_extendedprice), 2) as sum, round(quantile_cont(l_extendedprice, 0.5), 4) as median, max(l_extendedprice) - min(l_extendedprice) as range,
 (select round((sum(d*d*d)/count(*)) / power(sum(d*d)/count(*), 1.5), 6) from d) as skew, (select round((sum(d*d*d*d)/count(*)) / power(sum(d*d)/count(*), 2) - 3, 6) from d) as kurt, cast(0 as bigint) as nmiss from lineitem""")
def univariate_moments(t):
    out = procs.means(t.lineitem, [], {s: (s, "l_extendedprice") for s in ("n", "mean", "std", "var", "min", "max", "sum", "median", "range", "skew", "kurt", "nmiss")})
    digits = {"mean": 4, "std": 4, "var": 2, "sum": 2, "median": 4, "skew": 6, "kurt": 6}
    return out.select(*[_R(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


@query("select l_returnflag, round(quantile_cont(l_quantity, 0.01), 4) as p1, round(quantile_cont(l_quantity, 0.25), 4) as p25, round(quantile_cont(l_quantity, 0.975), 4) as p97_5 from lineitem group by 1")
def univariate_percentiles(t):
    x = procs.means(t.lineitem, ["l_returnflag"], {p: (p, "l_quantity") for p in ("p1", "p25", "p97_5")})
    return x.select("l_returnflag", *[_R(p).alias(p) for p in ("p1", "p25", "p97_5")])


@query("select l_quantity as mode, n as count from (select l_quantity, count(*) as n from lineitem group by 1) order by n desc, l_quantity limit 1")
def univariate_mode(t):
    return procs.mode(t.lineitem, "l_quantity")


@query()
def univariate_percentile_approx(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 1000).alias("approx"))


@query("select l_returnflag, l_linestatus, cast(3 - grouping(l_returnflag, l_linestatus) as integer) as _type_, count(*) as _freq_, round(avg(l_discount), 6) as disc from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag))")
def tabulate_crossings(t):
    x = procs.means(t.lineitem, ["l_returnflag", "l_linestatus"], {"disc": ("mean", "l_discount")}, types=[["l_returnflag", "l_linestatus"], ["l_returnflag"]])
    return x.select("l_returnflag", "l_linestatus", "_type_", "_freq_", _R("disc", 6).alias("disc"))


@query("select l_returnflag, round(sum(case when l_linestatus = 'F' then l_quantity end), 2) as \"F\", round(sum(case when l_linestatus = 'O' then l_quantity end), 2) as \"O\", round(coalesce(sum(l_quantity), 0), 2) as both_ from lineitem group by 1")
def report_across(t):
    x = procs.report_across(t.lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], "l_quantity", computed={"both_": F.coalesce("F", F.lit(0.0)) + F.coalesce("O", F.lit(0.0))})
    return x.select("l_returnflag", _R("F", 2).alias("F"), _R("O", 2).alias("O"), _R("both_", 2).alias("both_"))


@query("select o_orderkey, o_orderpriority from orders where o_totalprice > 200000")
def fedsql(t):
    return t.spark.sql("select o_orderkey, o_orderpriority from {o} where o_totalprice > 200000", o=t.orders)


_B = "select p_partkey, case when p_partkey % 10 = 0 then 'X' else p_brand end as p_brand, case when p_partkey % 7 = 0 then null else p_retailprice + case when p_partkey % 11 = 0 then 0.001 else 0 end end as p_retailprice from part where p_partkey % 13 <> 0 union all select p_partkey, p_brand, p_retailprice from part where p_partkey = 5"


def _base(t):
    return t.part.select("p_partkey", "p_brand", "p_retailprice")


def _changed(t):
    x = t.part.where("p_partkey % 13 <> 0").selectExpr("p_partkey", "case when p_partkey % 10 = 0 then 'X' else p_brand end as p_brand", "case when p_partkey % 7 = 0 then null else p_retailprice + case when p_partkey % 11 = 0 then 0.001D else 0D end end as p_retailprice")
    return x.unionByName(_base(t).where("p_partkey = 5"))


@query(f"(select *, 'BASE' as side from (select p_partkey, p_brand, p_retailprice from part except all ({_B}))) union all (select *, 'COMPARE' as side from (({_B}) except all select p_partkey, p_brand, p_retailprice from part))")
def compare_rows_except_all(t):
    return merge.compare_rows(_base(t), _changed(t))


_PAIR = f"(select a.p_partkey, a.p_brand as b1, b.p_brand as b2, a.p_retailprice as r1, b.p_retailprice as r2 from part a join ({_B}) b on a.p_partkey = b.p_partkey)"


@query(f"select p_partkey, 'p_brand' as variable from {_PAIR} where b1 is distinct from b2 union all select p_partkey, 'p_retailprice' from {_PAIR} where r1 is distinct from r2")
def compare_values_null_safe(t):
    return merge.compare_values(_base(t), _changed(t), "p_partkey", ["p_brand", "p_retailprice"]).select("p_partkey", "variable")


@query(f"select p_partkey, 'p_retailprice' as variable from {_PAIR} where case when r1 is null or r2 is null then r1 is distinct from r2 else abs(r1 - r2) > 0.01 end")
def compare_criterion(t):
    return merge.compare_values(_base(t), _changed(t), "p_partkey", ["p_retailprice"], 0.01).select("p_partkey", "variable")


@query(f"select p_partkey, p_brand, p_retailprice from part intersect all ({_B})")
def intersect_all(t):
    return _base(t).intersectAll(_changed(t))


@query("select * from (values ('o_orderkey', 'bigint', 1), ('o_custkey', 'bigint', 2), ('o_orderstatus', 'string', 3), ('o_totalprice', 'double', 4), ('o_orderdate', 'timestamp_ntz', 5), ('o_orderpriority', 'string', 6)) v(name, type, varnum), (select null::varchar as label)")
def contents_schema(t):
    return merge.contents(t.orders)


@query("select * from (values ('o_orderpriority', 'string', null), ('o_totalprice', 'double', 'decimal(18,2)')) v(name, base, compare)")
def schema_diff(t):
    return merge.schema_diff(t.orders, t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).drop("o_orderpriority"))


@query("select count(*) as n_rows, round(sum(o_totalprice), 2) as sum_o_totalprice, count(distinct o_custkey) as distinct_o_custkey from orders")
def equivalence_checks(t):
    x = procs.equivalence(t.orders, ["o_totalprice"], ["o_custkey"])
    return x.withColumn("sum_o_totalprice", _R("sum_o_totalprice", 2))


_HALF = "(select l_orderkey, l_linenumber, l_linestatus, case when l_orderkey % 9 = 0 then null else l_quantity end as q from lineitem)"


def _half(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_linestatus", "case when l_orderkey % 9 = 0 then null else l_quantity end as q")


def _rank_query(name, sql, ties):
    @query(f"select l_orderkey, l_linenumber, case when q is not null then {sql} end as r from {_HALF}", name=name)
    def run(t):
        return procs.rank(_half(t), "q", "r", ["l_linestatus"], ties, fixed=True).select("l_orderkey", "l_linenumber", F.col("r").cast("double").alias("r") if ties == "MEAN" else F.col("r").cast("long").alias("r"))


_P = "(partition by l_linestatus, q is null order by q)"
_rank_query("rank_ties_low", f"rank() over {_P}", "LOW")
_rank_query("rank_ties_dense", f"dense_rank() over {_P}", "DENSE")
_rank_query("rank_ties_high", "count(*) over (partition by l_linestatus, q is null order by q range unbounded preceding)", "HIGH")
_rank_query("rank_ties_mean", f"(rank() over {_P} + count(*) over (partition by l_linestatus, q is null order by q range unbounded preceding)) / 2.0::double", "MEAN")


@query("select c_custkey, cast(ntile(10) over (order by c_acctbal, c_custkey) - 1 as integer) as decile from customer")
def rank_groups_deciles(t):
    return procs.rank_groups(t.customer, "c_acctbal", 10, ["c_custkey"], "decile").select("c_custkey", "decile")


@query("select c_custkey, round(100 * percent_rank() over (partition by c_mktsegment order by c_acctbal), 6) as pct from customer")
def rank_percent(t):
    return procs.rank_percent(t.customer, "c_acctbal", "pct", ["c_mktsegment"]).select("c_custkey", _R("pct", 6).alias("pct"))


@query("select c_custkey, round((c_acctbal - avg(c_acctbal) over w) / nullif(stddev_samp(c_acctbal) over w, 0) * 10 + 50, 5) as c_acctbal from customer window w as (partition by c_mktsegment)")
def standardize_zscore(t):
    return procs.standardize(t.customer, ["c_acctbal"], ["c_mktsegment"], 50, 10).select("c_custkey", _R("c_acctbal", 5).alias("c_acctbal"))


@query("select c_custkey, round(coalesce(b, avg(b) over (partition by c_mktsegment)), 4) as b from (select *, case when c_custkey % 6 = 0 then null else c_acctbal end as b from customer)")
def standardize_replace(t):
    x = t.customer.withColumn("b", F.expr("case when c_custkey % 6 = 0 then null else c_acctbal end"))
    return procs.standardize(x, ["b"], ["c_mktsegment"], replace_only=True).select("c_custkey", _R("b").alias("b"))


# ---- scalar functions


@query("select p_partkey, upper(p_name) as up, lower(p_name) as low, substr(p_name, 2, 4) as part, trim('  ' || p_brand || ' ') as s, rtrim('  ' || p_brand || ' ') as r, ltrim('  ' || p_brand || ' ') as l, replace(p_type, 'A', 'aa') as w, coalesce(nullif(p_brand, 'Brand#11'), p_name) as c from part")
def fn_char(t):
    padded = F.concat(F.lit("  "), "p_brand", F.lit(" "))
    return t.part.select("p_partkey", char.upcase("p_name").alias("up"), char.lowcase("p_name").alias("low"), char.substr("p_name", 2, 4).alias("part"), char.strip(padded).alias("s"), char.trim(padded).alias("r"), char.left(padded).alias("l"), char.tranwrd("p_type", "A", "aa").alias("w"), F.coalesce(F.nullif("p_brand", F.lit("Brand#11")), "p_name").alias("c"))


_WORDS = "list_filter(regexp_split_to_array(text, '[ .<(+&!$*);\\^\\-/,%|]+'), lambda w: w <> '')"


@query(f"select doc_id, {_WORDS}[1] as w1, {_WORDS}[3] as w3, {_WORDS}[-1] as last, cast(len({_WORDS}) as integer) as n from documents")
def fn_scan(t):
    return t.documents.select("doc_id", char.scan("text", 1).alias("w1"), char.scan("text", 3).alias("w3"), char.scan("text", -1).alias("last"), char.countw("text").alias("n"))


@query("select p_partkey, replace(p_name, ' ', '') as c1, regexp_replace(p_name, '[aeiou]', '', 'g') as c2, regexp_replace(p_name, '[^0-9]', '', 'g') as c3, regexp_replace(p_name, ' +', ' ', 'g') as c4 from part")
def fn_compress(t):
    return t.part.select("p_partkey", char.compress("p_name").alias("c1"), char.compress("p_name", "aeiou").alias("c2"), char.compress("p_name", "0123456789", keep=True).alias("c3"), char.compbl("p_name").alias("c4"))


@query("select c_custkey, c_name || coalesce(s, '') as a, rtrim(c_name || ' ') || rtrim(coalesce(s, '')) as b, trim(c_name) || trim(coalesce(s, '')) as c, concat_ws('-', trim(c_name), nullif(trim(s), '')) as d from (select c_custkey, c_name, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then ' ' else c_mktsegment end as s from customer)")
def fn_cat(t):
    x = t.customer.selectExpr("c_custkey", "c_name", "case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then ' ' else c_mktsegment end as s")
    return x.select("c_custkey", char.cat("c_name", "s").alias("a"), char.catt(F.concat("c_name", F.lit(" ")), "s").alias("b"), char.cats("c_name", "s").alias("c"), char.catx("-", "c_name", "s").alias("d"))


@query("select c_custkey, cast(coalesce(greatest(length(rtrim(s)), 1), 1) as integer) as a, cast(coalesce(length(rtrim(s)), 0) as integer) as b, cast(length(s) as integer) as c from (select c_custkey, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '  ' else c_mktsegment || ' ' end as s from customer)")
def fn_length(t):
    x = t.customer.selectExpr("c_custkey", "case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then '  ' else c_mktsegment || ' ' end as s")
    return x.select("c_custkey", char.length("s").alias("a"), char.lengthn("s").alias("b"), char.lengthc("s").alias("c"))


@query("select p_partkey, cast(instr(p_name, 'a') as integer) as i, cast(instr(lower(p_name), 'part') as integer) as f, cast(case when instr(p_name[3:], 'a') > 0 then instr(p_name[3:], 'a') + 2 else 0 end as integer) as g, cast(length(p_name) - length(replace(p_name, 'a', '')) as integer) as n from part")
def fn_index_find(t):
    return t.part.select("p_partkey", char.index("p_name", "a").alias("i"), char.find("p_name", "PART", ignore_case=True).alias("f"), char.find("p_name", "a", 3).alias("g"), char.count_of("p_name", "a").alias("n"))


@query("select p_partkey, translate(p_name, 'abc', 'xyz') as a, replace(p_name, 'a', 'AA') as b from part")
def fn_translate(t):
    return t.part.select("p_partkey", char.translate("p_name", "xyz", "abc").alias("a"), char.tranwrd("p_name", "a", "AA").alias("b"))


@query("select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') as p from part")
def fn_prop(t):
    return t.part.select("p_partkey", char.propcase("p_type").alias("p"))


@query("select l_orderkey, l_linenumber, round(round(l_extendedprice / 25) * 25, 4) as u, round(round(l_tax / 0.05) * 0.05, 6) as v from lineitem")
def fn_round_unit(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", _R(numeric.round_unit("l_extendedprice", 25)).alias("u"), _R(numeric.round_unit("l_tax", 0.05), 6).alias("v"))


@query("select l_orderkey, l_linenumber, cast(trunc(l_quantity - 25.5) as bigint) as i, l_orderkey % 7 as m, (0 - l_orderkey) % 7 as d, cast(ceil(l_extendedprice) as bigint) as c, cast(floor(l_extendedprice) as bigint) as f from lineitem")
def fn_int_mod(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", numeric.int_(F.col("l_quantity") - 25.5).alias("i"), numeric.mod("l_orderkey", F.lit(7)).alias("m"), numeric.mod(-F.col("l_orderkey"), F.lit(7)).alias("d"), F.ceil("l_extendedprice").alias("c"), F.floor("l_extendedprice").alias("f"))


_ROW = "(select l_orderkey, l_linenumber, case when l_orderkey % 4 = 0 then null else l_quantity end as a, nullif(l_discount, 0) as b, case when l_orderkey % 4 = 0 then null else l_tax end as c from lineitem)"
_N = "((a is not null)::int + (b is not null)::int + (c is not null)::int)"
_S = "(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))"


@query(f"select l_orderkey, l_linenumber, {_N} as n, 3 - {_N} as nmiss, case when {_N} > 0 then round({_S}, 6) end as s, case when {_N} > 0 then round({_S} / {_N}, 6) end as m, greatest(a, b, c) as hi, least(a, b, c) as lo, round(list_median([a, b, c]), 6) as med from {_ROW}".replace("list_median([a, b, c])", "list_aggregate([a, b, c], 'median')"))
def fn_rowstats(t):
    x = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "case when l_orderkey % 4 = 0 then null else l_quantity end as a", "nullif(l_discount, 0) as b", "case when l_orderkey % 4 = 0 then null else l_tax end as c")
    xs = ("a", "b", "c")
    return x.select("l_orderkey", "l_linenumber", numeric.n_of(*xs).alias("n"), numeric.nmiss_of(*xs).alias("nmiss"), _R(numeric.sum_of(*xs), 6).alias("s"), _R(numeric.mean_of(*xs), 6).alias("m"), numeric.max_of(*xs).alias("hi"), numeric.min_of(*xs).alias("lo"), _R(numeric.median_of(*xs), 6).alias("med"))


@query("select l_orderkey, l_linenumber, cast(d is null as integer) as miss, case when d is null then -1 when d > 0.05 then 1 else 0 end as flag from (select l_orderkey, l_linenumber, nullif(l_discount, 0) as d from lineitem)")
def fn_missing_ifn(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return x.select("l_orderkey", "l_linenumber", numeric.missing("d").alias("miss"), numeric.ifn(F.col("d") > 0.05, 1, 0, -1).alias("flag"))


@query("select l_orderkey, l_linenumber, case when l_discount <> 0 then round(l_tax / l_discount, 6) end as q, try_cast(l_returnflag as double) as d, try_cast(cast(l_linenumber as varchar) as double) as n from lineitem")
def fn_safe_arith(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", _R(numeric.divide("l_tax", "l_discount"), 6).alias("q"), F.col("l_returnflag").try_cast("double").alias("d"), F.col("l_linenumber").cast("string").try_cast("double").alias("n"))


@query("select o_orderkey, cast(date_diff('day', date '1960-01-01', cast(o_orderdate as date)) as integer) as n, cast(date '1960-01-01' + cast(o_orderkey % 30000 as integer) as date) as d from orders")
def fn_date_epoch(t):
    return t.orders.select("o_orderkey", dates.to_days(F.col("o_orderdate").cast("date")).alias("n"), dates.from_days(F.col("o_orderkey") % 30000).alias("d"))


@query("select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(day(o_orderdate) as integer) as d, cast(quarter(o_orderdate) as integer) as q, cast(make_date(year(o_orderdate), month(o_orderdate), 1) as date) as first, cast(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) as double) as tp from orders")
def fn_date_parts(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.quarter(d).alias("q"), dates.mdy(F.month(d), F.lit(1), F.year(d)).alias("first"), dates.timepart(d).alias("tp"))


@query("select o_orderkey, cast(date_trunc('month', o_orderdate) + interval 2 month as date) as m, cast(date_trunc('quarter', o_orderdate) + interval 6 month - interval 1 day as date) as q, cast(date_trunc('year', o_orderdate) - interval 1 year as date) as y, cast(cast(o_orderdate as date) + 10 as date) as d, cast(cast(o_orderdate as date) - dayofweek(o_orderdate)::int + 21 as date) as w from orders")
def fn_intnx(t):
    return t.orders.select("o_orderkey", dates.intnx("MONTH", "o_orderdate", 2).alias("m"), dates.intnx("QTR", "o_orderdate", 1, "END").alias("q"), dates.intnx("YEAR", "o_orderdate", -1).alias("y"), dates.intnx("DAY", "o_orderdate", 10).alias("d"), dates.intnx("WEEK", "o_orderdate", 3).alias("w"))


@query("select l_orderkey, l_linenumber, cast(date_diff('month', o_orderdate, l_shipdate) as integer) as m, cast(date_diff('year', o_orderdate, l_shipdate) as integer) as y, cast(date_diff('quarter', o_orderdate, l_shipdate) as integer) as q, cast(date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as integer) as d from lineitem join orders on o_orderkey = l_orderkey")
def fn_intck(t):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select("l_orderkey", "l_linenumber", *[dates.intck(k, "o_orderdate", "l_shipdate").alias(a) for k, a in (("MONTH", "m"), ("YEAR", "y"), ("QTR", "q"), ("DAY", "d"))])


@query("select o_orderkey, cast(dayofweek(o_orderdate) + 1 as integer) as wd from orders")
def fn_weekday(t):
    return t.orders.select("o_orderkey", dates.weekday("o_orderdate").alias("wd"))


@query("select o_orderkey, upper(strftime(o_orderdate, '%d%b%Y')) as a, strftime(o_orderdate, '%Y%m%d') as b, cast(o_orderdate as date) as c, cast(null as date) as e from orders")
def fn_date_formats(t):
    a = dates.put_date("o_orderdate", "DATE9.")
    return t.orders.select("o_orderkey", a.alias("a"), dates.put_date("o_orderdate", "YYMMDDN8.").alias("b"), dates.input_date(a, "DATE9.").alias("c"), dates.input_date("o_orderpriority", "YYMMDD10.").alias("e"))


@query("select o_orderkey, cast(strftime(o_orderdate, '%m-%d') in ('01-01', '12-25') and year(o_orderdate) between 1992 and 1999 as integer) as holiday from orders")
def fn_holiday_calendar(t):
    calendar = [dt.date(y, m, d) for y in range(1992, 2000) for m, d in ((1, 1), (12, 25))]
    return t.orders.select("o_orderkey", dates.holiday(F.col("o_orderdate").cast("date"), calendar).alias("holiday"))


@query("select doc_id, cast(case when regexp_matches(text, '(?i)the') then strpos(lower(text), 'the') else 0 end as integer) as m, regexp_replace(text, '[0-9]+', '#', 'g') as c, regexp_extract(text, '([a-z]+)@([a-z]+)', 2) as p from documents")
def fn_prx(t):
    return t.documents.select("doc_id", patterns.prxmatch("/the/i", "text").alias("m"), patterns.prxchange("s/[0-9]+/#/", -1, "text").alias("c"), patterns.prxposn("/([a-z]+)@([a-z]+)/", 2, "text").alias("p"))


@query("select p_partkey, md5(p_name) as m, sha256(p_name) as s, sha256(rpad(p_name, 60, ' ')) as padded from part")
def fn_hash(t):
    return t.part.select("p_partkey", *[F.lower(char.hashing(k, x)).alias(n) for n, k, x in (("m", "MD5", F.col("p_name")), ("s", "SHA256", F.col("p_name")), ("padded", "SHA256", F.rpad("p_name", 60, " ")))])


@query("select p_partkey, cast(p_size as varchar) as a, try_cast(p_brand as double) as b, printf('%05d', p_size) as z from part")
def fn_put_input(t):
    return t.part.select("p_partkey", char.put("p_size").alias("a"), char.input_number("p_brand").alias("b"), char.put("p_size", 5, zeros=True).alias("z"))


@query("select p_partkey, cast(case when regexp_matches(p_brand, '[0-9]') then strpos(p_brand, regexp_extract(p_brand, '[0-9]')) else 0 end as integer) as d, cast(case when regexp_matches(p_brand, '[^A-Za-z]') then strpos(p_brand, regexp_extract(p_brand, '[^A-Za-z]')) else 0 end as integer) as n from part")
def fn_class_scans(t):
    return t.part.select("p_partkey", char.any_of("digit", "p_brand").alias("d"), char.not_of("alpha", "p_brand").alias("n"))


@query("select c_custkey, round(c_acctbal * 0.01 / (1 - power(1.01, -12)), 6) as p, round(c_acctbal / 1.1 + c_nationkey / power(1.1, 2), 6) as v, round(c_acctbal * power(1.03, 5), 6) as f from customer")
def fn_finance(t):
    return t.customer.select("c_custkey", _R(numeric.pmt(0.01, 12, "c_acctbal"), 6).alias("p"), _R(numeric.npv(0.1, "c_acctbal", "c_nationkey"), 6).alias("v"), _R(numeric.compound("c_acctbal", 0.03, 5), 6).alias("f"))
