"""Further queries over text, catalogues, metrics and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.operators import evaluation, graph, memory, merge, procs, retrieval, scoring, step, text
from quarry.plans import scripting
from quarry.sources import datasets, files, infile

_R = lambda c, n=6: F.round(c, n)


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) as a, len(regexp_extract_all(lower(text), '[a-z0-9_.]+')) as b, len(regexp_extract_all(lower(text), '[a-z0-9]+')) as c from documents")
def tokenizers(t):
    n = lambda p: F.size(retrieval.tokens(F.col("text"), p)).cast("long")
    return t.documents.select("doc_id", n(retrieval.RETRIEVAL).alias("a"), n(retrieval.METRICS).alias("b"), n(retrieval.LEAKAGE).alias("c"))


@query("select doc_id, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n\\r]+'), lambda w: w <> ''))::integer as n, (length(substr(text, 1, n_chars::integer // 2)) - length(replace(substr(text, 1, n_chars::integer // 2), chr(10), '')) + 1)::integer as line from documents")
def words_and_lines(t):
    return t.documents.select("doc_id", text.words(F.col("text")).alias("n"), text.line_of(F.col("text"), F.floor(F.col("n_chars") / 2)).alias("line"))


@query("select p_partkey, replace(replace(replace(lower(p_type), ' ', ''), '_', ''), '-', '') as lang from part")
def language_names(t):
    return t.part.select("p_partkey", text.language(F.col("p_type")).alias("lang"))


@query("select doc_id, cast((length(t) - length(replace(t, '''', ''))) = 0 and length(replace(t, '(', '')) = length(replace(t, ')', '')) and length(replace(t, '[', '')) = length(replace(t, ']', '')) and length(replace(t, '{', '')) = length(replace(t, '}', '')) as integer) as ok from (select doc_id, regexp_replace(text, '''[^'']*''', '', 'g') as t from documents)")
def balance_check(t):
    return t.documents.select("doc_id", text.balanced(F.col("text")).alias("ok"))


@query("select doc_id, regexp_matches(lower(text), 'license|password|@') as cued from documents")
def cue_gate(t):
    return t.documents.select("doc_id", text.cued(F.col("text"), ["license", "password", "@"]).alias("cued"))


@query("select n_name, case when n_regionkey = 0 then 'function:' || lower(n_name) when n_regionkey = 1 then 'procedure:' || lower(n_name) end as key from nation")
def construct_keys(t):
    title = F.when(F.col("n_regionkey") == 0, F.concat("n_name", F.lit(" Function"))).when(F.col("n_regionkey") == 1, F.concat(F.lit("The "), "n_name", F.lit(" Procedure"))).otherwise(F.col("n_name"))
    return t.nation.select("n_name", text.construct_key(title).alias("key"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'by_path' when 1 then 'exact' else 'by_library' end as kind from orders")
def mapping_kinds(t):
    s = F.when(F.col("o_orderkey") % 3 == 0, "/a/b").when(F.col("o_orderkey") % 3 == 1, "lib.t").otherwise("lib")
    return t.orders.select("o_orderkey", text.mapping_kind(s).alias("kind"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 'libname a ''/new/x/' || s_suppkey || ''';' else 'infile ''/other'';' end as new_text, 0::bigint as skipped from supplier")
def path_rewrite(t):
    body = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("libname a '/old/x/"), "s_suppkey", F.lit("';"))).otherwise("infile '/other';")
    m = t.spark.createDataFrame([("/old", "/bad"), ("/old/x", "/new/x")], "source string, target string")
    return text.rewrite_paths(t.supplier.select("s_suppkey", body.alias("body")), "s_suppkey", "body", m).select("s_suppkey", "new_text", "skipped")


@query("select s_suppkey, 'sql' as language, 'select ' || s_suppkey as code from supplier where s_suppkey % 2 = 0")
def fenced_blocks(t):
    md = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("# H\n```sql\nselect "), "s_suppkey", F.lit("\n```\nend"))).otherwise("no code")
    x = t.supplier.select("s_suppkey", F.explode(text.fences(md)).alias("f"))
    return x.select("s_suppkey", F.col("f.language"), F.rtrim("f.code", F.lit("\n")).alias("code"))


@query("select s_suppkey, s_suppkey % 2 = 0 as ok from supplier")
def python_syntax(t):
    code = F.when(F.col("s_suppkey") % 2 == 0, "x = 1\n").otherwise("x = = 1")
    return text.python_parses(t.supplier.select("s_suppkey", code.alias("code")), "s_suppkey", "code")


@query("select l_orderkey, list(x order by p, x) as names from (select l_orderkey, lower(l_returnflag) as x, min(l_linenumber) as p from lineitem group by 1, 2) group by 1")
def first_spelling(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.lower("l_returnflag").alias("name"))
    return scoring.ordered_names(x, "l_orderkey", "name", "l_linenumber")


@query("with r as (select distinct l_partkey as x from lineitem), w as (select p_partkey as x from part where p_size < 40) select x, case when x in (select x from r) and x in (select x from w) then 'intermediate' when x in (select x from r) then 'input' else 'output' end as role from (select x from r union select x from w)")
def io_roles(t):
    r = t.lineitem.select(F.col("l_partkey").alias("x"), F.lit(1).alias("r"), F.lit(0).alias("w"))
    w = t.part.where("p_size < 40").select(F.col("p_partkey").alias("x"), F.lit(0).alias("r"), F.lit(1).alias("w"))
    return scoring.io_roles(r.union(w), "x", "r", "w")


@query("select o_orderkey as key, case o_orderstatus when 'O' then 'HIGH' when 'F' then 'MEDIUM' else 'LOW' end as tier from orders order by case o_orderstatus when 'O' then 3 when 'F' then 2 else 1 end desc, o_totalprice desc, o_orderkey limit 15")
def hardest_first(t):
    x = t.orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "O", "HIGH").when(F.col("o_orderstatus") == "F", "MEDIUM").otherwise("LOW").alias("tier"), F.col("o_totalprice").alias("score"))
    return scoring.hardest(x, 15).select("key", "tier")


@query("select n_nationkey, n_regionkey, cast(row_number() over (partition by n_regionkey order by n_nationkey) as integer) as turn from nation")
def round_robin(t):
    return step.interleave_lists(t.nation, "n_regionkey", "n_nationkey").select("n_nationkey", "n_regionkey", "turn")


@query("select doc_id, round(case when quality is null then 0 else (least(greatest(quality * 7, 1), 5) - 1) / 4.0 end, 6) as score from documents left join labels using (doc_id)")
def judge_grades(t):
    x = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return x.select("doc_id", _R(evaluation.graded(F.col("quality") * 7)).alias("score"))


@query("select lang, round(least(avg(quality), avg(1 - toxic)), 6) as score from labels join documents using (doc_id) group by 1")
def summary_score(t):
    x = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return evaluation.weakest(x, "lang", F.col("quality"), 1 - F.col("toxic")).withColumn("score", _R("score"))


@query("with u as (select conv_id, count(*) as asked from conversations where role = 'user' group by 1), a as (select conv_id, count(*) as said from conversations where role = 'assistant' group by 1) select conv_id, round(least(coalesce(said, 0) / asked, 1.0), 6) as coverage from u left join a using (conv_id)")
def response_coverage(t):
    return evaluation.coverage(t.conversations, "conv_id", F.col("role") == "user", F.col("role") == "assistant").withColumn("coverage", _R("coverage"))


@query("with t as (select *, sum(case when role = 'user' or rn = 1 then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding)::bigint as k from (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)) select conv_id, k as turn_id, conv_id || '-' || k as item, max(case when role = 'user' then length(text) end)::integer as asked, sum(case when role <> 'user' then length(text) end)::bigint as answered from t group by 1, 2")
def transcript_pairs(t):
    x = memory.turns(t.conversations, "conv_id", "turn", "role")
    own = F.col("role") == "user"
    return x.groupBy("conv_id", "turn_id").agg(F.max(F.when(own, F.length("text"))).alias("asked"), F.sum(F.when(~own, F.length("text"))).alias("answered")).withColumn("item", F.concat_ws("-", "conv_id", "turn_id"))


@query("with u as (select distinct l_suppkey % 5 as source, l_partkey % 397 as name from lineitem), m as (select distinct p_size % 5 as source, p_partkey % 397 as name from part where p_partkey % 397 < 300) select u.source, list_sort(list(distinct m.source)) as depends_on, count(distinct u.name) as imports from u join m on m.name = u.name and m.source <> u.source where not exists (select 1 from m m2 where m2.source = u.source and m2.name = u.name) group by 1")
def crossfile_profile(t):
    uses = t.lineitem.selectExpr("l_suppkey % 5 as source", "l_partkey % 397 as name").distinct()
    makes = t.part.where("p_partkey % 397 < 300").selectExpr("p_size % 5 as source", "p_partkey % 397 as name").distinct()
    imported = graph.references(uses, makes, 5).where("status = 'import'").join(makes.withColumnRenamed("source", "maker"), "name")
    return imported.groupBy("source").agg(F.sort_array(F.collect_set("maker")).alias("depends_on"), F.count_distinct("name").alias("imports"))


@query("select n_name, n_regionkey from nation")
def view_stays_lazy(t):
    return datasets.view(t.nation.select("n_name", "n_regionkey"), "nation_view")


@query("select c_custkey, c_name, null::double as c_acctbal from customer union all select c_custkey, c_name, c_acctbal from customer".replace("null::double as c_acctbal from customer union all select c_custkey, c_name, c_acctbal", "c_acctbal from customer union all select c_custkey, c_name, null::double"))
def datasets_append(t):
    return datasets.append(t.customer.select("c_custkey", "c_name", "c_acctbal"), t.customer.select("c_custkey", "c_name"))


@query("select n_nationkey, n_name from nation")
def import_delimited(t):
    path = files.scratch(t.spark)
    files.write_delimited(t.nation.select("n_nationkey", "n_name"), path, "|")
    return files.read_delimited(t.spark, path, "n_nationkey int, n_name string", "|")


@query("select n_nationkey, n_name from nation")
def infile_fixed(t):
    path = files.scratch(t.spark)
    t.nation.select(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, " "), F.rpad("n_name", 25, " ")).alias("value")).write.mode("overwrite").text(path)
    return files.read_fixed(t.spark, path, {"n_nationkey": (1, 4, "int"), "n_name": (5, 25, "string")})


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate from orders")
def infile_list_flow(t):
    """Orders over one to three lines, with lines without values and values too many, read under FLOWOVER."""
    path = files.scratch(t.spark)
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    gaps = F.get(F.array(*[F.array(*map(F.lit, g)) for g in ([" "] * 4, [" ", "\n", " ", " "], ["\n", " ", "\n\n", "   "], [" ", " ", " ", "\n"])]), F.pmod("o_custkey", F.lit(4)).cast("int"))
    cells = [F.concat(F.col(name).cast("string"), F.coalesce(F.get(gaps, F.lit(i)), F.lit(""))) for i, name in enumerate(names)]
    t.orders.select(F.concat(*cells, F.when(F.pmod("o_orderkey", F.lit(3)) == 0, " too many").otherwise("")).alias("value")).write.text(path)
    return infile.read_list(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.orders.select(*names).schema))


@query("select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem")
def infile_list_held(t):
    """Line items one after another, three values a line, read with @@."""
    path = files.scratch(t.spark)
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
    cells = t.lineitem.groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array(*[F.col(name).cast("string") for name in names]))).alias("v"))
    ends = F.transform("v", lambda v, i: F.concat(v, F.when(i % 3 == 2, "\n").otherwise(" ")))
    cells.select(F.array_join(ends, "").alias("value")).write.text(path)
    return infile.read_list(t.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.lineitem.select(*names).schema), hold=True)


@query("""select c_custkey, c_name || ', "' || c_mktsegment || '"' as label, case when c_acctbal >= 0 then c_acctbal end as balance,
    case when c_custkey % 2 = 0 then c_nationkey end as nation from customer""")
def infile_list_dsd(t):
    """Quoted delimiters and quotes, empty values, and lines that end early, read with DSD under TRUNCOVER."""
    path = files.scratch(t.spark)
    label = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""'), F.col("c_mktsegment"), F.lit('"""'))
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")).otherwise("")
    nation = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(","), F.col("c_nationkey").cast("string"))).otherwise("")
    t.customer.select(F.concat(F.col("c_custkey").cast("string"), F.lit(","), label, F.lit(","), balance, nation).alias("value")).write.text(path)
    kinds = {f.name: f.dataType.simpleString() for f in t.customer.schema}
    return infile.read_list(t.spark, path, f"c_custkey {kinds['c_custkey']}, label string, balance {kinds['c_acctbal']}, nation {kinds['c_nationkey']}", ",", dsd=True, short="TRUNCOVER")


@query("select 55 as total")
def procedural_loop(t):
    return scripting.run(t.spark, "BEGIN DECLARE i INT = 0; DECLARE s INT = 0; WHILE i < 10 DO SET i = i + 1; SET s = s + i; END WHILE; SELECT s AS total; END")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2")
def label_metadata(t):
    x = step.label(t.orders, {"o_orderstatus": "Status"})
    return procs.means(x, ["o_orderstatus", "o_orderpriority"], {"n": ("n", "o_orderkey")})


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'A' union all select l_orderkey, l_linenumber, l_quantity from lineitem where l_returnflag = 'A' and l_linenumber = 1")
def print_passthrough(t):
    x = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")
    return merge.stack(x, x.where("l_linenumber = 1"))
