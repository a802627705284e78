"""Further queries: batches, conversations, rewriting, scalar functions and extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.base import ORACLES, query
from quarry.catalog.corpus import _EXPECTED, _chunk_rows, _programs
from quarry.functions import char, dates, hooks
from quarry.operators import batching, evaluation, memory, step, text
from quarry.plans import params

_MSG = "(select 'msg::' || user_id || '::' || lpad(event_id::varchar, 9, '0') as kv_key, event_type as value, '[\"thread:' || user_id || '\",\"' || event_type || '\"]' as tags, epoch(ts)::double as created_at, epoch(ts)::double as updated_at, 'log' as source from events)"


def _messages(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    key = F.concat(F.lit("msg::"), "user_id", F.lit("::"), F.lpad(F.col("event_id").cast("string"), 9, "0"))
    tags = F.concat(F.lit('["thread:'), "user_id", F.lit('","'), "event_type", F.lit('"]'))
    return t.events.select(key.alias("kv_key"), F.col("event_type").alias("value"), tags.alias("tags"), at.alias("created_at"), at.alias("updated_at"), F.lit("log").alias("source"))


@query("select c_custkey::varchar as source_id, b as batch_no, list_transform(i, lambda x: replace(x, '#', c_custkey::varchar)) as inputs, list_transform(o, lambda x: replace(x, '#', c_custkey::varchar)) as outputs from customer, (values (1, ['lib.dim', 'lib.other', 'work.extra', 'work.raw#'], ['lib.side#', 'work.big#', 'work.sum#']), (2, ['work.inv#'], []::varchar[])) v(b, i, o)")
def batch_inputs_outputs(t):
    rows = batching.described(_chunk_rows(t))
    return batching.batch_io(rows, batching.batches(rows, batching.edges(rows)))


@query("select c_custkey::varchar as source_id, b as batch_no, k as kinds, m as made, []::varchar[] as used, []::varchar[] as macros, n as n_chunks from customer, (values (1, ['COMMENT_BLOCK', 'DATA_STEP', 'GLOBAL_STATEMENT', 'MACRO_CALL', 'PROC_STEP'], ['cut'], 6), (2, ['PROC_STEP'], [], 1)) v(b, k, m, n)")
def batch_metadata(t):
    rows = batching.described(_chunk_rows(t))
    return batching.merged_metadata(rows, batching.batches(rows, batching.edges(rows)))


@query(f"select k::varchar as source_id, case when chunk = 7 then 2 else 1 end as batch_no, count(distinct chunk) as n_chunks, substr(string_agg(text, '' order by no), 1, 10) as head, sum(length(text))::integer as size from {_EXPECTED} group by 1, 2")
def batch_extraction(t):
    rows = batching.described(_chunk_rows(t))
    got = batching.batch_texts(rows, batching.batches(rows, batching.edges(rows)))
    return got.select("source_id", "batch_no", "n_chunks", F.substring("text", 1, 10).alias("head"), F.length("text").alias("size"))


@query("select c_custkey::varchar as source_id, i as idx, (row_number() over (order by c_nationkey, c_custkey::varchar, i))::bigint as item_no from customer, (values (1), (2), (3), (4), (5), (6), (7)) v(i)")
def flatten_items(t):
    files = t.customer.select(F.col("c_custkey").cast("string").alias("source_id"), F.col("c_nationkey").alias("file_rank"))
    return batching.flattened(_chunk_rows(t), files).select("source_id", "idx", "item_no")


@query("select s_suppkey::varchar as source_id, c as code, case c when 'unclosed_comment' then 10 when 'unterminated' then 8 when 'open_macro' then 0 else 0 end as at from (select s_suppkey, case s_suppkey % 5 when 0 then 'unclosed_comment' when 1 then 'unterminated' when 2 then 'open_macro' when 3 then 'no_statement' end as c from supplier) where c is not null")
def program_diagnostics(t):
    bodies = ["data a; x /* open", "data a; run", "%macro m; data a; run;", "/* a remark */", "data a; run;"]
    body = F.get(F.array(*map(F.lit, bodies)), (F.col("s_suppkey") % 5).cast("int"))
    programs = t.supplier.select(F.col("s_suppkey").cast("string").alias("source_id"), body.alias("text"))
    return text.diagnostics(text.units(programs), programs)


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'create table new.t as select * from new.s' || s_suppkey || ' a join other b on a.x = ''from old.t'' -- from old.t' when 1 then 'select old.t from q x, new.s' || s_suppkey || ' as s, new.t left join r on p(old.t)' else 'df = spark.table(\"new.t\").join(spark.read.table(''q''), \"old.t\").write.saveAsTable(\"r\")' end as new_text from supplier")
def table_rewrite(t):
    """Lists, names in Python, and p, q, r that become q, r and p."""
    n = F.col("s_suppkey").cast("string")
    bodies = [
        F.concat(F.lit("create table OLD.T as select * from old.s"), n, F.lit(" a join other b on a.x = 'from old.t' -- from old.t")),
        F.concat(F.lit("select old.t from p x, old.s"), n, F.lit(" as s, OLD.t left join q on p(old.t)")),
        F.lit("df = spark.table(\"old.t\").join(spark.read.table('p'), \"old.t\").write.saveAsTable(\"q\")"),
    ]
    body = F.get(F.array(*bodies), (F.col("s_suppkey") % 3).cast("int"))
    fixed = t.spark.createDataFrame([("old.t", "new.t"), ("p", "q"), ("q", "r"), ("r", "p")], "source string, target string")
    table = t.supplier.select(F.concat(F.lit("old.S"), "s_suppkey").alias("source"), F.concat(F.lit("new.s"), "s_suppkey").alias("target")).union(fixed)
    return text.rewrite_tables(t.supplier.select("s_suppkey", body.alias("body")), "s_suppkey", "body", table).select("s_suppkey", "new_text")


@query("with w as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as k, n_name || ' one two' as body from nation) select n_regionkey, ((k - 1) // 2)::bigint as part, min(n_nationkey) as first, count(*) as n, string_agg(body, chr(10) || chr(10) order by n_nationkey) as text from w group by 1, 2")
def section_merging(t):
    x = t.nation.select("n_regionkey", "n_nationkey", F.concat("n_name", F.lit(" one two")).alias("body"))
    return text.merge_sections(x, "n_regionkey", "n_nationkey", "body", 8)


@query(f"select kv_key, value, tags, created_at from {_MSG} where not starts_with(kv_key, 'msg::1::') or value = 'click'")
def kv_snapshot_restore(t):
    store = _messages(t)
    saved = memory.snapshot(store.where("value = 'click'"), "msg::1::")
    return memory.restore(store, saved, "msg::1::").select("kv_key", "value", "tags", "created_at")


@query(f"select split_part(kv_key, '::', 2) as thread, count(*) as n, min(created_at) as first_at, max(updated_at) as last_at from {_MSG} group by 1")
def thread_listing(t):
    return memory.threads(_messages(t))


@query("select user_id, count(*) filter (event_id > seen or seen is null) as n_unread, min(event_id) filter (event_id > seen or seen is null) as next_unread from events left join (select user_id, max(event_id) as seen from events where user_id % 3 > 0 and ts < timestamp '2024-01-15' group by 1) using (user_id) group by 1")
def read_frontier(t):
    read = t.events.where("user_id % 3 > 0 and ts < timestamp_ntz '2024-01-15'")
    marks = memory.advanced(t.spark.createDataFrame([], "user_id long, seen long"), read, "user_id", "event_id")
    return memory.unread(t.events, marks, "user_id", "event_id")


@query(f"select replace(kv_key, 'msg::2::', 'msg::f::') as kv_key, value, replace(tags, 'thread:2', 'thread:f') as tags from {_MSG} where starts_with(kv_key, 'msg::2::') and created_at < epoch(timestamp '2024-01-20')")
def fork_with_bound(t):
    bound = 1705708800.0  # 2024-01-20
    return memory.fork_before(_messages(t), "2", "f", bound).select("kv_key", "value", "tags")


@query("select s_suppkey, round(case s_suppkey % 6 when 0 then 0.5 when 1 then 1 when 2 then 0 when 3 then 1 when 4 then 0.5 else 0 end, 6) as score from supplier")
def language_share(t):
    bodies = [
        "```py_spark\nx\n```\nand\n```sql\ny\n```",
        "```PySpark\nx\n```",
        "no block",
        "```\nuntagged\n```\n```sas\nan echo\n```\n```Text\nprose\n```",
        "## Analysis\n```sql\na\n```\n## Translation\n```pyspark\nb\n```\n```r\nc\n```\n## Notes\n```sql\nd\n```",
        "## Translation of all\nprose only\n## Notes\n```pyspark\nd\n```",
    ]
    md = F.get(F.array(*map(F.lit, bodies)), (F.col("s_suppkey") % 6).cast("int"))
    return t.supplier.select("s_suppkey", F.round(evaluation.language_compliance(md, "pyspark"), 6).alias("score"))


@query("select p_partkey, upper(md5(p_name)) as m, upper(sha256(p_name)) as s, upper(sha256(unhex(repeat('5c', 64)) || unhex(sha256(unhex(repeat('36', 64)) || encode(p_name))))) as h from part")
def fn_hashing(t):
    return t.part.select("p_partkey", char.hashing("MD5", F.col("p_name")).alias("m"), char.hashing("SHA256", F.col("p_name")).alias("s"), char.hashing_hmac(F.col("p_name"), b"").alias("h"))


@query("select n_nationkey, date_diff('day', date '1960-01-01', current_date) as d, true as later, n_nationkey * 86400 + 3 * 3600 + 4 * 60 + 5 as s from nation")
def fn_now(t):
    later = dates.datetime() >= dates.today() * 86_400
    s = dates.dhms(F.col("n_nationkey"), F.lit(3), F.lit(4), F.lit(5))
    return t.nation.select("n_nationkey", dates.today().cast("long").alias("d"), later.alias("later"), s.alias("s"))


@query("select n_nationkey, rtrim(substr(n_name, 1, 4)) as n_name, 'ABC' as shout from nation")
def length_statement(t):
    shout = params.sysfunc(t.spark, "upper", "abc")
    return step.formatted(step.length(t.nation, {"n_name": 4}), {"n_nationkey": "Z5."}).select("n_nationkey", "n_name", F.lit(shout).alias("shout"))


@query("select doc_id, length(text) // 4 as n from documents")
def hook_token_counter(t):
    count = hooks.token_counter(lambda x: x.str.len() // 4)
    return t.documents.select("doc_id", count("text").alias("n"))


@query("select n_nationkey, 'same' as metric, case when n_regionkey > 0 then case when n_nationkey % 2 = 0 then 1.0 else 0.0 end end::double as score, 0.5::double as threshold, n_regionkey = 0 as skipped from nation")
def hook_metric(t):
    same = hooks.metric(lambda a, b: (a == b) * 1.0, "same", 0.5)
    given = F.when(F.col("n_regionkey") > 0, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("other"))
    return same(t.nation.withColumn("given", given), "n_nationkey", "n_name", "given")


@query("select conv_id, string_agg(substr(text, 1, 3), '|' order by turn) as summary from conversations group by 1")
def hook_summariser(t):
    return hooks.summariser(lambda texts: "|".join(x[:3] for x in texts))(t.conversations, "conv_id", "turn", "text")


@query("select c_custkey::varchar as source_id, 2 as unit_no, '%let cut = ' || c_custkey || ';' as statement from customer")
def hook_statements(t):
    hooks.register(t.spark)
    _programs(t).createOrReplaceTempView("quarry_programs")
    return t.spark.sql("select source_id, s.unit_no, s.statement from quarry_programs, lateral statements(text) s where s.unit_no = 2")


@query(ORACLES["chunk_program"])
def hook_chunks(t):
    """The chunks of chunk_program through the table function, with a state for each source."""
    hooks.register(t.spark)
    text.described_units(text.units(_programs(t))).createOrReplaceTempView("quarry_units")
    return t.spark.sql("select * from chunk_units(TABLE(quarry_units) PARTITION BY source_id ORDER BY unit_no)")
