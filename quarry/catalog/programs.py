"""Queries over programs of many shapes: what statements read and write, macro bodies behind calls, batches, notes that expire, keyed upserts.

The programs are made from the rows of a table; for each shape the rows are worked out by hand.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.catalog.base import query
from quarry.catalog.corpus import _sql
from quarry.operators import batching, macros, text
from quarry.sources import files
from quarry.streaming import events as stream
from quarry.streaming import lives

#: Texts (# is the row's key) with what they read and write.
_SHAPES = [
    ("proc means data=q#; var x; output out=st# mean=; run;", ["work.q#"], ["work.st#"]),
    ("proc summary data=lib.q# nway; class a; output out=lib.s# sum=t; run;", ["lib.q#"], ["lib.s#"]),
    ("proc freq data=f#; tables a * b / out=ct# noprint; run;", ["work.f#"], ["work.ct#"]),
    ("proc freq data=f#; table a / out=one#; table b / out=two#; run;", ["work.f#"], ["work.one#", "work.two#"]),
    ("data all#; set m1-m3 x#; run;", ["work.m1", "work.m2", "work.m3", "work.x#"], ["work.all#"]),
    ("data o1-o2; set lib.y#; run;", ["lib.y#"], ["work.o1", "work.o2"]),
    ("data a#; merge b# (in=i where=(x in (1, 2))) c# (drop=z); by k; run;", ["work.b#", "work.c#"], ["work.a#"]),
    ("data a#; update a# t#; by k; run;", ["work.a#", "work.t#"], ["work.a#"]),
    ("data lib.a#; modify lib.a# t#; by k; run;", ["lib.a#", "work.t#"], ["lib.a#"]),
    ("data _null_; set u#; put x; run;", ["work.u#"], []),
    ("data; set v#; run;", ["work.v#"], []),
    ("data w#; input x; datalines;\nset b\nmerge c d\n;\nrun;", [], ["work.w#"]),
    ("data w#; input x; cards;\n1 2\nset no\n;\nset yes#; run;", ["work.yes#"], ["work.w#"]),
    ("proc sort data=s#; by k; run;", ["work.s#"], ["work.s#"]),
    ("proc sort data=s# out=r# nodupkey; by k; run;", ["work.s#"], ["work.r#"]),
    ("proc append base=big# data=new#; run;", ["work.new#"], ["work.big#"]),
    ("proc compare base=p# compare=c#; run;", ["work.c#"], ["work.p#"]),
    ("proc transpose data=t# out=w#; by k; run;", ["work.t#"], ["work.w#"]),
    ("proc sql; create table t# as select * from (select * from a#, b# c where x in (select y from d#)) q, t2# left join lib.u on 1; quit;", ["lib.u", "work.a#", "work.b#", "work.d#", "work.t2#"], ["work.t#"]),
    ("proc sql; update h# set x = 1 where y in (select z from k#); quit;", ["work.h#", "work.k#"], ["work.h#"]),
    ("proc sql; delete from g# where x = 1; quit;", ["work.g#"], ["work.g#"]),
    ("proc sql; insert into i# select * from j# as x, lib.k# y; quit;", ["lib.k#", "work.j#"], ["work.i#"]),
    ("proc sql; create view v# as select a.x from l# a inner join m# b on a.k = b.k; quit;", ["work.l#", "work.m#"], ["work.v#"]),
    ("proc sql; select count(*) into :n from (select distinct k from e#); quit;", ["work.e#"], []),
    ("data z#; /* set no; */ set s# /* merge x */; note = 'set q; merge r'; run;", ["work.s#"], ["work.z#"]),
    ("* set old; data z#; set 'C:\\x\\Y.sas7bdat' s#; run;", ["work.s#"], ["work.z#"]),
    ("data h#; if _n_ = 1 then do; declare hash d(dataset: 'lk#'); end; set e#; run;", ["work.e#", "work.lk#"], ["work.h#"]),
    ("%let x = set no; data k#; set l#; run;", ["work.l#"], ["work.k#"]),
    ("proc print data=o#; title 'from nowhere'; run;", ["work.o#"], []),
    ("data a# b#; set c#; if x then output a#; else output b#; run;", ["work.c#"], ["work.a#", "work.b#"]),
    ("data a#(keep=x rename=(x=y)) / view=a#; set c#(obs=5 firstobs=2) end=last nobs=n; run;", ["work.c#"], ["work.a#"]),
    ("libname lib 'x'; options nodate;", [], []),
]


def _shaped(t, shapes):
    body = F.get(F.array(*[F.lit(x[0]) for x in shapes]), (F.col("c_custkey") % len(shapes)).cast("int"))
    return t.customer.select(F.col("c_custkey").cast("string").alias("source_id"), F.replace(body, F.lit("#"), F.col("c_custkey").cast("string")).alias("text"))


_HELD = f"(values {', '.join(f'({i}, {_sql(r)}, {_sql(w)})' for i, (_, r, w) in enumerate(_SHAPES))}) s(i, r, w)"


@query(f"select c_custkey::varchar as source_id, list_sort(list_transform(r, lambda x: replace(x, '#', c_custkey::varchar))) as reads, list_sort(list_transform(w, lambda x: replace(x, '#', c_custkey::varchar))) as writes from customer join {_HELD} on i = c_custkey % {len(_SHAPES)}")
def statement_shapes(t):
    reads, writes = text.datasets(F.col("text"))
    return _shaped(t, _SHAPES).select("source_id", reads.alias("reads"), writes.alias("writes"))


#: Programs as lists of chunks (kind, text), with the edges (from, to, kind, subject) between them and what each chunk becomes (role, batch).
_M, _C, _D, _P, _G = "MACRO_DEFINITION", "MACRO_CALL", "DATA_STEP", "PROC_STEP", "GLOBAL_STATEMENT"
_PROGRAMS = [
    (  # a call writes by a place, a default and a name; the last definition counts
        [(_M, "%macro m(o); data old; set &o; run; %mend;"), (_M, "%macro m(o, in=src, keep=&in._k); data &o &keep; set &in; run; %mend;"), (_D, "data src; x = 1; run;"), (_C, "%m(work.z);"), (_P, "proc print data=z; run;"), (_P, "proc print data=src_k; run;")],
        [(2, 4, "macro_invocation", "m"), (3, 4, "macro_body_dataset", "work.src"), (4, 5, "dataset_flow", "work.z"), (4, 6, "dataset_flow", "work.src_k")],
        [("member", 1), ("member", 2), ("member", 2), ("member", 2), ("member", 2), ("member", 2)],
    ),
    (  # a call within a body, two deep, with a library from a parameter; recursion is left out
        [(_M, "%macro inner(a, to=); data &to; set &a; run; %outer(&a) %mend;"), (_M, "%macro outer(t); %inner(lib.&t, to=&t._done) %mend;"), (_D, "data lib.raw#; x = 1; run;"), (_C, "%outer(raw#);"), (_D, "data fin; set raw#_done; run;")],
        [(2, 4, "macro_invocation", "outer"), (3, 4, "macro_body_dataset", "lib.raw#"), (4, 5, "dataset_flow", "work.raw#_done")],
        [("member", 1), ("member", 2), ("member", 2), ("member", 2), ("member", 2)],
    ),
    (  # a macro that independent sections call is global context, the sections stay apart
        [(_M, "%macro u(x); proc print data=&x; run; %mend;"), (_D, "data a; set r1; run;"), (_C, "%u(a);"), (_D, "data b; set r2; run;"), (_C, "%u(b);"), (_D, "data c; set r3; run;"), (_C, "%u(c);")],
        [(1, 3, "macro_invocation", "u"), (1, 5, "macro_invocation", "u"), (1, 7, "macro_invocation", "u"), *((k, k + 1, kind, f"work.{n}") for k, n in ((2, "a"), (4, "b"), (6, "c")) for kind in ("macro_body_dataset", "macro_arg_dataset"))],
        [("global", None), ("member", 1), ("member", 1), ("member", 2), ("member", 2), ("member", 3), ("member", 3)],
    ),
    (  # two variables that both sections use are one global context; a third, used once, joins its user
        [(_G, "%let p = 1;"), (_G, "%let q = 2;"), (_G, "%let one = 3;"), (_D, "data a; x = &p + &q + &one; run;"), (_D, "data b; x = &p + &q; run;"), (_P, "proc print data=b; run;")],
        [(1, 4, "macro_var_flow", "p"), (1, 5, "macro_var_flow", "p"), (2, 4, "macro_var_flow", "q"), (2, 5, "macro_var_flow", "q"), (3, 4, "macro_var_flow", "one"), (5, 6, "dataset_flow", "work.b")],
        [("global", None), ("global", None), ("member", 1), ("member", 1), ("member", 2), ("member", 2)],
    ),
    (  # the nearest writer before a reader counts; OUTPUT OUT= and ranges tie steps
        [(_D, "data m1; x = 1; run;"), (_D, "data m2; x = 2; run;"), (_D, "data m1; x = 3; run;"), (_D, "data all#; set m1-m2; run;"), (_P, "proc means data=all#; output out=st mean=; run;"), (_P, "proc print data=st; run;")],
        [(3, 4, "dataset_flow", "work.m1"), (2, 4, "dataset_flow", "work.m2"), (4, 5, "dataset_flow", "work.all#"), (5, 6, "dataset_flow", "work.st")],
        [("member", 1), ("member", 2), ("member", 2), ("member", 2), ("member", 2), ("member", 2)],
    ),
    (  # a producer that is absorbed by one that is absorbed itself
        [(_G, "%let lib = x;"), (_D, "data a#; set s; if k = \"&lib\"; run;"), (_C, "%nobody(a#, 'b)c');"), (_D, "data other; set t; run;")],
        [(1, 2, "macro_var_flow", "lib"), (2, 3, "macro_arg_dataset", "work.a#")],
        [("member", 1), ("member", 1), ("member", 1), ("member", 2)],
    ),
]


def _program_chunks(t):
    shapes = F.array(*[F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("text")) for k, x in p[0]]) for p in _PROGRAMS])
    of = t.customer.select("c_custkey", F.posexplode(F.get(shapes, (F.col("c_custkey") % len(_PROGRAMS)).cast("int"))).alias("pos", "c"))
    return of.select(F.col("c_custkey").cast("string").alias("source_id"), (F.col("pos") + 1).alias("idx"), "c.kind", F.replace("c.text", F.lit("#"), F.col("c_custkey").cast("string")).alias("text"))


def _rows_of(k):
    return ", ".join(f"({i}, {', '.join(map(_sql, row))})" for i, p in enumerate(_PROGRAMS) for row in p[k])


@query(f"select c_custkey::varchar as source_id, f as from_idx, g as to_idx, kind, replace(subject, '#', c_custkey::varchar) as subject from customer join (values {_rows_of(1)}) e(i, f, g, kind, subject) on i = c_custkey % {len(_PROGRAMS)}")
def program_edges(t):
    return batching.edges(batching.described(_program_chunks(t)))


_ROLES = ", ".join(f"({i}, {k}, '{role}', {_sql(b)})" for i, p in enumerate(_PROGRAMS) for k, (role, b) in enumerate(p[2], 1))


@query(f"select c_custkey::varchar as source_id, idx, role, b as batch_no from customer join (values {_ROLES}) v(i, idx, role, b) on i = c_custkey % {len(_PROGRAMS)}")
def program_roles(t):
    rows = batching.described(_program_chunks(t))
    return batching.batches(rows, batching.edges(rows))


@query("select c_custkey::varchar as source_id, 1 as idx, ['n1', 'n2', 'n3', 'tot'] as made from customer")
def macro_ranges(t):
    body = F.concat(F.lit("proc sql; select a, b into :n1 - :n3, :tot separated by ',' from x"), F.col("c_custkey").cast("string"), F.lit("; quit;"))
    return t.customer.select(F.col("c_custkey").cast("string").alias("source_id"), F.lit(1).alias("idx"), macros.produced(body).alias("made"))


#: Statements of one step (# is the key): 12 words at most a part, of which the last three units (100 words at most) are repeated in the next one.
_LONG = ["data a#; ", "set b#; ", "x = 1 + 2; ", "if x > 3 then output; ", "length c $ 8; ", "y = 'one; two three four five six seven eight nine ten eleven twelve thirteen'; ", "z = 1; ", "keep x y z; ", "run;\n"]
#: (part, parent?, first unit, last unit): 0 is the parent. Words of the units: 2 2 5 6 4 15 3 4 1.
_PARTS = [(0, None, 1, 9), (1, 0, 1, 3), (2, 0, 1, 4), (3, 0, 2, 5), (4, 0, 3, 6), (5, 0, 4, 7), (6, 0, 5, 8), (7, 0, 6, 9)]


@query(f"select c_custkey::varchar as source_id, 1 as chunk_no, part, parent, a as first_unit, b as last_unit, replace(x, '#', c_custkey::varchar) as text, ['work.b' || c_custkey] as reads, ['work.a' || c_custkey] as writes from customer, (values {', '.join(_sql_row for _sql_row in (f'({p}, {_sql(q)}, {a}, {b}, {_sql("".join(_LONG[a - 1 : b]))})' for p, q, a, b in _PARTS))}) v(part, parent, a, b, x)")
def statement_split(t):
    body = F.replace(F.lit("".join(_LONG)), F.lit("#"), F.col("c_custkey").cast("string"))
    units = text.units(t.customer.select(F.col("c_custkey").cast("string").alias("source_id"), body.alias("text")))
    return text.split_steps(units, text.chunks(units), 12).select("source_id", "chunk_no", "part", "parent", "first_unit", "last_unit", "text", "reads", "writes")


_TTL = "with e as (select user_id, event_type, epoch_us(ts) as us from events), g as (select *, case when us - lag(us) over w < 21600000000 then 0 else 1 end as fresh from e window w as (partition by user_id, event_type order by us)), n as (select *, sum(fresh) over (partition by user_id, event_type order by us rows unbounded preceding) as life from g)"


@query(f"{_TTL} select user_id, event_type, min(us) as opened, max(us) + 21600000000 as until, count(*) as notes from n group by user_id, event_type, life having max(us) + 21600000000 < (select max(us) from e) - 3600000000")
def stream_note_expiry(t):
    """Notes of a user and kind live for six hours after the last one; those that come back later expire again."""
    e = stream.read_log(t.spark, t.dir, "events.parquet", t.events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.run_to_end(lives.expiries(e, ["user_id", "event_type"], "ts", 6 * 3600.0))


@query("select 'user::' || user_id as kv_key, arg_max(event_type, event_id) as value, case when bool_or(user_id % 2 = 0) then 'old' end as source, case when bool_or(user_id % 2 = 0) then 1.0 else 9.0 end as created_at from events group by user_id union all select 'user::' || (100000 + n_nationkey), 'start', 'old', 1.0 from nation")
def stream_upserts(t):
    """The events as changes to a table that holds every second user, and some that no event is about."""
    key = F.concat(F.lit("user::"), F.col("user_id").cast("string"))
    row = lambda k: [k.alias("kv_key"), F.lit("start").alias("value"), F.lit(None).cast("string").alias("tags"), F.lit(1.0).alias("created_at"), F.lit(1.0).alias("updated_at"), F.lit("old").alias("source")]
    held = t.events.where("user_id % 2 = 0").select("user_id").distinct().select(*row(key)).union(t.nation.select(*row(F.concat(F.lit("user::"), (F.col("n_nationkey") + 100000).cast("string")))))
    place = files.scratch(t.spark)
    held.write.parquet(f"{place}/start")
    changes = stream.read_log(t.spark, t.dir, "events.parquet", t.events.schema)
    changes = changes.select(F.col("event_id").alias("seq"), key.alias("kv_key"), F.col("event_type").alias("value"), F.lit(None).cast("string").alias("tags"), F.lit(None).cast("string").alias("source"))
    stream.upsert_sink(changes, {"root": f"{place}/table", "current": f"{place}/start"}, 9.0, f"{place}/checkpoint-{uuid.uuid4().hex}").awaitTermination()
    return stream.current(t.spark, f"{place}/table").select("kv_key", "value", "source", "created_at")
