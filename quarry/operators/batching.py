"""From the chunks of programs to ordered batches: dependency edges, context, and what is worked on together.

chunks: source_id, idx (the order in a source), kind, text. Every step is a join, a window or a grouping over tables of chunks and edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import graph, macros, text

#: Chunks that only stand beside others.
CONTEXT = ("COMMENT_BLOCK", "OPTIONS", "STEP_BOUNDARY")
#: Edges that tie chunks into one batch; the others make context of their producers, or pull them in if one batch alone uses them.
STRONG = ("dataset_flow", "macro_body_dataset")


def described(chunks: DataFrame) -> DataFrame:
    """chunks with what each reads, writes, publishes and consumes (arrays), and the macro it defines (null: none); written once, since much is asked of it."""
    reads, writes = text.datasets(F.col("text"))
    parameters = macros.signature(F.col("text"))
    found = text.spread(chunks, "source_id", "idx").select("source_id", "idx", "kind", "text", reads.alias("reads"), writes.alias("writes"), macros.produced(F.col("text")).alias("made"), macros.consumed(F.col("text"), parameters).alias("used"), macros.macro_name(F.col("text")).alias("macro"))
    return graph._cut(found)


def edges(rows: DataFrame) -> DataFrame:
    """source_id, from_idx, to_idx, kind, subject of described() chunks.

    dataset_flow, macro_var_flow: from the last chunk before that writes or publishes a name to each that reads it; macro_body_dataset: to a
    call whose macro reads it by a parameter; macro_arg_dataset: to a call that has it as an argument; macro_invocation: from a macro's
    last definition to its calls. What a call writes by a parameter counts as written there. All names of all kinds go through one window.
    """
    called, defined = rows.where("kind = 'MACRO_CALL'"), rows.where("macro is not null")
    args = macros.calls(called.withColumn("key", F.struct("source_id", "idx")), "key").select("key.source_id", "key.idx", "macro", "value")
    bodies = macros.body_datasets(defined, called)
    # names with a parameter in a definition are nobody's; what they stand for belongs to the calls
    own = lambda c: F.when(F.col("macro").isNotNull(), F.filter(c, lambda x: ~F.contains(x, F.lit("&")))).otherwise(F.col(c))
    row = lambda df, space, name, kind: df.select("source_id", F.lit(space).alias("space"), name.alias("name"), "idx", F.lit(kind).alias("kind"))
    parts = [
        row(rows, "data", F.explode(own("writes")), None),
        row(rows, "data", F.explode(own("reads")), "dataset_flow"),
        row(rows, "variable", F.explode("made"), None),
        row(rows, "variable", F.explode("used"), "macro_var_flow"),
        row(bodies.where("direction = 'out'"), "data", F.col("name"), None),
        row(bodies.where("direction = 'in'"), "data", F.col("name"), "macro_body_dataset"),
        row(args.where("value is not null"), "data", text.canonical(F.col("value")), "macro_arg_dataset"),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.union(x)
    one = every.groupBy("source_id", "space", "name", "idx").agg(F.bool_or(F.col("kind").isNull()).alias("p"), F.collect_set("kind").alias("kinds"))
    near = graph.nearest_preceding(one.select(F.struct("source_id", "space", "name", "kinds").alias("whole"), F.struct("source_id", "space", "name").alias("key"), "idx", "p", (F.size("kinds") > 0).alias("c")), "key", "idx", "p", "c", "whole")
    flow = near.select("whole.source_id", "from_idx", "to_idx", F.explode("whole.kinds").alias("kind"), F.col("whole.name").alias("subject"))
    define = defined.groupBy("source_id", "macro").agg(F.max("idx").alias("from_idx"))
    calls_ = args.select("source_id", F.col("idx").alias("to_idx"), "macro").distinct().join(define, ["source_id", "macro"])
    return flow.union(calls_.select("source_id", "from_idx", "to_idx", F.lit("macro_invocation"), "macro"))


def _node(idx: str) -> Column:
    return F.concat(F.col("source_id"), F.lit("#"), F.lpad(F.col(idx).cast("string"), 9, "0")).alias(idx)


def batches(rows: DataFrame, links: DataFrame, most: int = 8) -> DataFrame:
    """source_id, idx, role (member, context, global), batch_no: 1, 2, ... in the order of the batches' first chunks; null for global context.

    Chunks tied by strong edges are one component. Weak edges are judged against these: a producer that one other component uses joins it, those
    that several use become the source's global context, all by the components as they were. What only stands beside others goes with the
    next member of its source (after the last: with that one). A batch of more than `most` members is cut in its order.
    """
    links = graph._cut(links)
    strong = links.where(F.col("kind").isin(*STRONG))
    tied = graph.components(strong.select(_node("from_idx"), _node("to_idx")))
    nodes = rows.select("source_id", "idx", "kind", _node("idx").alias("node")).join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    weak = links.where(~F.col("kind").isin(*STRONG)).select(_node("from_idx").alias("src"), _node("to_idx").alias("dst"))
    nodes = graph._cut(nodes)
    parts = nodes.select("node", "component")
    fate = graph.promote_weak(weak, parts).select(F.col("producer_root").alias("component"), "decision")
    uses = weak.join(parts.toDF("src", "component"), "src").join(parts.toDF("dst", "user"), "dst").where("component <> user").groupBy("component").agg(F.min("user").alias("user"))
    fate = graph._cut(fate.join(uses, "component"))
    absorbed = fate.where("decision = 'absorb'").select("component", "user")
    promoted = fate.where("decision = 'promote'").select("component", F.substring_index("component", "#", 1).alias("source_id"))
    hubs = promoted.join(promoted.groupBy("source_id").agg(F.min("component").alias("user")), "source_id").select("component", "user")
    joined = graph.components(absorbed.union(hubs.where("component <> user"))).select(F.col("node").alias("component"), F.col("component").alias("root"))
    shared = promoted.select("component").join(joined, "component", "left").select(F.coalesce("root", "component").alias("root"), F.lit(True).alias("shared")).distinct()
    alone = nodes.groupBy("component").agg(F.bool_and(F.col("kind") == "GLOBAL_STATEMENT").alias("only_global"))
    placed = nodes.join(fate.select("component", "decision"), "component", "left").join(alone, "component").join(joined, "component", "left")
    placed = placed.withColumn("root", F.coalesce("root", "component")).join(shared, "root", "left")
    is_context = F.col("kind").isin(*CONTEXT) | (F.col("only_global") & F.col("decision").isNull())
    role = F.when(F.col("shared"), "global").when(is_context, "context").otherwise("member")
    placed = placed.select("source_id", "idx", role.alias("role"), F.when(role == "member", F.col("root")).alias("home"))
    after = Window.partitionBy("source_id").orderBy("idx").rowsBetween(0, Window.unboundedFollowing)
    before = Window.partitionBy("source_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    near = F.coalesce(F.first("home", ignorenulls=True).over(after), F.last("home", ignorenulls=True).over(before))
    placed = placed.withColumn("home", F.when(F.col("role") != "global", near))
    member = F.col("role") == "member"
    ordered = Window.partitionBy("source_id", "home").orderBy("idx")
    cut = F.floor(F.greatest(F.sum(member.cast("int")).over(ordered) - 1, F.lit(0)) / most)
    whole = placed.withColumn("cut", cut).withColumn("first", F.min("idx").over(Window.partitionBy("source_id", "home")))
    number = F.dense_rank().over(Window.partitionBy("source_id", F.col("role") == "global").orderBy("first", "home", "cut"))
    return whole.select("source_id", "idx", "role", F.when(F.col("role") != "global", number).alias("batch_no"))


def runs(df: DataFrame, by: Sequence[str], order: str, alone: str, most: int, name: str = "run") -> DataFrame:
    """Adds run: neighbouring rows for which `alone` holds share one, of at most `most` rows; any other row is a run of its own (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(order)
    fresh = ~F.col(alone) | ~F.coalesce(F.lag(alone).over(w), F.lit(False))
    x = df.withColumn("_island", F.sum(fresh.cast("int")).over(w))
    inside = F.row_number().over(Window.partitionBy(*by, "_island").orderBy(order)) - 1
    x = x.withColumn("_cut", (inside % most == 0).cast("int"))
    return x.withColumn(name, F.sum("_cut").over(w) - 1).drop("_island", "_cut")


def flattened(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunks of all files in one order: adds item_no, by file_rank, then idx. files: source_id, file_rank."""
    from quarry.operators.step import position

    return position(chunks.join(files.select("source_id", "file_rank"), "source_id"), ["file_rank", "source_id", "idx"], "item_no")


def batch_io(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """source_id, batch_no, inputs, outputs: names that a batch reads before any of its own chunks writes them, and all that it writes."""
    key = ["source_id", "batch_no"]
    x = rows.join(placed.where("batch_no is not null"), ["source_id", "idx"])
    made = x.select(*key, "idx", F.explode("writes").alias("name"), F.lit(False).alias("reads"))
    used = x.select(*key, "idx", F.explode("reads").alias("name"), F.lit(True))
    # a chunk that reads and writes a name reads it first
    first = made.union(used).groupBy(*key, "name").agg(F.min(F.when(F.col("reads"), F.col("idx"))).alias("r"), F.min(F.when(~F.col("reads"), F.col("idx"))).alias("w"))
    outer = F.col("r").isNotNull() & (F.col("w").isNull() | (F.col("r") <= F.col("w")))
    names = first.groupBy(*key).agg(F.sort_array(F.collect_set(F.when(outer, F.col("name")))).alias("inputs"), F.sort_array(F.collect_set(F.when(F.col("w").isNotNull(), F.col("name")))).alias("outputs"))
    none = F.array().cast("array<string>")
    return x.select(*key).distinct().join(names, key, "left").select(*key, F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"))


def merged_metadata(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """source_id, batch_no, kinds, made, used, macros, n_chunks of each batch: the union of its chunks' metadata; variables made inside aren't used."""
    x = rows.join(placed.where("batch_no is not null"), ["source_id", "idx"])
    union = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))
    out = x.groupBy("source_id", "batch_no").agg(F.sort_array(F.collect_set("kind")).alias("kinds"), union("made").alias("made"), union("used").alias("used"), F.sort_array(F.collect_set("macro")).alias("macros"), F.count("*").alias("n_chunks"))
    return out.withColumn("used", F.array_except("used", "made"))


def batch_texts(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """source_id, batch_no, text, n_chunks: each batch's chunks in their order, global context of the source before them."""
    x = rows.join(placed, ["source_id", "idx"])
    body = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), "")
    shared = x.where("batch_no is null").groupBy("source_id").agg(body().alias("_shared"))
    own = x.where("batch_no is not null").groupBy("source_id", "batch_no").agg(body().alias("_own"), F.count("*").alias("n_chunks"))
    return own.join(shared, "source_id", "left").select("source_id", "batch_no", F.concat(F.coalesce("_shared", F.lit("")), "_own").alias("text"), "n_chunks")
