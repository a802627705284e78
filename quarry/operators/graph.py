"""Dependency edges, components, layers, cycles and cross-source references over edge tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.files import scratch


def _cut(df: DataFrame, *old: DataFrame) -> DataFrame:
    """df written to the folder that executors share and read back: lineage ends here, and a lost executor costs no more than a read.

    old: tables of earlier calls that nothing reads any more; they are deleted.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_to = path
    _drop(*old)
    return out


def _drop(*tables: DataFrame) -> None:
    """Deletes tables of _cut() that nothing reads any more."""
    for x in tables:
        spark = x.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(x.cut_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def nearest_preceding(df: DataFrame, name: str, idx: str, producer: str, consumer: str, *more: str) -> DataFrame:
    """name, from_idx, to_idx (and more columns of the consumer): each consumer with the greatest producer index strictly below its own.

    One window over rows of a name, no inequality join; rows of one index don't see each other.
    """
    made = F.max(F.when(F.col(producer), F.col(idx)))
    w = Window.partitionBy(name).orderBy(idx).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn("from_idx", made.over(w)).where(F.col(consumer) & F.col("from_idx").isNotNull()).select(name, "from_idx", F.col(idx).alias("to_idx"), *more)


def next_row(df: DataFrame, by: Sequence[str], idx: str, wanted: str) -> DataFrame:
    """The index of the first later row for which `wanted` holds."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("next_idx", F.first(F.when(F.col(wanted), F.col(idx)), ignorenulls=True).over(w))


def last_before(df: DataFrame, by: Sequence[str], idx: str, value: str, name: str = "last") -> DataFrame:
    """The most recent non-missing value before this row."""
    w = Window.partitionBy(*by).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def longest_prefix(df: DataFrame, path: str, table: DataFrame, key: str, target: str, out: str) -> DataFrame:
    """The target of the longest key that is the path itself or a prefix of it ending at a separator.

    Paths are taken apart into their prefixes, which are joined by equality; so no inequality join arises.
    """
    clean = F.rtrim(F.col(path), F.lit("/"))
    parts = F.split(clean, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    keys = table.select(F.rtrim(F.col(key), F.lit("/")).alias("_key"), F.col(target).alias("_target")).groupBy("_key").agg(F.max("_target").alias("_target"))
    paths = df.select(path).distinct().withColumn("_key", F.explode(prefixes)).join(keys, "_key")
    best = paths.groupBy(path).agg(F.max_by("_target", F.length("_key")).alias(out))
    return df.join(best, path, "left")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    around = edges.union(edges.select("lo", "hi")).toDF("u", "v") if large else edges.toDF("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    out = (tied.where("v > u") if large else tied).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return (out if large else out.union(least)).where("hi > lo").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, component (the least node) for every node with an edge; edges: two columns. Lineage is cut each round."""
    a, b = edges.columns
    now = _cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    mark = None
    for _ in range(rounds):
        now = _cut(_star(_star(now, True), False), now)
        row = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if row == mark:
            break
        mark = row
    else:
        raise RuntimeError("no fixed point")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def promote_weak(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """producer_root, consumers, decision for weak edges (src, dst) against a snapshot of components.

    A producer used from one other component is absorbed by it; one used from several is promoted to global context. One pass, no fixpoint.
    """
    p = parts.select(F.col("node").alias("src"), F.col("component").alias("src_root"))
    c = parts.select(F.col("node").alias("dst"), F.col("component").alias("dst_root"))
    e = weak.join(p, "src", "left").join(c, "dst", "left").select(F.coalesce("src_root", "src").alias("producer_root"), F.coalesce("dst_root", "dst").alias("consumer_root"))
    e = e.where("producer_root <> consumer_root")
    return e.groupBy("producer_root").agg(F.count_distinct("consumer_root").alias("consumers")).withColumn("decision", F.when(F.col("consumers") == 1, "absorb").otherwise("promote"))


def layers(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, layer: waves of nodes whose upstreams are all done; what lies on or behind a cycle gets layer -1. edges: upstream, downstream."""
    left = _cut(edges.select("upstream", "downstream").distinct())
    every = edges.select(F.col("upstream").alias("node")).union(edges.select("downstream")).distinct()
    todo, waves = _cut(every.select("node", F.lit(-1).alias("layer"))), []
    for layer in range(rounds):
        waiting = left.select(F.col("downstream").alias("node"), F.lit(True).alias("waits")).distinct()
        judged = _cut(todo.join(waiting, "node", "left").select("node", F.when(F.col("waits"), -1).otherwise(layer).alias("layer")), todo)
        wave, todo = judged.where("layer >= 0"), judged.where("layer < 0")
        todo.cut_to = judged.cut_to
        if wave.isEmpty():
            break
        waves.append(_cut(wave))
        todo = _cut(todo, judged)
        left = _cut(left.join(waves[-1].select(F.col("node").alias("upstream")), "upstream", "left_anti"), left)
    else:
        raise RuntimeError("no fixed point")
    out = todo
    for wave in waves:
        out = out.union(wave)
    return out


def _trimmed(edges: DataFrame, rounds: int) -> tuple[DataFrame, int]:
    """Edges whose ends have both an edge in and an edge out, and their number: what isn't between cycles goes from both ends."""
    n = edges.count()
    for _ in range(rounds):
        outs, ins = edges.select(F.col("downstream").alias("upstream")).distinct(), edges.select(F.col("upstream").alias("downstream")).distinct()
        edges = _cut(edges.join(outs, "upstream", "left_semi").join(ins, "downstream", "left_semi").select("upstream", "downstream"), edges)
        if (m := edges.count()) == n:
            return edges, m
        n = m
    raise RuntimeError("no fixed point")


#: Edges of a stretch in which near() looks for cycles, so that a task holds no more however many it has.
STRETCH = 200_000


def _sets(outs: dict) -> dict:
    """Of the nodes of a small graph (node: what it leads to, all nodes are keys) those of sets of several, with their set's least node. Tarjan's search, with its own stack."""
    low, open_, done, found = {}, [], set(), {}
    for root in outs:
        if root in low:
            continue
        todo = [(root, iter(outs[root]), len(open_))]
        low[root] = len(low)
        open_.append(root)
        number = {root: low[root]}
        while todo:
            node, rest, place = todo[-1]
            for to in rest:
                if to not in low:
                    number[to] = low[to] = len(low)
                    todo.append((to, iter(outs[to]), len(open_)))
                    open_.append(to)
                    break
                if to not in done:
                    low[node] = min(low[node], low[to])
            else:
                todo.pop()
                if low[node] == number[node]:
                    members = open_[place:]
                    del open_[place:]
                    done.update(members)
                    if len(members) > 1:
                        found |= dict.fromkeys(members, min(members))
                if todo and node not in done:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
    return found


def near(edges: DataFrame) -> DataFrame:
    """upstream, downstream, held: edges in which sets found in stretches of nodes near each other are drawn together, and (held) each of their nodes with its set's least.

    Edges are sorted by upstream into ranges and read in stretches of about STRETCH; what is strongly connected within one is so in the whole graph. Edges of an
    upstream that fills a stretch by itself are passed on as they are.
    """

    def table(rest, sets: dict) -> pd.DataFrame:
        return pd.DataFrame({"upstream": [*(a for a, _ in rest), *sets], "downstream": [*(b for _, b in rest), *sets.values()], "held": [False] * len(rest) + [True] * len(sets)})

    def close(outs: dict) -> pd.DataFrame:
        sets = _sets({node: [to for to in tos if to in outs] for node, tos in outs.items()})
        ends = [(sets.get(a, a), sets.get(b, b)) for a, tos in outs.items() for b in tos]
        rest = {(a, b) for a, b in ends if a != b} | {(a, a) for a, tos in outs.items() if a in tos and a not in sets}
        return table(rest, sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outs, last, n, hub, passed = {}, None, 0, False, []
        for pdf in batches:
            for a, b in zip(pdf["upstream"].tolist(), pdf["downstream"].tolist(), strict=True):
                if n >= STRETCH:
                    if len(outs) > 1 and a != last:
                        yield close(outs)
                        outs, n = {}, 0
                    elif len(outs) > 1:  # its edges begin the next stretch
                        mine = outs.pop(last)
                        yield close(outs)
                        outs, n = {last: mine}, len(mine)
                    else:  # an upstream that fills a stretch
                        passed += [(last, to) for to in outs.pop(last)]
                        n, hub = 0, True
                if a != last:
                    last, hub = a, False
                if hub:
                    passed.append((a, b))
                    continue
                tos = outs.setdefault(a, set())
                n += b not in tos
                tos.add(b)
            if passed:
                yield table(passed, {})
                passed = []
        if outs:
            yield close(outs)

    e = edges.where("upstream is not null and downstream is not null").select("upstream", "downstream").repartitionByRange("upstream").sortWithinPartitions("upstream")
    kind = e.schema["upstream"].dataType.simpleString()
    return e.mapInPandas(run, f"upstream {kind}, downstream {kind}, held boolean")


def cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, cycle (its least node) of every node on a cycle, that is of every strongly connected set.

    By colouring: the least node from which a node can be reached is its colour; a node of its own colour is the least of its set, and the
    set is what reaches that node within the colour. Sets that are found go, and the rest is coloured anew. Each round's rows are as many as
    nodes and edges, however large a set is.
    """
    e, n = _trimmed(_cut(edges.select("upstream", "downstream").distinct()), rounds)
    found = None
    while n:
        colour = _cut(e.select(F.col("upstream").alias("node")).union(e.select("downstream")).distinct().withColumn("colour", F.col("node")))
        mark = None
        for _ in range(rounds):
            passed = e.join(colour.withColumnRenamed("node", "upstream"), "upstream").select(F.col("downstream").alias("node"), "colour")
            colour = _cut(colour.union(passed).groupBy("node").agg(F.min("colour").alias("colour")), colour)
            row = colour.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
            if row == mark:
                break
            mark = row
        else:
            raise RuntimeError("no fixed point")
        up, down = (colour.select(F.col("node").alias(k), F.col("colour").alias(f"{k}_colour")) for k in ("upstream", "downstream"))
        inside = _cut(e.join(up, "upstream").join(down, "downstream").where("upstream_colour = downstream_colour").select("upstream", "downstream", F.col("upstream_colour").alias("colour")))
        reach, size = _cut(colour.where("node = colour")), None
        for _ in range(rounds):
            back = inside.join(reach.select(F.col("node").alias("downstream"), "colour"), ["downstream", "colour"]).select(F.col("upstream").alias("node"), "colour")
            reach = _cut(reach.union(back).distinct(), reach)
            if (m := reach.count()) == size:
                break
            size = m
        else:
            raise RuntimeError("no fixed point")
        loops = e.where("upstream = downstream").select(F.col("upstream").alias("node")).distinct().withColumn("loop", F.lit(True))
        sizes = reach.groupBy("colour").agg(F.count("*").alias("n"))
        real = reach.join(sizes, "colour").join(loops, "node", "left").where("n > 1 or loop").select("node", F.col("colour").alias("cycle"))
        found = _cut(real) if found is None else _cut(found.union(real), found)
        gone = reach.select("node")
        e = _cut(e.join(gone.withColumnRenamed("node", "upstream"), "upstream", "left_anti").join(gone.withColumnRenamed("node", "downstream"), "downstream", "left_anti").select("upstream", "downstream"), e)
        e, n = _trimmed(e, rounds)
    return found if found is not None else e.select(F.col("upstream").alias("node"), F.col("upstream").alias("cycle")).limit(0)


def cycles_near(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """cycles(), where many sets are of nodes whose keys are near each other.

    Sets of nodes near each other are found in one pass and drawn together into their least node (near()); what goes between stretches is left to cycles().
    """
    drawn = _cut(near(edges))
    sets = drawn.where("held").select(F.col("upstream").alias("node"), F.col("downstream").alias("cycle"))
    left = drawn.where("not held").select("upstream", "downstream")
    if left.isEmpty():
        return sets
    to = left.join(sets.withColumnRenamed("node", "downstream"), "downstream", "left").select("upstream", F.coalesce("cycle", "downstream").alias("downstream"), F.col("cycle").isNotNull().alias("_in"))
    wide = cycles(to.where("upstream <> downstream or not _in").select("upstream", "downstream"), rounds)
    of = wide.select(F.col("node").alias("cycle"), F.col("cycle").alias("_wide"))
    whole = sets.join(of, "cycle", "left").select("node", F.coalesce("_wide", "cycle").alias("cycle"))
    return whole.unionByName(wide.join(sets.select("node"), "node", "left_anti"))


def roots_leaves(edges: DataFrame) -> DataFrame:
    """node, is_root (nothing upstream), is_leaf (nothing downstream)."""
    up, down = edges.select(F.col("upstream").alias("node"), F.lit(1).alias("u"), F.lit(0).alias("d")), edges.select(F.col("downstream").alias("node"), F.lit(0).alias("u"), F.lit(1).alias("d"))
    return up.union(down).groupBy("node").agg((F.max("d") == 0).cast("int").alias("is_root"), (F.max("u") == 0).cast("int").alias("is_leaf"))


def fold_edges(edges: DataFrame) -> DataFrame:
    """Mirrored import and export records of one dependency become one edge with its sorted subjects."""
    up = F.when(F.col("kind") == "export", F.col("src")).otherwise(F.col("dst"))
    down = F.when(F.col("kind") == "export", F.col("dst")).otherwise(F.col("src"))
    return edges.select(up.alias("upstream"), down.alias("downstream"), "subject").groupBy("upstream", "downstream").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))


def references(uses: DataFrame, makes: DataFrame, files: int, exempt: Sequence[str] = ()) -> DataFrame:
    """How each use (source, name) is met: own, import, unresolved, or external if there is only one file; exempt names are external."""
    makers = makes.select(F.col("source").alias("maker"), "name").distinct()
    m = uses.select("source", "name").distinct().join(makers, "name", "left").groupBy("source", "name").agg(F.max((F.col("maker") == F.col("source")).cast("int")).alias("own"), F.count("maker").alias("n"))
    rest = F.when(F.col("name").isin(list(exempt)) | F.lit(files < 2), "external").otherwise("unresolved")
    return m.select("source", "name", F.when(F.col("own") == 1, "own").when(F.col("n") > 0, "import").otherwise(rest).alias("status"))


def profiles(uses: DataFrame, makes: DataFrame, files: int, exempt: Sequence[str] = ()) -> DataFrame:
    """source, depends_on, depended_on_by, imports, exports, unresolved (sorted arrays) of every source that uses or makes a name.

    A source that makes a name itself doesn't import it; each user of a name depends on all its makers.
    """
    met = references(uses, makes, files, exempt)
    makers = makes.select(F.col("source").alias("maker"), "name").distinct()
    links = met.where("status = 'import'").join(makers, "name")
    of = lambda c: F.sort_array(F.collect_set(c))
    down = links.groupBy("source").agg(of("maker").alias("depends_on"), of("name").alias("imports"))
    up = links.groupBy(F.col("maker").alias("source")).agg(of("source").alias("depended_on_by"), of("name").alias("exports"))
    lost = met.where("status = 'unresolved'").groupBy("source").agg(of("name").alias("unresolved"))
    every = uses.select("source").union(makes.select("source")).distinct().join(down, "source", "left").join(up, "source", "left").join(lost, "source", "left")
    nothing = F.array()
    arrays = ["depends_on", "depended_on_by", "imports", "exports", "unresolved"]
    return every.select("source", *[F.coalesce(c, nothing.cast(every.schema[c].dataType)).alias(c) for c in arrays])
