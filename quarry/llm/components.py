"""Connected components of an edge table by alternating large-star and small-star steps, distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (hi, lo), hi > lo: each node's larger (large) or smaller neighbours are tied to its smallest neighbour."""
    if large:
        around = edges.union(edges.select("lo", "hi")).toDF("u", "v")
    else:
        around = edges.toDF("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    tied = around.join(least, "u")
    tied = tied.where("v > u") if large else tied
    out = tied.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    if not large:
        out = out.union(least.select("u", "m"))
    return out.where("hi > lo").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node with an edge; edges: two long columns, any order, repeats allowed.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most; the round before is then
    deleted.
    """
    a, b = edges.columns
    now = written(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        row = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct()
    out = now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    out.written_to = now.written_to
    return out
