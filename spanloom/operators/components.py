"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component, for nodes of at least one edge.

    Alternates two steps over the edges until nothing moves: each node's larger neighbours, then its smaller ones, are
    linked to the smallest node around it. The number of rounds grows with the logarithm of the longest path. Each round
    is written to the shared folder. Null ends are left out, loops count as nodes of their own.
    """
    rows = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = rows.select("u").union(rows.select("v")).distinct()
    pairs = materialize(rows.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if pairs.isEmpty():
        return nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node points to the smallest of the node and its neighbours
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node's smaller neighbours, and the node, point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        pairs = materialize(small, "edges")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, "u", "left").select(F.col("u").alias("node"), F.coalesce("component", "u").alias("component"))
