"""Connected components of an edge table, by alternating star contraction.

Each round hooks every node's larger neighbours (then its smaller ones and
itself) onto the smallest neighbour; it ends when the edges no longer
change, as a forest of stars around each component's smallest node.  All
steps are joins and partial aggregates, with a staged table per round; no
adjacency list is ever gathered, so a hub of any degree is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cirro.llm.storage import drop, stage


def _hook(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (a, b) edges with a > b."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        out = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Self loops, repeated and reversed edges are allowed; null ends are dropped.
    """
    cur = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull()).where("a > b").distinct()
    cur = stage(cur, "edges")
    seen = None
    while True:
        nxt = stage(_hook(_hook(cur, True), False), "edges")
        drop(cur)
        cur = nxt
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    inner = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return inner.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
