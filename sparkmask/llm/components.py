"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is a few joins on node ids over the edges alone; its result is written to the shared folder,
so that a round costs no recomputation of earlier ones and survives lost executors. Least neighbours are
partial minima, and edges meet them in joins that adaptive execution can split, so the hub of a large star is no
single task's work. The driver sees whether a table is empty, never nodes or edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_few


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of edges (a, b) but roots: root is the smallest node reachable.

    Loops and repeated edges don't matter; no edges give no rows. Nodes are longs and not null.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before = scratch.write(e.distinct(), "edges")
    rows = 2 * before.count()
    e = in_few(before, rows)
    while not stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = in_few(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), rows).distinct()
        large = in_few(large, rows)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = scratch.write(in_few(in_few(small, rows).distinct(), rows), "star")
        scratch.drop(before)
        before, e = new, in_few(new, rows)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def stars(e: DataFrame) -> bool:
    """Whether each node of edges (u, v) has one edge to a lower node, or is such a lower node, but not both."""
    each = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("v", F.lit(0), F.lit(1)))
    return each.groupBy("u").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()
