"""Connected components over tables of links, by alternating large and small stars.

Each pass is a few equi-joins and aggregations; tables between passes are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Scratch, broadcast_if_small

SMALL = 500_000


def _star(edges: DataFrame, small: bool, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v), stored. Large star: links each larger neighbour of u to the least of u and its neighbours. Small star: the same for smaller neighbours and u.

    The least neighbours are stored first, so that the join has plain sides: few of them are broadcast, many are
    shuffled, and then a node with very many links is split over tasks at run time.
    """
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
    joined = around.join(broadcast_if_small(least, SMALL), "u")
    if small:
        out = joined.select(F.col("v").alias("u"), "m").union(least.select("u", "m"))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), "m")
    out = scratch.table(out.where("u != m").select("u", F.col("m").alias("v")).distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node that has a link to another: the least node it can reach.

    edges (a, b): null ends and self-links are ignored; rows may repeat.
    """
    now = scratch.table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u != v").distinct(), f"{name}-0")
    last, k = None, 0
    while True:
        k += 1
        large = _star(now, False, scratch, f"{name}-{k}-large")
        step = _star(large, True, scratch, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = step
        if mark == last:
            break
        last = mark
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
