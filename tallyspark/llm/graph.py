"""Connected components of a link table, by alternating large-star and small-star steps.

Each step moves links towards the least node of their neighbourhood and keeps at most as many links as before,
so hubs never make pairs of their neighbours. Steps end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace, small

STEPS = 60


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """links(src long, dst long) -> (node, component): every node of a link, and the least node it can reach.

    Links are kept as (u, v) with u > v, so the least neighbour of a node is the least v of its rows, or the node
    itself. Least neighbours are written before they are joined: both sides of the join are then plain exchanges,
    and one that a hub makes uneven is split.
    """
    oriented = lambda df: df.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, seen = work.save(oriented(links), f"{name}-0"), None
    for step in range(1, STEPS + 1):
        low = work.save(now.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        moved = now.join(small(low.withColumnRenamed("u", "v")), "v", "left").select(F.col("u").alias("src"), F.coalesce("m", "v").alias("dst"))
        large = work.save(oriented(moved), f"{name}-large")
        low = work.save(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low2")
        # a node's own link to m comes once from low, the links of its other neighbours from large
        others = large.join(small(low), "u").where("v > m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        now = work.save(oriented(others.unionByName(low.select(F.col("u").alias("src"), F.col("m").alias("dst")))), f"{name}-{step}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        work.drop(f"{name}-{step - 1}", f"{name}-low", f"{name}-large", f"{name}-low2")
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {STEPS} steps")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def to_blocks(members: DataFrame, n_members: int, block: int) -> DataFrame:
    """Deal members(cluster, q, chunk, id, ...) into blocks (alone, g, a, b) that hold two chunks at most.

    A cluster of one chunk goes to a bin with other such clusters. A cluster of q chunks has a block for each
    two of its chunks, so that every pair of its members meets in exactly one block.
    """
    bins = -(-n_members // block) or 1
    alone = F.col("q") == 1
    other = F.explode(F.sequence(F.lit(0), F.col("q").cast("int") - 1)).alias("__other")
    place = [alone.alias("alone"), F.when(alone, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("g"), F.least("chunk", "__other").alias("a"), F.greatest("chunk", "__other").alias("b")]
    return members.select("*", other).select(*members.columns, *place)
