"""Graphs in which a node has one outgoing edge at most (parents, forks, aliases), by pointer doubling.

k rounds of joins reach 2**k steps, so depth costs its logarithm in shuffles; every round is written to the
shared folder. Edges are (src, dst) with distinct src; values of any type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..work import Scratch

MOST_ROUNDS = 60


def cycle_nodes(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node): all nodes on cycles. After as many steps as there are nodes, a walk stands on a cycle or has ended."""
    jump, n = work.save(edges.select("src", "dst"), f"{name}-0"), edges.count()
    for k in range(1, max(n, 1).bit_length() + 1):
        second = jump.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        jump = work.save(jump.join(second, "dst").select("src", F.col("far").alias("dst")), f"{name}-{k}")
        if jump.isEmpty():
            break
    return jump.select(F.col("dst").alias("node")).distinct()


def ancestors(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, ancestor, depth) for all ancestors, nearest at depth 1. The edges have no cycles."""
    jump = edges.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"))
    reach = work.save(jump.withColumn("depth", F.lit(1).cast("long")), f"{name}-r0")
    jump = reach.select("node", "ancestor")
    for k in range(MOST_ROUNDS):
        hop = jump.select("node", F.col("ancestor").alias("via"))
        far = reach.select(F.col("node").alias("via"), "ancestor", (F.col("depth") + (1 << k)).alias("depth"))
        more = work.save(hop.join(far, "via").select("node", "ancestor", "depth"), f"{name}-m{k}")
        if more.isEmpty():
            return reach
        reach = work.save(reach.unionByName(more), f"{name}-r{k + 1}")
        jump = more.where(F.col("depth") == (2 << k)).select("node", "ancestor")
    raise ValueError("the edges have a cycle")


def terminals(edges: DataFrame, work: Scratch, name: str) -> DataFrame:
    """(node, terminal, depth) of every node with an edge. The edges have no cycles."""
    state = work.save(edges.select(F.col("src").alias("node"), F.col("dst").alias("terminal"), F.lit(1).cast("long").alias("depth")), f"{name}-t0")
    for k in range(1, MOST_ROUNDS):
        on = state.select(F.col("node").alias("terminal"), F.col("terminal").alias("far"), F.col("depth").alias("more"))
        moved = state.join(on, "terminal", "left").select("node", F.coalesce("far", "terminal").alias("terminal"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved"))
        moved = work.save(moved, f"{name}-t{k}")
        state = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return state
    raise ValueError("the edges have a cycle")


def flatten_aliases(edges: DataFrame, work: Scratch, name: str = "aliases") -> tuple[DataFrame, DataFrame]:
    """(aliases, cycles). aliases: source, target (terminal), depth; tails that lead into a cycle end at its first
    node, and the nodes of cycles have no alias. cycles: node."""
    edges = work.save(edges.select("src", "dst"), f"{name}-edges")
    cycles = work.save(cycle_nodes(edges, work, f"{name}-cycles"), f"{name}-cyclic")
    open_edges = edges.join(cycles.select(F.col("node").alias("src")), "src", "left_anti")
    flat = terminals(open_edges, work, name).select(F.col("node").alias("source"), F.col("terminal").alias("target"), "depth")
    return flat, cycles


def would_close_cycle(edges: DataFrame, new: DataFrame, work: Scratch, name: str = "new") -> DataFrame:
    """Rows of new(src, dst) that would each close a cycle: dst is src or leads to it. The sources of new rows lose
    the edges they had, so whoever leads to one ends there."""
    known = edges.join(new.select("src"), "src", "left_anti").select("src", "dst")
    cyclic = cycle_nodes(known, work, f"{name}-cycles")
    open_edges = known.join(cyclic.withColumnRenamed("node", "src"), "src", "left_anti")
    reach = terminals(open_edges, work, f"{name}-reach").select(F.col("node").alias("dst"), F.col("terminal").alias("src"))
    return new.where("src = dst").unionByName(new.where("src <> dst").join(reach, ["dst", "src"], "left_semi").select(*new.columns))


# How much a source of parent evidence counts.
PRIORITY = {"sqlite_spawn": 30, "session_source": 20, "fork": 10}


def select_parents(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """candidates(child, parent, source) -> (parents: child, parent; issues: child, parent, code). Self-parents go,
    the best source decides, and two parents of equal rank make none."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(p)) for s, p in PRIORITY.items()], F.lit(0))
    rows = candidates.select("child", "parent", rank.alias("priority")).distinct()
    others = rows.where("child <> parent").withColumn("best", F.max("priority").over(Window.partitionBy("child")))
    top = others.where("priority = best").groupBy("child").agg(F.collect_set("parent").alias("found"))
    parents = top.where(F.size("found") == 1).select("child", F.get("found", F.lit(0)).alias("parent"))
    conflicts = top.where(F.size("found") > 1).select("child", F.explode("found").alias("parent"), F.lit("conflicting_parent_ignored").alias("code"))
    lower = others.where("priority < best").join(parents.withColumnRenamed("parent", "chosen"), "child", "left").where("chosen is null or parent <> chosen").select("child", "parent", F.lit("lower_priority_parent_ignored").alias("code")).distinct()
    selfish = rows.where("child = parent").select("child", "parent", F.lit("self_parent_ignored").alias("code")).distinct()
    return parents, selfish.unionByName(conflicts).unionByName(lower)


def build_lineage(candidates: DataFrame, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Selected parents without the edges of cycle nodes, and the issues of both steps."""
    parents, issues = select_parents(candidates)
    edges = work.save(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), "parents")
    cyclic = work.save(cycle_nodes(edges, work, "lineage").withColumnRenamed("node", "src"), "cyclic")
    lost = edges.join(cyclic, "src", "left_semi").select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit("lineage_cycle_ignored").alias("code"))
    return edges.join(cyclic, "src", "left_anti").select(F.col("src").alias("child"), F.col("dst").alias("parent")), issues.unionByName(lost)


def roots(threads: DataFrame, parents: DataFrame, declared: DataFrame | None, work: Scratch) -> DataFrame:
    """threads(thread_id) -> thread_id, root: the declared one, else the last ancestor, else the thread."""
    last = terminals(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")), work, "roots").select(F.col("node").alias("thread_id"), "terminal")
    rows = threads.select("thread_id").distinct().join(last, "thread_id", "left")
    if declared is None:
        return rows.select("thread_id", F.coalesce("terminal", "thread_id").alias("root"))
    return rows.join(declared.select("thread_id", F.col("root").alias("declared")), "thread_id", "left").select("thread_id", F.coalesce("declared", "terminal", "thread_id").alias("root"))
