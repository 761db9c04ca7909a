"""Trees as intervals: an Euler tour by list ranking, and what it gives without a closure.

A tree's tour goes down to every node and up again. Its steps form a list, which pointer doubling ranks in as many
rounds as the logarithm of its length; n nodes cost n log n rows, whatever the depth. A node's preorder number and
the number of nodes below it are then an interval, and questions about all descendants become questions about running
values over the preorder (see scan). Questions about ancestors are answered by doubling that carries what was found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import Scratch
from .scan import SPLIT_ROWS, Running, in_order, scan

MOST_ROUNDS = 60


def euler_tour(edges: DataFrame, work: Scratch, name: str = "tour") -> DataFrame:
    """edges(src, dst), from child to parent and without cycles -> node, parent, root, pre (0 at the root, children in
    order), size (nodes of its tree from it downwards, itself included), depth.

    A step is (node, up): down to a node or up from it. After the down step of a node comes that of its first child, or
    its up step; after an up step the next sibling's down step, or the parent's up step.
    """
    kind = edges.schema["src"].dataType
    known = work.save(edges.select(F.col("src").alias("node"), F.col("dst").cast(kind).alias("parent")), f"{name}-edges")
    roots = known.select("parent").distinct().join(known.select(F.col("node").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("node"))
    ranges = work.save(in_order(known, "parent", "node"), f"{name}-ranges")
    placed = work.save(scan(ranges, {"elder": Running("last", F.col("node"), before=True)}, key=["parent"], split="split", order="place").select("node", "parent", "elder"), f"{name}-siblings")
    true, false = F.lit(True), F.lit(False)
    # where each down step is reached from; a node without children goes straight up
    entered = placed.select(F.coalesce("elder", "parent").alias("node"), F.col("elder").isNotNull().alias("up"), F.col("node").alias("next"), false.alias("next_up"))
    youngest = placed.join(placed.select(F.col("elder").alias("node")), "node", "left_anti")
    left = youngest.select("node", true.alias("up"), F.col("parent").alias("next"), true.alias("next_up"))
    leaves = known.join(known.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("node", false.alias("up"), F.col("node").alias("next"), true.alias("next_up"))
    ends = roots.select("node", true.alias("up"), F.lit(None).cast(kind).alias("next"), F.lit(None).cast("boolean").alias("next_up"))
    steps = entered.unionByName(left).unionByName(leaves).unionByName(ends)
    # rank: down steps from here to the end; height: down less up steps, of which the end has none left
    weight = F.when(F.col("up"), 0).otherwise(1).cast("long")
    rise = F.when(F.col("up"), -1).otherwise(1).cast("long")
    ranked = work.save(steps.select("node", "up", "next", "next_up", F.when(F.col("next").isNull(), F.col("node")).alias("end"), weight.alias("rank"), rise.alias("height")), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        onward = ranked.select(F.col("node").alias("next"), F.col("up").alias("next_up"), F.col("next").alias("far"), F.col("next_up").alias("far_up"), F.col("end").alias("far_end"), F.col("rank").alias("more"), F.col("height").alias("rest"))
        open_ = ranked.where("next is not null").join(onward, ["next", "next_up"]).select("node", "up", F.col("far").alias("next"), F.col("far_up").alias("next_up"), F.col("far_end").alias("end"), (F.col("rank") + F.col("more")).alias("rank"), (F.col("height") + F.col("rest")).alias("height"))
        ranked = work.save(ranked.where("next is null").unionByName(open_), f"{name}-{k}")
        if ranked.where("next is not null").isEmpty():
            break
    else:
        raise ValueError("the edges have a cycle")
    down = ranked.where("not up").select("node", F.col("end").alias("root"), "rank", "height")
    up = ranked.where("up").select("node", F.col("rank").alias("after"))
    total = down.where("node = root").select("root", F.col("rank").alias("total"))
    out = down.join(up, "node").join(total, "root").join(known, "node", "left")
    # height counts the own step; from a node's down step to the end all that is open above it is closed
    return work.save(out.select("node", "parent", "root", (F.col("total") - F.col("rank")).alias("pre"), (F.col("rank") - F.col("after")).alias("size"), (-F.col("height")).alias("depth")), name)


def nearest_label(edges: DataFrame, labels: DataFrame, work: Scratch, name: str = "nearest") -> DataFrame:
    """edges(src, dst) to parents, labels(node, label), a label at most each -> node, label, distance of the nearest ancestor that has
    one. A pointer skips what was searched, and stops where something is found; a round writes what is still open."""
    labels = work.save(labels.select("node", "label"), f"{name}-labels")
    parent = edges.select(F.col("src").alias("node"), F.col("dst").alias("at"))
    state = parent.join(labels.select(F.col("node").alias("at"), "label"), "at", "left")
    state = work.save(state.select("node", "at", "label", F.when(F.col("label").isNotNull(), 1).cast("long").alias("distance"), F.lit(1).cast("long").alias("span")), f"{name}-0")
    for k in range(1, MOST_ROUNDS):
        onward = state.select(F.col("node").alias("at"), F.col("at").alias("far"), F.col("label").alias("found"), F.col("distance").alias("more"), F.col("span").alias("on"))
        open_ = state.where("label is null and at is not null").join(onward, "at", "left")
        moved = open_.select("node", F.col("far").alias("at"), F.col("found").alias("label"), (F.col("span") + F.col("more")).alias("distance"), (F.col("span") + F.coalesce("on", F.lit(0))).alias("span"))
        state = work.save(state.where("label is not null or at is null").unionByName(moved), f"{name}-{k}")
        if state.where("label is null and at is not null").isEmpty():
            return state.where("label is not null").select("node", "label", "distance")
    raise ValueError("the edges have a cycle")


def descendant_agreement(tour: DataFrame, labels: DataFrame, work: Scratch, name: str = "below", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """tour: see euler_tour; labels(node, label), a label at most each -> node, labelled (descendants that have one), label (the
    one that all of these have, else null).

    Along the preorder the labels that follow a different one are counted. A node's descendants agree if the count
    rises no more after the first label among them.
    """
    by = {"key": ["root"], "split": "split", "order": "pre"}
    rows = tour.join(labels.select("node", "label"), "node", "left").withColumn("split", F.floor(F.col("pre") / split_rows))
    rows = work.save(rows.select("node", "root", "pre", "size", "split", "label"), f"{name}-labels")
    rows = work.save(scan(rows, {"was": Running("last", F.col("label"), before=True)}, **by), f"{name}-was")
    new = F.coalesce(F.col("label") != F.col("was"), F.lit(False)).cast("long")
    rows = scan(rows, {"nth": Running("sum", F.col("label").isNotNull().cast("long")), "changes": Running("sum", new)}, **by)
    rows = work.save(rows.select("node", "root", "pre", "size", "label", "nth", "changes"), f"{name}-counts")
    last = rows.select("root", F.col("pre").alias("last"), F.col("nth").alias("nth_last"), F.col("changes").alias("changes_last"))
    first = rows.where("label is not null").select("root", F.col("nth").alias("first"), F.col("label").alias("one"), F.col("changes").alias("changes_first"))
    inner = rows.where("size > 1").select("node", "root", "nth", (F.col("nth") + 1).alias("first"), (F.col("pre") + F.col("size") - 1).alias("last"))
    found = inner.join(last, ["root", "last"]).where("nth_last > nth").join(first, ["root", "first"])
    return found.select("node", (F.col("nth_last") - F.col("nth")).alias("labelled"), F.when(F.col("changes_first") == F.col("changes_last"), F.col("one")).alias("label"))
