import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.attribution import lineage_hints
from tallyspark.operators.graph import roots
from tallyspark.operators.tour import descendant_agreement, euler_tour, nearest_label
from tallyspark.work import Scratch

EDGES = "src string, dst string"


def forest(seed, n):
    """child -> parent of a few trees, with a hub and a chain among them."""
    r = random.Random(seed)
    names = [f"n{k:03d}" for k in range(n)]
    up = {names[k]: names[r.randrange(max(0, k - 8), k)] for k in range(1, n) if r.random() < 0.93}
    up |= {f"leaf{k}": names[0] for k in range(30)}
    return up | {f"c{k:02d}": f"c{k - 1:02d}" for k in range(1, 25)}


def walk(up):
    """node -> (root, pre, size, depth), by recursion over sorted children."""
    below = {}
    for child, parent in up.items():
        below.setdefault(parent, []).append(child)
    found = {}

    def visit(node, root, at, depth):
        size = 1
        for child in sorted(below.get(node, [])):
            size += visit(child, root, at + size, depth + 1)
        found[node] = (root, at, size, depth)
        return size

    for root in set(up.values()) - set(up):
        visit(root, root, 0, 0)
    return found


def ancestors(up, node):
    while node in up:
        node = up[node]
        yield node


@pytest.mark.parametrize("seed", [1, 2])
def test_tour_and_questions_about_relatives(spark, seed):
    up, r, work = forest(seed, 60), random.Random(seed), Scratch(spark)
    edges = work.save(spark.createDataFrame(list(up.items()), EDGES).repartition(4), "edges")
    tour = euler_tour(edges, work)
    want = walk(up)
    assert {x["node"]: (x["root"], x["pre"], x["size"], x["depth"]) for x in tour.collect()} == want
    assert {x["node"]: x["parent"] for x in tour.collect()} == {n: up.get(n) for n in want}

    labels = {n: r.choice("aaab") for n in want if r.random() < 0.3}
    given = spark.createDataFrame(list(labels.items()), "node string, label string")
    near = {n: next(((labels[a], k) for k, a in enumerate(ancestors(up, n), 1) if a in labels), None) for n in want}
    got = {x["node"]: (x["label"], x["distance"]) for x in nearest_label(edges, given, work).collect()}
    assert got == {n: v for n, v in near.items() if v}

    below = {}
    for n, label in labels.items():
        for a in ancestors(up, n):
            below.setdefault(a, []).append(label)
    agreed = {n: (len(v), v[0] if len(set(v)) == 1 else None) for n, v in below.items()}
    for split_rows in (2, 1000):
        got = descendant_agreement(tour, given, Scratch(spark), split_rows=split_rows)
        assert {x["node"]: (x["labelled"], x["label"]) for x in got.collect()} == agreed


def test_no_edges(spark):
    work = Scratch(spark)
    edges = spark.createDataFrame([], EDGES)
    assert euler_tour(edges, work).isEmpty()
    assert nearest_label(edges, spark.createDataFrame([("a", "x")], "node string, label string"), work).isEmpty()


def test_cycles_are_refused(spark, monkeypatch):
    from tallyspark.operators import tour

    monkeypatch.setattr(tour, "MOST_ROUNDS", 6)
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], EDGES)
    with pytest.raises(ValueError, match="cycle"):
        nearest_label(edges, spark.createDataFrame([], "node string, label string"), Scratch(spark))


def test_hints_on_a_long_chain_write_no_closure(spark):
    """A closure of this chain has 18 million rows."""
    n, work = 6000, Scratch(spark)
    parents = work.save(spark.range(1, n).select(F.format_string("t%05d", "id").alias("child"), F.format_string("t%05d", F.col("id") - 1).alias("parent")), "chain")
    threads = work.save(spark.range(n).select(F.format_string("t%05d", "id").alias("thread_id")), "threads")
    direct = spark.createDataFrame([("t00100", "p"), ("t05000", "q"), ("t05000", "r"), ("t05500", "s")], "thread_id string, identity string")
    own = Scratch(spark)
    found = lineage_hints(threads, parents, roots(threads, parents, None, work), direct, own)
    found = {r["thread_id"]: (r["ancestor_project"], r["root_project"], r["descendant_projects"]) for r in found.collect()}
    assert found["t00000"] == (None, None, None)  # p and s below
    assert found["t00101"] == ("p", None, ["s"])
    assert found["t05200"] == ("s", None, ["s"])  # what silent threads borrow is a hint for those below
    assert found["t05999"] == ("s", None, None)
    written = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").format("binaryFile").load(own.root).select("path").collect()
    rows = sum(spark.read.parquet(r["path"]).count() for r in written[:: max(len(written) // 40, 1)]) * max(len(written) // 40, 1)
    assert rows < 2 * 2 * n * 30  # tour: 2 n steps, 13 rounds; labels: n, 13 rounds; a sample of the files stands for all
