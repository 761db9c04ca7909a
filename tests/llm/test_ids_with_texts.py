"""Near-duplicates where an id occurs with several texts, against brute force over (id, text)."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tallyspark.llm import neardup

from .test_operators import SF, components, shingle_set


def planted():
    rng = np.random.default_rng(3)
    base = [rng.choice([f"w{i}" for i in range(400)], 120).tolist() for _ in range(5)]
    text = lambda k, change=None: " ".join(base[k][:-1] + [change] if change else base[k])
    return [
        (1, text(0)), (1, text(1)),  # the least id of two classes
        (10, text(0, "x")), (11, text(1, "x")),
        (12, text(0)), (13, text(1)),
        (20, text(2)), (20, text(3)), (5, text(3, "y")),  # only one text of 20 is a near copy
        (30, text(4)), (30, text(4, "z")),  # near copies with one id
        (503, "x"), (503, "x"), (504, "x"), (505, None), (505, "alone with this id"), (506, ""), (506, ""),
    ]


def test_nodes_are_ids_with_texts(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", neardup.F.lit("a"))
    nodes = sorted(set(rows), key=str)
    sets = {n: shingle_set(n[1]) for n in nodes}
    pairs = [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    degree = Counter(x for p in pairs for x in p)
    number = {n: k for k, n in enumerate(nodes)}
    group = components([(number[a], number[b]) for a, b in pairs], number.values())
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in frame.selectExpr("*", "xxhash64(text) AS h").collect()}
    least = {}
    for n in nodes:
        least[group[number[n]]] = min(least.get(group[number[n]], (1 << 62, 0)), (n[0], hashes[n]))
    want = sorted((n[0], hashes[n], *least[group[number[n]]], degree[n]) for n in rows)
    assert sorted(tuple(r) for r in neardup.near_duplicates(frame).collect()) == want

    kept = sorted((r["doc_id"], str(r["text"])) for r in corpus_pipeline.drop_near_duplicates(spark, frame, SF).collect())
    assert kept == sorted((i, str(t)) for i, t in nodes if (i, hashes[i, t]) == least[group[number[i, t]]])
    again = corpus_pipeline.drop_near_duplicates(spark, frame.repartition(7), SF).collect()
    assert kept == sorted((r["doc_id"], str(r["text"])) for r in again)
