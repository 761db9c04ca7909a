import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import centroids as C


def plain(points, at):
    """Nearest centroids and squared distances in Python's integers."""
    found = [min((sum((int(a) - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(at)) for p in points]
    return [k for _, k in found], [d if d < 2**63 else None for d, _ in found]


def brute(rows, centroids, rounds, dimensions):
    """(vec_id, cluster, distance, ...) of rows (vec_id, embedding), without Spark or numpy."""
    kept = [(i, [int(np.floor(256.0 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and np.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    at = [p for _, p in order[:centroids]]
    for _ in range(rounds):
        own, _ = plain([p for _, p in kept], at)
        at = [[sum(v) // own.count(k) for v in zip(*[p for (_, p), o in zip(kept, own, strict=True) if o == k], strict=True)] if k in own else at[k] for k in range(len(at))]
    own, far = plain([p for _, p in kept], at)
    inertia = [sum(d for d, o in zip(far, own, strict=True) if o == k) for k in range(len(at))]
    return sorted([(i, o, d, inertia[o], sum(far), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, far, strict=True)], key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 1000, 2**20, 2**26, 2**30]), st.sampled_from([1, 3, 64]))
def test_nearest_is_exact(seed, size, dimensions):
    r = np.random.default_rng(seed)
    at = r.integers(-size, size, (7, dimensions)).tolist()
    at += [list(at[2])]  # a tie of whole centroids
    points = r.integers(-size, size, (40, dimensions)).astype(np.float64)
    points[:7] = at[:7]
    # on the middle between two centroids, and one off it
    middle = (np.array(at[0]) + np.array(at[1])) // 2
    points[7], points[8] = middle, middle + 1
    assert [list(x) for x in map(list, C.nearest(points, at))] == [list(x) for x in plain(points, at)]


def test_interval_keeps_the_nearest_of_close_centroids():
    """Distances that float32 cannot tell apart."""
    base = 2**26
    at = [[base + k] + [base] * 63 for k in range(8)]
    points = np.array([[base + 3] + [base] * 63, [base + 5] + [base + 1] * 63], dtype=np.float64)
    mask = C.shortlist(points.astype(np.int64), np.array(at))
    assert mask.sum() > 2  # the screen alone does not decide
    assert C.nearest(points, at)[0].tolist() == [3, 5]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_brute_force(spark, kind):
    r = np.random.default_rng(5)
    hubs = r.normal(size=(4, 64))
    rows = [(k, [float(x) for x in np.float32(hubs[k % 4] + r.normal(size=64) * 0.3)]) for k in range(90)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (200, rows[5][1])]  # repeated rows, ids and vectors
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [None] + [0.5] * 63), (305, [float("nan")] + [0.5] * 63), (306, [float("inf")] + [0.5] * 63), (None, rows[6][1])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int").repartition(5)
    got = C.cluster_vectors(df, centroids=6, rounds=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 6, 3, 64)


def test_few_none_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert C.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.5] * 64)]
    got = C.cluster_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 40, 5, 64)
    big = [(1, [1e30] * 64), (2, [1.0] * 64), (3, [3e30] * 64)]
    got = {r["vec_id"]: r for r in C.cluster_vectors(spark.createDataFrame(big, schema), centroids=2, rounds=1).collect()}
    assert len(got) == 3 and got[2]["inertia"] is None  # beyond a long
