"""Centroid clustering in exact integers, screened in single precision.

Vectors become integer points, floor(256 * x). A round assigns every point to its nearest centroid and moves the
centroids. Fast float32 matrix products give every squared distance up to a bound that holds for any order of
summation; centroids whose intervals reach below the least upper end are the shortlist. A shortlist of one is
decided; the others are recomputed in 64-bit integers, ties to the smaller number. Points too large for that
are compared in Python's integers.

Spark runs the rounds: a task adds up its points by centroid, the sums of all tasks meet in one small grouping of
(centroid, component) and only these, centroids x components at most, reach the driver.

Vectors that are null, of another length, or that hold null or non-finite components (also those of which 256 * x is
beyond a double) give no row. Rows of equal vec_id are separate points. A null vec_id comes last among the first
centroids; ties of the hash go by the components. Fewer vectors than centroids give as many centroids as vectors; an
empty table gives an empty result. Other columns are ignored. A distance beyond a long is null, and so are its sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ._work import Workspace, literal_rows, table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256.0
#: Components below this in size: 64 squares of a difference stay below 2**63.
EXACT_BELOW = 2**27
#: Rows that are compared at a time; a shortlist of all centroids for each takes some 40 MB.
BLOCK = 2048
LIMB = 40  # bits of the digits in which sums travel


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    e = F.col("embedding")
    finite = F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) * SCALE < float("inf"), F.lit(False)))
    return vectors.where(F.coalesce((F.size(e) == dimensions) & finite, F.lit(False))).select("vec_id", "embedding")


def points_of(column: pa.ListArray, dimensions: int) -> np.ndarray:
    """Integer points as doubles, which hold floor(256 * x) exactly at any size."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dimensions)


def whole(numbers: np.ndarray) -> list[int]:
    return [int(x) for x in numbers.tolist()]


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest: |c|^2 - 2 xc in float32, with an interval that holds the exact value.

    A float32 product of n terms is off by n u / (1 - n u) of the sum of the terms' sizes at most (u = 2**-24), in any
    order and with or without fused steps; rounding x and c to float32 adds 2 u + u^2; and that sum is |x||c| at most.
    """
    u, n = 2.0**-24, x.shape[1] + 2
    relative = n * u / (1 - n * u) * (1 + u) ** 2 + 2 * u + u * u
    dot = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    square = (c * c).sum(1).astype(np.float64)
    sizes = np.sqrt((x * x).sum(1).astype(np.float64))[:, None] * np.sqrt(square)[None, :]
    # what double precision itself may lose is far below the last factor and term
    slack = 2 * relative * sizes * (1 + 2.0**-30) + 2.0**-48 * (square[None, :] + 2 * np.abs(dot))
    value = square[None, :] - 2 * dot
    return value - slack <= (value + slack).min(1)[:, None]


def nearest_block(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = shortlist(x, c)
    row, number = np.nonzero(mask)
    difference = x[row] - c[number]
    distance = (difference * difference).sum(1)
    first = np.zeros(len(x), dtype=np.int64)
    np.cumsum(mask.sum(1)[:-1], out=first[1:])
    least = np.minimum.reduceat(distance, first)
    at = np.flatnonzero(distance == least[row])  # by row, then number: the first of a row has the smallest number
    return number[at[np.searchsorted(row[at], np.arange(len(x)))]], least


def nearest(points: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int | None]]:
    """(number of the nearest centroid, squared distance or None where it is beyond a long) of each point."""
    cluster = np.zeros(len(points), dtype=np.int32)
    distance: list[int | None] = [None] * len(points)
    plain = np.abs(points).max(1, initial=0) < EXACT_BELOW
    if max((abs(v) for c in centroids for v in c), default=0) >= EXACT_BELOW:
        plain[:] = False
    else:
        c = np.array(centroids, dtype=np.int64).reshape(len(centroids), points.shape[1])
    rows = np.flatnonzero(plain)
    for k in range(0, len(rows), BLOCK):
        part = rows[k : k + BLOCK]
        cluster[part], least = nearest_block(points[part].astype(np.int64), c)
        for i, d in zip(part.tolist(), least.tolist(), strict=True):
            distance[i] = d
    for i in np.flatnonzero(~plain).tolist():
        p = whole(points[i])
        d, cluster[i] = min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), k) for k, q in enumerate(centroids))
        distance[i] = d if d < 2**63 else None
    return cluster, distance


def sum_points(centroids: list[list[int]], dimensions: int):
    """Function of a task: (place, limb, value) of its sums by centroid and component, in digits of 40 bits.
    place: centroid * (components + 1) + component, the last one being the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (dimensions + 1) for _ in centroids]
        for batch in batches:
            points = points_of(batch.column("embedding"), dimensions)
            cluster, _ = nearest(points, centroids)
            for k in np.unique(cluster).tolist():
                own, total = points[cluster == k], sums[k]
                exact = np.abs(own).max() * len(own) < 2**53
                added = whole(own.sum(0)) if exact else [sum(v) for v in zip(*map(whole, own), strict=True)]
                for i, v in enumerate([*added, len(own)]):
                    total[i] += v
        rows = []
        for k, total in enumerate(sums):
            for i, v in enumerate(total):
                limb = 0
                while v:
                    v, digit = (0, v) if -(2**LIMB) < v < 2**LIMB else divmod(v, 2**LIMB)
                    rows.append((k * (dimensions + 1) + i, limb, digit))
                    limb += 1
        place, limb, value = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(limb, pa.int32()), pa.array(value, pa.int64())], ["place", "limb", "value"])

    return run


def assign(centroids: list[list[int]], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(points_of(batch.column("embedding"), dimensions), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def first_centroids(kept: DataFrame, centroids: int, salt: str, dimensions: int) -> list[list[int]]:
    """The vectors of smallest sha256 of salt and id: a top-k of fixed size."""
    order = (F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("embedding"))
    rows = kept.orderBy(*order).limit(centroids).select("embedding").collect()
    return [whole(points_of(pa.array([r[0]], pa.list_(pa.float64())), dimensions)[0]) for r in rows]


def moved(kept: DataFrame, centroids: list[list[int]], dimensions: int) -> list[list[int]]:
    """The centroids after one round; those without points stay."""
    parts = kept.mapInArrow(sum_points(centroids, dimensions), "place int, limb int, value long")
    totals: dict[int, int] = {}
    for place, limb, value in parts.groupBy("place", "limb").agg(F.sum("value")).collect():
        totals[place] = totals.get(place, 0) + (value << (LIMB * limb))
    out = []
    for k, c in enumerate(centroids):
        at = k * (dimensions + 1)
        n = totals.get(at + dimensions, 0)
        out.append([totals.get(at + i, 0) // n for i in range(dimensions)] if n else c)
    return out


def cluster_vectors(vectors: DataFrame, *, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:", dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    work = Workspace(spark)
    kept = work.save(kept_vectors(vectors, dimensions), "kept")
    at = first_centroids(kept, centroids, salt, dimensions)
    for _ in range(rounds):
        at = moved(kept, at, dimensions)
    kind = StructType([vectors.schema["vec_id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    done = work.save(kept.mapInArrow(assign(at, dimensions), kind), "assigned")
    big = F.col("distance").cast("decimal(38,0)")
    sums = done.groupBy("cluster").agg(F.count("*").alias("rows"), F.count("distance").alias("known"), F.sum(big).alias("total")).collect()
    fits = lambda part: (lambda total: total if total < 2**63 else None)(sum(int(r["total"] or 0) for r in part)) if all(r["rows"] == r["known"] for r in part) else None
    names = [(r["cluster"], fits([r]), fits(sums), hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest()) for r in sums]
    facts = literal_rows(spark, names, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    number = "row_number() OVER (ORDER BY sha256('2:' || vec_id), p)"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))))",
        f"c0 AS MATERIALIZED (SELECT {number} - 1 AS c, p FROM v QUALIFY {number} <= {CENTROIDS})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS (SELECT v.vec_id, v.p, m.c, list_sum(list_transform(list_zip(v.p, m.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{k} AS m)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, CAST(min(d) AS BIGINT) AS d FROM d{k} GROUP BY vec_id, p)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT c, i, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM (SELECT c, unnest(p) AS x, unnest(range(64)) AS i FROM a{k}) GROUP BY c, i)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.p, c{k}.p) AS p FROM c{k} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM s{k} GROUP BY c) m ON m.c = c{k}.c)")
    last = f"SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c"
    return "WITH " + ", ".join(steps) + " " + last


SQL = _sql()
