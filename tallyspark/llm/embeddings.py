"""Embedding near-dedup by iterative quantisation.

A rotation of the principal axes, learnt on a bounded sample, makes the signs of the coordinates balanced codes
that keep angles. Codes are looked up in multi-index Hamming tables: each code is cut into substrings, and codes
that differ in fewer bits than there are substrings agree in one of them. Substrings grow with the logarithm of
the number of vectors, so buckets don't grow, and so many codes are learnt that a pair at the threshold is missed
by all tables with a probability of MISS. What the tables bring together is reranked with the original vectors.

Links are counted without listing them. Vectors that agree in long substrings are first gathered around the
least of them (each such star link is verified by cosine); in the tables each gathered group has one vector in a
bucket. Groups that may touch are compared in full, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, small, table
from .graph import connected_components, to_blocks

THRESHOLD = 0.9
#: The rotations of each length are learnt on at most so many of its vectors; every vector is indexed.
SAMPLE_ROWS, ROUNDS = 20_000, 40
BITS, MISS = 64, 0.04
#: Substrings that gather groups: so many of so many bits, for each of the first codes.
STARS, STAR_BITS, STAR_CODES = 6, 28, 2
#: Codes further apart than this are not reranked: at cosine 0.9, 9 of 64 bits differ on average.
RADIUS = 18
#: Groups are compared in full if a pair of theirs from one bucket comes this near.
TOUCH = 0.8
BLOCK = 1024


def table_plan(n_vectors: int) -> tuple[int, int, int]:
    """(bits of a substring, number of tables, number of codes) for so many vectors."""
    width = min(max(math.ceil(math.log2(max(n_vectors, 2))), 8), BITS // 2)
    agree = (1 - math.acos(THRESHOLD) / math.pi) ** width  # P(a substring is equal) at the threshold
    tables = math.ceil(math.log(MISS) / math.log(1 - agree))
    return width, tables, max(math.ceil(tables / (BITS // width)), STAR_CODES)


def learn_rotation(x: np.ndarray, seed: int, rounds: int = ROUNDS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) of iterative quantisation; few rows or dimensions give fewer bits."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    c = x - mean
    _, axes = np.linalg.eigh(c.T @ c + 1e-12 * np.eye(x.shape[1]))
    axes = axes[:, ::-1][:, :bits]
    v = c @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1], axes.shape[1])))
    for _ in range(rounds if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def learn_codes(x: np.ndarray, codes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection to BITS coordinates for each code; short vectors take several rotations for one."""
    out, seed = [], 0
    for _ in range(codes):
        parts = []
        while sum(p.shape[1] for p in parts) < BITS:
            mean, projection = learn_rotation(x, seed)
            parts.append(projection)
            seed += 1
        out.append((mean, np.concatenate(parts, axis=1)[:, :BITS]))
    return out


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    packed = np.packbits(((x - mean) @ projection >= 0).astype(np.uint8), axis=1)
    return packed.view(">u8").astype(np.uint64).view(np.int64).reshape(-1)


def unit_vectors(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """The two vectors of a row are of one length, those of different rows need not be."""
    out = np.empty(len(a))
    lengths = a.map(len).to_numpy(dtype=np.int64)
    for n in np.unique(lengths):
        at = lengths == n
        out[at] = (unit_vectors(a[at]) * unit_vectors(b[at])).sum(1)
    return pd.Series(out)


def compare_block(block: pd.DataFrame) -> pd.DataFrame:
    """Link counts and least linked partner in reach of the vectors of a block, cluster by cluster."""
    out, within = [], block["a"].iloc[0] == block["b"].iloc[0]
    for _, part in block.groupby("cluster", sort=False):
        if len(part) < 2:
            continue
        part = part.sort_values("id")
        x, size, side = unit_vectors(part["vector"]), part["size"].to_numpy(), part["chunk"].to_numpy()
        near = x @ x.T >= THRESHOLD
        if not within:
            near &= side[:, None] != side[None, :]
        np.fill_diagonal(near, False)
        links, root = near @ size, np.arange(len(part))
        while True:  # the least label of the neighbours, until nothing changes
            low = np.minimum(root, np.where(near, root[None, :], len(part)).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        ids, hit = part["id"].to_numpy(), links > 0
        out.append(pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[root[hit]]}))
    return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})


def substring(code: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << bits) - 1))


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing, and so do rows without an
    id. Vectors of each length are an index of their own. Rows that repeat an id are one vector each; they link
    like others, and kept holds for all rows of the least id of a component. Equal vectors link with each other.
    Other columns are not read. An empty table gives an empty result. What comes to the driver: SAMPLE_ROWS
    vectors of one length at a time, and 512 bytes a component, length and code of the rotations.
    """
    spark = vectors.sparkSession
    work = Workspace(spark)
    value = F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double") + 0.0)  # no negative zero
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd & F.exists("vector", lambda v: v != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), value.alias("vector")).select("id", F.when(F.coalesce(good, F.lit(False)), F.col("vector")).alias("vector"))
    # vectors are equal if two hashes of 64 bits are; nodes are numbers of rows, fixed once they are written
    hashed = rows.select("id", "vector", *[F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "vector")).alias(f"h{k}") for k in (1, 2)])
    rows = work.save(hashed.withColumn("node", F.monotonically_increasing_id()), "rows")
    usable = rows.where("vector is not null")
    classes = work.save(usable.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("size"), F.min("id").alias("least")), "classes")
    reps = work.save(usable.join(small(classes.select("node", "size"), classes), "node").select("node", "size", "vector", "h1", F.size("vector").alias("n")), "reps")
    plans = {r["n"]: table_plan(r["count"]) for r in reps.groupBy("n").count().collect()}  # lengths, no vectors

    def rotations(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        sample = reps.where(F.col("n") == n).orderBy("h1", "node").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks()
        x = np.asarray(sample.flatten(), dtype=np.float64).reshape(-1, n)
        return learn_codes(x / np.linalg.norm(x, axis=1, keepdims=True), plans[n][2])

    models = {n: rotations(n) for n in plans}

    def add_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby("n"):
                v = unit_vectors(part["vector"])
                codes = np.stack([encode(v, *m) for m in models[n]], axis=1)
                yield pd.DataFrame({"node": part["node"], "n": part["n"], "codes": list(codes)})

    codes = work.save(reps.select("node", "n", "vector").mapInPandas(add_codes, "node long, n int, codes array<long>"), "codes")
    near = F.pandas_udf(cosine, "double")
    left, right = reps.select(F.col("node").alias("src"), F.col("vector").alias("v1")), reps.select(F.col("node").alias("dst"), F.col("vector").alias("v2"))
    verified = lambda pairs, least: pairs.join(left, "src").join(right, "dst").where(near("v1", "v2") >= least).select("src", "dst")

    # gather: equal long substrings, star links to the least node
    starts = [round(i * (BITS - STAR_BITS) / (STARS - 1)) for i in range(STARS)]
    long_keys = codes.select("node", F.explode(F.array(*[F.xxhash64("n", F.lit(k * STARS + i), substring(F.get("codes", F.lit(k)), at, STAR_BITS)) for k in range(STAR_CODES) for i, at in enumerate(starts)])).alias("key"))
    pivots = long_keys.groupBy("key").agg(F.min("node").alias("dst"), F.count("*").alias("c")).where("c > 1").select("key", "dst")
    lengths = codes.select(F.col("node").alias("src"), F.col("n").alias("n1")), codes.select(F.col("node").alias("dst"), F.col("n").alias("n2"))
    met = long_keys.join(pivots, "key").where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()
    if len(plans) > 1:  # hashes of keys may be equal by chance
        met = met.join(lengths[0], "src").join(lengths[1], "dst").where("n1 = n2").select("src", "dst")
    stars = work.save(verified(met, THRESHOLD), "stars")
    grouped = connected_components(stars, work, "gather")
    coded = work.save(codes.join(grouped, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "coded")

    # multi-index tables: one vector of each group in a bucket
    homes = None
    for n, (width, tables, _) in plans.items():
        per = BITS // width
        slots = F.array(*[F.struct(F.lit((n << 32) + t).alias("t"), substring(F.get("codes", F.lit(t // per)), t % per * width, width).alias("sub"), F.get("codes", F.lit(t // per)).alias("code")) for t in range(tables)])
        part = coded.where(F.col("n") == n).select("node", "group", F.explode(slots).alias("s")).select("group", "s.t", "s.sub", F.struct("node", "s.code").alias("own"))
        homes = part if homes is None else homes.unionByName(part)
    if homes is not None:
        homes = homes.groupBy("t", "sub", "group").agg(F.min("own").alias("own"))
        h, p = homes.alias("h"), homes.alias("p")
        met = h.join(p, (F.col("h.t") == F.col("p.t")) & (F.col("h.sub") == F.col("p.sub")) & (F.col("h.group") < F.col("p.group")) & (F.bit_count(F.col("h.own.code").bitwiseXOR(F.col("p.own.code"))) <= RADIUS))
        touching = work.save(verified(met.select(F.col("h.own.node").alias("src"), F.col("p.own.node").alias("dst")).distinct(), TOUCH), "touching")
        stars = stars.unionByName(touching)
    clusters = connected_components(stars, work, "clusters")

    members = clusters.withColumnsRenamed({"component": "cluster"}).join(reps.select("node", "size", "vector"), "node").withColumnRenamed("node", "id")
    q = clusters.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK).alias("q"))
    members = work.save(members.join(q, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("q")).cast("int")), "members")
    compared = work.save(to_blocks(members, members.count(), BLOCK).groupBy("alone", "g", "a", "b").applyInPandas(compare_block, "id long, links long, root long"), "compared")
    found = connected_components(compared.select(F.col("id").alias("src"), F.col("root").alias("dst")), work, "links")
    tops = found.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("top"))
    links = compared.groupBy(F.col("id").alias("node")).agg(F.sum("links").alias("links"))
    by_class = classes.join(found.join(tops, "component").select("node", "top"), "node", "left").join(links, "node", "left")
    by_class = work.save(by_class.select("h1", "h2", F.coalesce("top", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "by_class")
    work.drop("reps", "codes", "coded", "stars", "touching", "members", "compared", "classes")
    out = rows.select("id", "h1", "h2").join(by_class, ["h1", "h2"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
