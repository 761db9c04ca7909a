"""N-gram Jaccard join with Bayesian candidate pruning.

A document is an id with a text: rows equal in both are one document, an id with several texts is several.
Documents are sets of five-word shingles. Those with equal sets form a class, and one document stands for it.
MinHash bands bring representatives together: sharing one band is enough, and the bands link to the least
document that has it, so links are as many as band entries. Linked representatives are compared in blocks of
bounded size. Within a block the MinHash values of a pair are compared a few at a time, and the pair goes as
soon as the posterior probability that its similarity reaches the threshold falls below the tolerance. What
stays is verified exactly on the shingles. A block returns a row for each of its documents, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, small, table
from .graph import connected_components, to_blocks

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-5
#: P(no common band) at similarity 0.8: (1 - 0.8**7)**40 < 1e-4.
BANDS, ROWS = 40, 7
HASHES, STEP = BANDS * ROWS, 40
#: A block holds about so many documents and shingles on each side.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
CACHE = 400_000

_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, cache: WordHash, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k consecutive words (lower case); shorter texts are one shingle."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    if len(h) < k:
        h = np.concatenate([h, np.full(k - len(h), len(h), dtype=np.uint64)])
    s = np.zeros(len(h) - k + 1, dtype=np.uint64)
    for j in range(k):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES values for each non-empty set; sets go through in runs that fit the cache."""
    out, at = np.empty((len(sets), HASHES), dtype=np.uint32), 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (n == 0 or n + len(sets[to]) <= 32_768):
            n += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to]).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[at : to - 1]]])
        for j in range(HASHES):
            out[at:to, j] = np.minimum.reduceat(x * _MUL[j] + _ADD[j], starts)
        at = to
    return out


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordHash()
    weights = np.array([0x9E3779B97F4A7C15 * (2 * j + 3) % (1 << 64) | 1 for j in range(ROWS)], dtype=np.uint64)
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.iloc[lo : lo + 512]
            found = [(i, h, s) for i, h, t in zip(part["id"], part["text_hash"], part["text"], strict=True) if len(s := shingles(t, cache))]
            if not found:
                continue
            low = minhashes([s for _, _, s in found])
            keys = low.reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = (keys * weights).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            keys ^= keys >> np.uint64(31)
            keys *= np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(29)
            brief = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pd.DataFrame({"id": [i for i, _, _ in found], "text_hash": [h for _, h, _ in found], "same": [xxhash.xxh3_128_digest(s.tobytes()) for _, _, s in found], "n": [len(s) for _, _, s in found], "bands": list(keys.astype(np.int64)), "brief": [b.tobytes() for b in brief]})


def least_matches(seen: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of `seen` equal values with which P(similarity >= threshold) is still at least tolerance.

    The prior is uniform; different values agree in one byte with probability 1/256, which shifts the threshold.
    P(Beta(m + 1, seen - m + 1) >= t) = P(Binomial(seen + 1, t) <= m).
    """
    t, total = threshold + (1 - threshold) / 256, 0.0
    for m in range(seen + 1):
        total += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if total >= tolerance:
            return m
    return seen


NEED = [least_matches(n) for n in range(STEP, HASHES + 1, STEP)]


def compare(side: np.ndarray, n: np.ndarray, weight: np.ndarray, brief: np.ndarray, sets: list[np.ndarray], within: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(weight of partners, least partner in reach) of each document; pairs lie within one side or across both."""
    m = len(n)
    links, parent = np.zeros(m, dtype=np.int64), np.arange(m)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    own = [flat[e - len(s) : e] for s, e in zip(sets, ends, strict=True)]
    mark = np.zeros(flat.max() + 1 if len(flat) else 1, dtype=bool)
    for i in range(m):
        j = np.arange(i + 1, m)
        if not within:
            j = j[side[j] != side[i]]
        j = j[np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]) - 1e-9]
        equal = np.zeros(len(j), dtype=np.int64)
        for step, need in enumerate(NEED):
            if not len(j):
                break
            at = slice(step * STEP, (step + 1) * STEP)
            equal += (brief[j, at] == brief[i, at]).sum(1)
            stay = equal >= need
            j, equal = j[stay], equal[stay]
        if not len(j):
            continue
        mark[own[i]] = True
        parts = [own[x] for x in j]
        common = np.add.reduceat(mark[np.concatenate(parts)].astype(np.int64), np.cumsum([0, *[len(p) for p in parts[:-1]]]))
        mark[own[i]] = False
        j = j[common >= threshold * (n[i] + n[j] - common) - 1e-9]
        if len(j):
            links[i] += weight[j].sum()
            links[j] += weight[i]
            roots = np.append(j, i)
            while (parent[roots] != roots).any():
                roots = parent[roots]
            parent[roots] = roots.min()
    for i in range(m):  # parents are never larger
        parent[i] = parent[parent[i]]
    return links, parent


def compare_block(block: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block, cluster by cluster."""
    out = []
    within = block["a"].iloc[0] == block["b"].iloc[0]
    for _, part in block.groupby("cluster", sort=False):
        if len(part) < 2:
            continue
        part = part.sort_values("id")
        sets = [np.frombuffer(s, dtype=np.uint64) for s in part["shingles"]]
        ids = part["id"].to_numpy()
        links, parent = compare(part["chunk"].to_numpy(), np.array([len(s) for s in sets]), part["size"].to_numpy(), np.stack([np.frombuffer(b, dtype=np.uint8) for b in part["brief"]]), sets, within)
        hit = links > 0
        out.append(pd.DataFrame({"id": ids[hit], "links": links[hit], "root": ids[parent[hit]]}))
    return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})


def cut_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cache = WordHash()
    for batch in batches:
        yield batch.drop(columns="text").assign(shingles=[shingles(t, cache).tobytes() for t in batch["text"]])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with an id: id, text_hash, class_id, class_hash, n_links.

    (class_id, class_hash) is the least (id, text_hash) that links of similarity >= 0.8 reach; n_links counts the
    other documents of similarity >= 0.8, copies included. Texts without words link with nothing. Rows without an
    id are left out, rows equal in id and text stand for one document. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("id is not null")
    # nodes are numbers of rows, fixed once they are written; the graph needs them to differ, not their order
    sketched = texts.mapInPandas(sketch, "id long, text_hash long, same binary, n int, bands array<long>, brief binary")
    sketches = work.save(sketched.withColumn("node", F.monotonically_increasing_id()), "sketches")
    single = work.save(sketches.groupBy("same", "id", "text_hash").agg(F.min("node").alias("node"), F.count("*").alias("rows")), "single")
    classes = work.save(single.groupBy("same").agg(F.min("node").alias("rep"), F.count("*").alias("size"), F.max("rows").alias("rows"), F.min(F.struct("id", "text_hash")).alias("least")), "classes")
    repeats = (classes.agg(F.max("rows")).first()[0] or 0) > 1
    reps = work.save(sketches.join(classes.select("rep", "size"), F.col("node") == F.col("rep")).select("node", "id", "text_hash", "size", "n", "bands", "brief"), "reps")

    keys = reps.select(F.explode("bands").alias("key"), "node")
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    near = keys.join(pivots, "key").select(F.col("node").alias("src"), F.col("pivot").alias("dst"))
    clusters = work.save(connected_components(near, work, "near"), "clusters")
    members = clusters.join(reps.select("node", "id", "text_hash", "size", "n", "brief"), "node")
    spread = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).alias("q"))
    members = work.save(members.join(spread, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("q")).cast("int")), "members")
    n_members = members.count()
    with_text = texts.join(small(members), ["id", "text_hash"])
    if repeats:
        with_text = with_text.dropDuplicates(["node"])
    sets = with_text.select(F.col("node").alias("id"), "size", "component", "q", "chunk", "brief", "text").mapInPandas(cut_sets, "id long, size long, component long, q long, chunk int, brief binary, shingles binary")
    blocks = to_blocks(sets.withColumnRenamed("component", "cluster"), n_members, BLOCK_DOCS)
    compared = work.save(blocks.groupBy("alone", "g", "a", "b").applyInPandas(compare_block, "id long, links long, root long"), "compared")
    found = connected_components(compared.select(F.col("id").alias("src"), F.col("root").alias("dst")), work, "links").withColumnRenamed("node", "rep")
    tops = work.save(found.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("top")), "tops")
    found = found.join(small(tops), "component").select("rep", "top")
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    by_rep = classes.join(found, "rep", "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
    by_class = work.save(by_rep.select("same", F.coalesce("top", "least").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")), "by_class")
    linked = single.select("id", "text_hash", "same").join(by_class, "same").select("id", "text_hash", "top", "n_links")
    own = texts.select("id", "text_hash").join(linked, ["id", "text_hash"], "left")
    return own.select("id", "text_hash", F.coalesce("top.id", "id").alias("class_id"), F.coalesce("top.text_hash", "text_hash").alias("class_hash"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
