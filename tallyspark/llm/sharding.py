"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on the ring, from the hash of its id. The arc in front of a virtual node belongs
to the node's shard. A shard takes the rows of its arcs in ring order until it is full; what is left
continues clockwise to the next shard with room. With slack 0 the capacities add up to the number of rows,
so that the counts of any two shards differ by one at most; with slack e a shard holds at most (1 + e) of
the mean and fewer rows move when a shard is added.

Only counts per slice of the ring and per arc are gathered. Rows are ranked within slices, whose number is
fixed and far above the number of tasks, so neither a hot source nor a group of copies meets in one task.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, fresh, literal_rows, table

SLICES_LOG2 = 14


def ring(n_shards: int, vnodes: int, slices: int) -> list[tuple[int, int]]:
    """Sorted (slice, shard) of the virtual nodes; a node's arc ends with its own slice."""
    place = lambda s, v: int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big") % slices
    return sorted((place(s, v), s) for s in range(n_shards) for v in range(vnodes))


def capacities(n_rows: int, n_shards: int, slack: float) -> list[int]:
    if slack > 0:
        return [-int(-(1 + slack) * n_rows // n_shards)] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def fill(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Cut the arcs among the shards: (arc, from rank, to rank, shard, first slot). Walks arcs, never rows."""
    room, used, cuts, left = list(room), [0] * len(room), [], []

    def take(arc: int, lo: int, n: int, shard: int) -> int:
        n = min(n, room[shard])
        if n:
            cuts.append((arc, lo, lo + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return n

    for arc, (shard, n) in enumerate(zip(owners, counts, strict=True)):
        if (got := take(arc, 0, n, shard)) < n:
            left.append((arc, got))
    for arc, lo in left:
        step = arc
        while lo < counts[arc]:
            step = (step + 1) % len(owners)
            lo += take(arc, lo, counts[arc] - lo, owners[step])
    return cuts


def shard_documents(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 32, slack: float = 0.0) -> DataFrame:
    """All rows and columns of docs with size, text_crc32, law, shard, slot and grown_shard.

    The law is `rows`: counts of the shards differ by one at most, and slots of a shard run from 0 without
    gaps. Columns of docs with these names, in any case of letters, are replaced; all others come back as they
    were. Null text: size 1, checksum 0. Rows of null id have their places on the ring from their texts; repeated
    rows follow one another. An empty table gives an empty result.
    """
    spark, slices = docs.sparkSession, 1 << SLICES_LOG2
    work, nodes = Workspace(spark), ring(n_shards, vnodes, slices)
    starts, arc_of = [p for p, _ in nodes], []
    arc = 0
    for s in range(slices):  # the first node at or after the slice, clockwise
        while arc < len(nodes) and starts[arc] < s:
            arc += 1
        arc_of.append(arc % len(nodes))
    # helpers and the results on their way have names that no column of docs has, in any case of letters
    names = ("size", "text_crc32", "h", "slice", "rank", "n", "arc", "before", "lo", "hi", "shard", "slot0")
    c = dict(zip(names, fresh(docs.columns, *(f"__{name}" for name in names)), strict=True))
    arc_at = F.element_at(F.from_json(F.lit(json.dumps(arc_of)), "array<int>"), F.col(c["slice"]) + 1)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary"))
    ident = F.col(f"`{id_col}`")
    # rows without an id are dealt by their texts, else all of them would share one slice
    hashed = F.when(ident.isNull(), F.xxhash64(text, F.lit(-1))).otherwise(F.xxhash64(ident))
    slice_of = F.shiftrightunsigned(hashed, 64 - SLICES_LOG2).cast("int")

    counts = docs.select(slice_of.alias(c["slice"])).groupBy(c["slice"]).agg(F.count("*").alias(c["n"])).withColumn(c["arc"], arc_at)
    counts = work.save(counts, "slices")
    per_arc = {r[0]: r[1] for r in counts.groupBy(c["arc"]).agg(F.sum(c["n"])).collect()}  # at most n_shards * vnodes rows
    cuts = fill([s for _, s in nodes], [per_arc.get(a, 0) for a in range(len(nodes))], capacities(sum(per_arc.values()), n_shards, slack))
    (cut_arc,) = fresh([*docs.columns, *c.values()], "__cut_arc")
    cut_rows = literal_rows(spark, cuts, "arc int,lo long,hi long,shard int,slot0 long")
    cut_rows = cut_rows.select(F.col("arc").alias(cut_arc), *[F.col(k).alias(c[k]) for k in ("lo", "hi", "shard", "slot0")])
    before = F.sum(c["n"]).over(Window.partitionBy(c["arc"]).orderBy(c["slice"]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(c["slice"], c["arc"], F.coalesce(before, F.lit(0)).alias(c["before"]))

    rows = docs.withColumns({c["size"]: size, c["text_crc32"]: crc, c["h"]: hashed, c["slice"]: slice_of})
    rank = F.row_number().over(Window.partitionBy(c["slice"]).orderBy(c["h"], ident, c["text_crc32"], c["size"]))
    ranked = rows.withColumn(c["rank"], rank).join(F.broadcast(offsets), c["slice"]).withColumn(c["rank"], F.col(c["before"]) + F.col(c["rank"]) - 1)
    placed = ranked.join(F.broadcast(cut_rows), (F.col(c["arc"]) == F.col(cut_arc)) & (F.col(c["rank"]) >= F.col(c["lo"])) & (F.col(c["rank"]) < F.col(c["hi"])))
    new = {
        "size": F.col(c["size"]),
        "text_crc32": F.col(c["text_crc32"]),
        "law": F.lit("rows"),
        "shard": F.col(c["shard"]),
        "slot": F.col(c["slot0"]) + F.col(c["rank"]) - F.col(c["lo"]),
        "grown_shard": F.lit(None).cast("int"),
    }
    return placed.select(*[F.col(f"`{x}`") for x in docs.columns if x.lower() not in new], *[v.alias(k) for k, v in new.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
