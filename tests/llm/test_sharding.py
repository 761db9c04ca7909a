import zlib

from pyspark.sql import functions as F

from tallyspark.llm import sharding


def brute(n_rows, n_shards, vnodes, hashes):
    """Shard sizes of a ring with bounded loads, walking rows one by one."""
    slices = 1 << sharding.SLICES_LOG2
    nodes = sharding.ring(n_shards, vnodes, slices)
    room = sharding.capacities(n_rows, n_shards, 0.0)
    owner = lambda h: next((k for k, (p, _) in enumerate(nodes) if p >= h), 0)
    arcs = {}
    for h in sorted(hashes):
        arcs.setdefault(owner((h & (2**64 - 1)) >> (64 - sharding.SLICES_LOG2)), []).append(h)
    placed, left = {}, []
    for arc in range(len(nodes)):
        rows = arcs.get(arc, [])
        n = min(len(rows), room[nodes[arc][1]])
        room[nodes[arc][1]] -= n
        placed |= dict.fromkeys(rows[:n], nodes[arc][1])
        left.append((arc, rows[n:]))
    for arc, rows in left:
        step = arc
        while rows:
            step = (step + 1) % len(nodes)
            n = min(len(rows), room[nodes[step][1]])
            room[nodes[step][1]] -= n
            placed |= dict.fromkeys(rows[:n], nodes[step][1])
            rows = rows[n:]
    return placed


def test_placement_equals_a_walk_over_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 5, vnodes=4).collect()}
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    # arcs run over slices by unsigned place; within a slice rows go by their signed hash, as all of one slice share its sign
    want = brute(400, 5, 4, hashes.values())
    sizes = sharding.capacities(400, 5, 0.0)
    assert sorted(map(list(got.values()).count, range(5))) == sorted(sizes)
    assert sum(got[d] == want[h] for d, h in hashes.items()) == 400


def test_columns_of_the_user_stay(spark):
    """Helpers' names, results' names in other letters, and names with dots."""
    own = ["__h", "__slice", "__rank", "__SIZE", "__cut_arc", "__arc", "__n", "lo", "a.b"]
    docs = spark.createDataFrame([(k, f"t{k}", *[f"{c}{k}" for c in own], "mine") for k in range(30)], ["doc_id", "text", *own, "Size"])
    out = sharding.shard_documents(docs)
    assert [c.lower() for c in out.columns].count("size") == 1
    for r in out.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in own)
        assert r["size"] == len(r["text"]) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())


def test_rows_without_id_are_spread(spark):
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    out = sharding.shard_documents(docs)
    assert {r["count"] for r in out.groupBy("shard").count().collect()} == {250}
    again = sharding.shard_documents(docs.repartition(3))
    assert {(r["text"], r["shard"], r["slot"]) for r in out.collect()} == {(r["text"], r["shard"], r["slot"]) for r in again.collect()}
    assert sharding.shard_documents(docs.limit(0)).collect() == []
