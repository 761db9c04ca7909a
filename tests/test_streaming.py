import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.lifecycle import calculate_deltas
from tallyspark.schemas import COUNTERS, COUNTS
from tallyspark.streaming.incremental import STATE_STORE, delta_stream, ledger_stream, rebuild_on_change

from .test_jsonschema import events

SCHEMA = f"file string, sequence long, record_index long, turn_id string, operation string, cumulative {COUNTS}, reported_last {COUNTS}"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    names = {STATE_STORE: ROCKS, "spark.sql.shuffle.partitions": "1"}
    was = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in was.items():
        spark.conf.set(n, v)


def counted(r, n):
    """Checkpoints of n records: totals that mostly rise, unknown and falling components, numbers beyond 53 bits."""
    total, out = r.choice([5, 2**60]), []
    for k in range(1, n + 1):
        total += r.randrange(-4, 30)
        row = {c: r.choice([None, total - r.randrange(5), total]) for c in COUNTERS} | {"total_tokens": total}
        last = r.choice([None, dict.fromkeys(COUNTERS) | {"total_tokens": r.randrange(9)}])
        out.append((k, 10 * k, r.choice([None, "t"]), r.choice(["turn", "compact"]), row, last))
    return out


class Feed:
    """Micro-batches as files, one a run."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, f"file://{root}", 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, **options):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{self.root}/in")
        writer = delta_stream(stream, **options).writeStream.format("parquet").option("checkpointLocation", f"{self.root}/checkpoint")
        query = writer.trigger(**({"once": True} if options else {"availableNow": True})).start(f"{self.root}/out")
        assert query.awaitTermination(100) and query.exception() is None
        return self.spark.read.parquet(f"{self.root}/out")


def test_any_order_of_batches_equals_the_whole(rocks, tmp_path):
    r = random.Random(6)
    rows = [(f, *x) for f, n in (("a", 23), ("b", 9), ("c", 1)) for x in counted(r, n)]
    mixed = r.sample(rows, len(rows))
    feed = Feed(rocks, tmp_path)
    for k in range(0, len(mixed), 12):
        feed.add(mixed[k : k + 12] + r.sample(rows, 2))  # some come again
    got = feed.run()
    assert got.where("missing").isEmpty()
    want = calculate_deltas(rocks.createDataFrame(rows, SCHEMA))
    columns = ("file", "sequence", "record_index", F.to_json("cumulative").alias("c"), F.to_json("delta").alias("d"), "flags")
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_state_lives_on_and_gaps_are_told(rocks, tmp_path):
    rows = [("a", *x) for x in counted(random.Random(7), 5)]
    feed = Feed(rocks, tmp_path)
    feed.add([rows[0], rows[2], rows[4]])
    assert [x["sequence"] for x in feed.run(patience_ms=1).where("not missing").collect()] == [1]
    time.sleep(0.1)
    feed.add([("other", *rows[0][1:])])
    told = feed.run(patience_ms=1).where("missing").select("file", "sequence", "delta").distinct().collect()
    assert [tuple(x) for x in told] == [("a", 2, None)]
    feed.add([rows[1], rows[3]])
    found = feed.run(patience_ms=60_000).where("not missing and file = 'a'").orderBy("sequence").collect()
    assert [x["sequence"] for x in found] == [1, 2, 3, 4, 5]
    want = calculate_deltas(rocks.createDataFrame(rows, SCHEMA)).orderBy("sequence").collect()
    assert [x["delta"] for x in found] == [x["delta"] for x in want]


def test_ledger_stream_rebuilds_on_new_events(spark, tmp_path):
    """An event that comes again is no new one, and a batch without any rebuilds nothing."""
    usage, mapping, _ = events()
    place, seen = tmp_path / "ledger/devices/one/usage", []
    place.mkdir(parents=True)

    def run():
        def rebuild(session):
            seen.append(session.read.json(f"file://{tmp_path}/ledger/devices", recursiveFileLookup=True).select("event_id").distinct().count())

        query = rebuild_on_change(ledger_stream(spark, f"file://{tmp_path}/ledger"), rebuild, f"file://{tmp_path}/offsets")
        assert query.awaitTermination(200) and query.exception() is None

    (place / "a.jsonl").write_text(json.dumps(usage) + "\n")
    run()
    (place / "b.jsonl").write_text(json.dumps(usage) + "\n")
    run()
    (place / "c.jsonl").write_text(json.dumps(mapping) + "\n")
    run()
    assert seen == [1, 2]


def test_other_state_stores_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="RocksDB"):
        delta_stream(spark.createDataFrame([], SCHEMA))
