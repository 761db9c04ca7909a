"""Structured Streaming forms of the incremental work: new ledger events, rebuilds on them, deltas with state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.lifecycle import deltas_of
from ..schemas import EVENT

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ORDERED = "file string, sequence long, payload string, before string, missing boolean"
ORDERED_NAMES = [part.split()[0] for part in ORDERED.split(", ")]


def ledger_stream(spark: SparkSession, root: str) -> DataFrame:
    """New events of all devices as files arrive, each event_id once. Late events matter for ever, since a replay
    does not depend on order; so the ids stay in the state store."""
    rows = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").json(f"{root.rstrip('/')}/devices")
    return rows.dropDuplicates(["event_id"])


def rebuild_on_change(events: DataFrame, rebuild: Callable[[SparkSession], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call rebuild for every micro-batch that brings events; offsets live in the checkpoint folder."""

    def run(batch: DataFrame, _: int) -> None:
        if batch.count():  # all partitions run, as their state must be committed; isEmpty() would stop at the first row
            rebuild(batch.sparkSession)

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class InOrder(StatefulProcessor):
    """Gives the records of a file in their order, each with the one before it, whatever order they come in.

    State: the last record given, and those that wait for a predecessor. Records that were given before (a file read
    again) give nothing. A timer tells the place of a predecessor that does not come; what waits goes on waiting.
    """

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", "sequence long, payload string")
        self.waiting = handle.getMapState("waiting", "sequence long", "payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, before = self.given.get() if self.given.exists() else (0, None)
        new = {}
        for batch in rows:
            new |= {int(k): v for k, v in zip(batch["sequence"], batch["payload"], strict=True) if k > at}
        held, out = self.waiting.exists(), []
        while True:
            payload = new.pop(at + 1, None)
            if held and self.waiting.containsKey((at + 1,)):
                payload = payload or self.waiting.getValue((at + 1,))[0]
                self.waiting.removeKey((at + 1,))
            if payload is None:
                break
            at += 1
            out.append((key[0], at, payload, before, False))
            before = payload
        if out:
            self.given.update((at, before))
        for sequence, payload in new.items():
            self.waiting.updateValue((sequence,), (payload,))
        if self.patience_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if self.patience_ms is not None and self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield pd.DataFrame(out, columns=ORDERED_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            at = self.given.get()[0] if self.given.exists() else 0
            yield pd.DataFrame([(key[0], at + 1, None, None, True)], columns=ORDERED_NAMES)

    def close(self) -> None:
        pass


def delta_stream(checkpoints: DataFrame, *, patience_ms: int | None = None) -> DataFrame:
    """Streaming checkpoints(file, sequence from 1 without gaps, record_index, turn_id, operation, cumulative, reported_last)
    in any order -> the same with delta and flags as calculate_deltas gives them, and missing: rows that hold nothing but
    the sequence of a predecessor that has not come for patience_ms. Needs the RocksDB state store. With a patience the query
    has timers, so it never runs out of batches: an availableNow trigger would not end."""
    spark = checkpoints.sparkSession
    if "RocksDB" not in spark.conf.get(STATE_STORE):
        raise ValueError(f"{STATE_STORE}: the RocksDB provider")
    rest = [f for f in checkpoints.schema.fields if f.name not in ("file", "sequence")]
    kind = StructType(rest)
    # counters travel as text, since pandas has no exact integers beside nulls
    rows = checkpoints.select("file", "sequence", F.to_json(F.struct(*[f.name for f in rest])).alias("payload"))
    ordered = rows.groupBy("file").transformWithStateInPandas(InOrder(patience_ms), ORDERED, "append", "None" if patience_ms is None else "ProcessingTime")
    ordered = ordered.select("file", "sequence", F.from_json("payload", kind).alias("now"), F.from_json("before", kind)["cumulative"].alias("previous"), "missing")
    ordered = ordered.select("file", "sequence", "now.*", "previous", "missing")
    done = deltas_of(ordered).drop("previous")
    return done.withColumns({c: F.when(~F.col("missing"), F.col(c)) for c in ("delta", "flags")})
