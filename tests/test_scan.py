import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.lifecycle import calculate_deltas
from tallyspark.operators.scan import Running, in_order, scan, split_of
from tallyspark.sources.rollouts import discover, parse_rollouts, read_lines
from tallyspark.work import Scratch


@pytest.mark.parametrize("rows_of_split", [1, 3, 1000])
def test_running_values_equal_one_pass(spark, rows_of_split):
    r = random.Random(8)
    rows = [(key, k, r.choice([None, None, "a", "b"]), r.randrange(-5, 5)) for key in "xyz" for k in range(1, r.randrange(2, 40))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "file string, at long, v string, n long").withColumn("split", split_of(F.col("at"), rows_of_split))
    running = {"v_upto": Running("last", F.col("v")), "v_before": Running("last", F.col("v"), True), "n_upto": Running("sum", F.col("n")), "n_before": Running("sum", F.col("n"), True), "top": Running("max", F.col("n")), "top_before": Running("max", F.col("n"), True)}
    got = {(x["file"], x["at"]): x for x in scan(df, running, key=["file"], split="split", order="at").collect()}
    assert len(got) == len(rows)
    for key in "xyz":
        v, total, top = None, 0, None
        for _, at, new, n in (x for x in rows if x[0] == key):
            x = got[key, at]
            assert (x["v_before"], x["n_before"], x["top_before"]) == (v, total, top)
            v, total, top = new if new is not None else v, total + n, n if top is None else max(top, n)
            assert (x["v_upto"], x["n_upto"], x["top"]) == (v, total, top)


def test_one_hot_key_is_cut(spark):
    """Ranges of an order cut a key that holds nearly all rows."""
    rows = Scratch(spark).save(in_order(spark.range(5000).select(F.lit("hot").alias("k"), F.col("id").alias("v")), "k", "v"), "rows")
    assert rows.groupBy("split").count().agg(F.max("count")).first()[0] < 5000
    assert [x["v"] for x in rows.orderBy("place").collect()] == list(range(5000))


def records(r, n):
    yield {"type": "session_meta", "payload": {"id": f"t{r.random()}", "source": "cli"}}
    total = 10
    for _ in range(n):
        turn = r.choice(["one", "two", "three"])
        kind = r.randrange(8)
        if kind == 0:
            yield {"type": "event_msg", "payload": {"type": "task_started", "turn_id": turn}}
        elif kind == 1:
            yield {"type": "event_msg", "payload": {"type": "task_complete", "turn_id": turn}}
        elif kind == 2:
            yield {"type": "turn_context", "payload": {"turn_id": r.choice([turn, None]), "model": r.choice(["m", None, "n"]), "effort": r.choice(["high", None])}}
        elif kind == 3:
            yield {"type": "compacted", "payload": {}}
        elif kind == 4:
            yield {"type": "response_item", "payload": {"type": "function_call", "arguments": json.dumps({"cwd": f"/{turn}"})}}
        else:
            total += r.randrange(-3, 9)
            usage = {"input_tokens": total, "output_tokens": 1, "total_tokens": total + 1}
            yield {"timestamp": "2026-03-04T05:06:07Z", "type": "event_msg", "payload": {"type": "token_count", "info": r.choice([{"total_token_usage": usage}] * 7 + [None])}}


def plain_state(lines):
    """One pass over a log: (record, turn, ordinal, operation, model, effort, total) of each count."""
    turn, operation, context, ordinal, out = None, "unknown", (None, None), 0, []
    for at, x in enumerate(lines, 1):
        p = x["payload"]
        kind = p.get("type") if x["type"] == "event_msg" else x["type"]
        if kind in ("task_started", "task_complete"):
            turn = p["turn_id"] if kind == "task_started" else None
            operation, context, ordinal = "turn" if turn else "unknown", (None, None), 0
        elif kind == "turn_context":
            if p["turn_id"] is not None and p["turn_id"] != turn:
                turn, operation, ordinal = p["turn_id"], "turn", 0
            context = (p["model"], p["effort"])
        elif kind == "compacted":
            operation = "compact"
        elif kind == "token_count" and p["info"]:
            out.append((at, turn, ordinal if turn else 0, operation, *context, p["info"]["total_token_usage"]["total_tokens"]))
            ordinal += 1
    return out


def test_a_log_in_many_splits_is_parsed_alike(spark):
    r = random.Random(11)
    logs = {f"f{k}": list(records(r, n)) for k, n in enumerate((0, 1, 7, 60, 130))}
    rows = [(f, at, json.dumps(x)) for f, lines in logs.items() for at, x in enumerate(lines, 1)]
    lines = spark.createDataFrame(r.sample(rows, len(rows)), "file string, record_index long, line string")
    want = sorted((f, *x) for f, found in logs.items() for x in plain_state(found))
    columns = ("file", "record_index", "turn_id", "ordinal", "operation", "model", "reasoning_effort", F.col("cumulative.total_tokens"))
    for split_rows in (4, 1 << 16):
        work = Scratch(spark)
        parsed = parse_rollouts(lines, work, split_rows)
        assert sorted(map(tuple, parsed.checkpoints.select(*columns).collect()), key=str) == sorted(want, key=str)
        events = work.save(parsed.checkpoints, "checkpoints")
        whole, cut = (calculate_deltas(events, split_rows=n).select("file", "record_index", "delta", "flags").collect() for n in (None, 3))
        assert sorted(map(str, whole)) == sorted(map(str, cut))


def test_a_file_in_many_blocks_is_numbered_alike(spark, tmp_path):
    """Blocks of 64 bytes, a line longer than several of them, empty lines, a torn end, a byte-order mark."""
    folder = tmp_path / "sessions"
    folder.mkdir()
    files = {
        "long": "".join(f"line {k} " + "é" * (k % 40) + "\n" for k in range(300)),
        "wide": "a\n" + "x" * 500 + "\n\n\nend\n",
        "torn": "a\nb\n" + "y" * 200,
        "only torn": "z",
        "empty": "",
        "carriage": "a\r\nb\r\n",
        "mark": "﻿a\nb\n",
        "mark torn": "﻿a\nb",
    }
    for name, text in files.items():
        (folder / f"{name}.jsonl").write_bytes(text.encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    was = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "64")
        work = Scratch(spark)
        got = read_lines(spark, f"file://{folder}", work=work).collect()
        blocks = spark.read.parquet(f"{work.root}/lines").groupBy("file").agg(F.count_distinct("block").alias("n")).collect()
    finally:
        for n, v in was.items():
            spark.conf.set(n, v)
    assert max(b["n"] for b in blocks) > 50
    want = sorted((name, k + 1, line) for name, text in files.items() for k, line in enumerate(text.removeprefix("﻿").split("\n")[:-1]))
    name = lambda uri: uri.rsplit("/", 1)[1].removesuffix(".jsonl").replace("%20", " ")
    assert sorted((name(x["file"]), x["record_index"], x["line"]) for x in got) == want


def test_discovery_reads_no_text(spark, tmp_path):
    for name in ("sessions/2026/a", "sessions/b", "archived_sessions/c"):
        path = tmp_path / f"{name}.jsonl"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("{}\n" * 5)
    (tmp_path / "sessions" / "other.txt").write_text("no log")
    found = discover(spark, f"file://{tmp_path}")
    assert sorted((r["file"].rsplit("/", 1)[1], r["priority"], r["size"]) for r in found.collect()) == [("a.jsonl", 0, 15), ("b.jsonl", 0, 15), ("c.jsonl", 1, 15)]
    assert "content" not in found._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert discover(spark, f"file://{tmp_path}/nowhere").isEmpty()
