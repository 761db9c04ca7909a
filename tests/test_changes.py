import io
import os
import random
import threading
import time

import pytest

from tallyspark.sources import changes
from tallyspark.sources.changes import changed_logs, lines_of, look, numbered, steady
from tallyspark.work import Scratch


@pytest.mark.parametrize("seed", range(20))
def test_ranges_give_each_whole_line_once(seed):
    r = random.Random(seed)
    text = b"".join(bytes(r.choice(b"ab") for _ in range(r.choice([0, 0, 1, 5, 40]))) + b"\n" for _ in range(r.randrange(12))) + r.choice([b"", b"torn", b"x" * 30])
    size = len(text)
    for step in (1, 2, 7, 64):
        got = [line for at in range(0, max(size, 1), step) for line in lines_of(io.BytesIO(text + b"\nlater\n"), at, min(at + step, size), size, block=3)]
        assert got == text.split(b"\n")[:-1]


class Watch:
    """A stream over a home; each run takes what changed since the last one."""

    def __init__(self, spark, root, tmp):
        self.spark, self.home, self.checkpoint, self.got = spark, f"file://{root}", f"file://{tmp}/offsets", []

    def run(self):
        self.got = []

        def take(batch, _):
            rows = Scratch(self.spark).save(batch, "batch")
            self.got += [(r["file"].rsplit("/", 1)[1], r["priority"], r["record_index"], r["line"]) for r in numbered(rows).collect()]

        stream = changed_logs(self.spark, self.home, settle=0.05, range_bytes=16)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", self.checkpoint).trigger(once=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(self.got)


def test_new_appended_replaced_and_unchanged_files(spark, tmp_path):
    home = tmp_path / "home"
    for folder in ("sessions/2026", "archived_sessions"):
        (home / folder).mkdir(parents=True)
    a, b = home / "sessions/2026/a.jsonl", home / "archived_sessions/b.jsonl"
    a.write_text("one\ntwo of many characters\n{torn")
    b.write_text("old\n")
    (home / "sessions/notes.txt").write_text("no log\n")
    watch = Watch(spark, home, tmp_path)
    assert watch.run() == [("a.jsonl", 0, 1, "one"), ("a.jsonl", 0, 2, "two of many characters"), ("b.jsonl", 1, 1, "old")]

    os.chmod(a, 0o000)  # a run without changes reads no text; root may read anything, so look at the offsets too
    before = look(watch.home)
    assert watch.run() == []
    assert changes.ChangedLogsReader({"path": watch.home}).partitions({"files": before}, {"files": look(watch.home)}) == []
    os.chmod(a, 0o644)

    with a.open("a") as f:
        f.write(" no more}\nthree\n")
    assert watch.run() == [("a.jsonl", 0, 1, "one"), ("a.jsonl", 0, 2, "two of many characters"), ("a.jsonl", 0, 3, "{torn no more}"), ("a.jsonl", 0, 4, "three")]

    b.write_text("new\n")  # of the same size, at another time
    os.utime(b, ns=(1, 10**18))
    assert watch.run() == [("b.jsonl", 1, 1, "new")]
    assert watch.run() == []


def test_busy_files_wait(tmp_path):
    (tmp_path / "sessions").mkdir()
    still, growing = tmp_path / "sessions/still.jsonl", tmp_path / "sessions/growing.jsonl"
    still.write_text("a\n")
    growing.write_text("a\n")
    stop = threading.Event()

    def grow():
        while not stop.is_set():
            with growing.open("a") as f:
                f.write("b\n")
            time.sleep(0.01)

    writer = threading.Thread(target=grow)
    writer.start()
    try:
        found, busy = steady(f"file://{tmp_path}", 0.2)
    finally:
        stop.set()
        writer.join()
    assert {os.path.basename(f) for f in found} == {"still.jsonl"}
    assert {os.path.basename(f) for f in busy} == {"growing.jsonl"}
    assert len(steady(f"file://{tmp_path}", 0.05)[0]) == 2
    assert steady(f"file://{tmp_path}/nowhere", 0.0) == ({}, set())
