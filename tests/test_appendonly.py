import random

import pytest

from tallyspark.sources.appendonly import append_only, refused, split_digests

LINES = "file string, record_index long, line string"


@pytest.mark.parametrize("split_rows", [1, 4, 1000])
def test_what_happened_to_files(spark, split_rows):
    r = random.Random(2)
    text = lambda n: [f"line {r.randrange(5)}" for _ in range(n)]
    old = {"same": text(9), "grown": text(8), "grown in its split": text(5), "rewritten": text(12), "last line": text(12), "cut": text(11), "cut to nothing": text(3), "swapped": ["a", "b", "c", "d", "e"]}
    new = dict(old) | {"grown": old["grown"] + text(9), "grown in its split": old["grown in its split"] + ["x"], "cut": old["cut"][:-2], "fresh": text(3), "swapped": ["b", "a", "c", "d", "e"]}
    new["rewritten"] = [*old["rewritten"][:2], "other", *old["rewritten"][3:]]
    new["last line"] = [*old["last line"][:-1], "other", "more"]
    del new["cut to nothing"]
    rows = lambda files: spark.createDataFrame([(f, k, x) for f, lines in files.items() for k, x in enumerate(lines, 1)], LINES).repartition(3)
    found = append_only(split_digests(rows(old), split_rows), rows(new), split_rows)
    want = {"same": "same", "grown": "appended", "grown in its split": "appended", "rewritten": "changed", "last line": "changed", "cut": "cut", "cut to nothing": "gone", "swapped": "changed", "fresh": "new"}
    assert {x["file"]: x["status"] for x in found.collect()} == want
    assert {x["file"] for x in refused(found).collect()} == {f for f, s in want.items() if s in ("changed", "cut", "gone")}
