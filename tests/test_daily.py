import random

from pyspark.sql import functions as F

from tallyspark.operators import daily
from tallyspark.work import Scratch

STATE = "source_event_id string, thread_key string, turn_key string, own_project_id string, utc_date string, effective_project_id string, device_id string, model string, input_tokens long, cached_input_tokens long, output_tokens long, reasoning_output_tokens long, total_tokens long"


def event(r, key):
    own = r.choice(["a", "b", "c", None])
    counts = [r.choice([None, r.randrange(90)]) for _ in range(4)]
    return (key, f"thread{r.randrange(3)}", f"turn{r.randrange(5)}", own, f"2026-01-0{r.randrange(1, 6)}", own, r.choice("xy"), r.choice(["m", None]), *counts, r.randrange(90))


def rebuilt(rows):
    """The view from all rows at once."""
    groups = {}
    for x in rows:
        groups.setdefault((x[4], x[5], x[6], x[7]), []).append(x[8:])
    add = lambda v: sum(n for n in v if n is not None) if any(n is not None for n in v) else None
    return sorted(((*k, *map(add, zip(*v, strict=True)), len(v)) for k, v in groups.items()), key=str)


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    """Revisions, voids, other assignments and aliases, batch by batch; a batch that is run again changes nothing."""
    r, path = random.Random(12), f"file://{tmp_path}/daily"
    now, alias = {}, {}
    for batch in range(1, 5):
        work = Scratch(spark)
        before = dict(now)
        new = {f"e{k}": event(r, f"e{k}") for k in r.sample(range(60), 25)}
        gone = set(r.sample(sorted(now), min(len(now), 6)))
        was = dict(alias)
        alias = {"a": "b"} if batch == 2 else {"a": "c", "b": "c"} if batch == 3 else alias
        now = {k: v for k, v in (now | new).items() if k not in gone}
        resolved = lambda x, names: (*x[:5], names.get(x[3], x[3]), *x[6:])
        now = {k: resolved(v, alias) for k, v in now.items()}
        state = work.save(spark.createDataFrame(list(before.values()), STATE), "state")
        events = spark.createDataFrame([(k,) for k in {*new, *gone}], "source_event_id string")
        table = lambda d: spark.createDataFrame(list(d.items()), "source string, target string")
        projects = daily.changed_aliases(table(was), table(alias))
        keys = work.save(daily.affected(state, events, projects=projects), "keys")
        touched = {x[0] for x in keys.collect()}
        assert {k for k in before.keys() | now.keys() if before.get(k) != now.get(k)} <= touched
        after = work.save(spark.createDataFrame([v for k, v in now.items() if k in touched], STATE), "after")
        changes = work.save(daily.day_changes(state.join(keys, "source_event_id", "left_semi"), after), "signed")
        if batch == 4:  # stopped after one day
            first = changes.agg(F.min("utc_date")).first()[0]
            daily.rewrite_days(spark, path, changes.where(F.col("utc_date") == first), batch, Scratch(spark))
        days = daily.rewrite_days(spark, path, changes, batch, work)
        assert {x[0] for x in days.collect()} == {x[0] for x in changes.select("utc_date").distinct().collect()} - ({first} if batch == 4 else set())
        assert daily.rewrite_days(spark, path, changes, batch, Scratch(spark)).isEmpty()
        columns = [*daily.DIMENSIONS, *daily.SUMS, "event_count"]
        found = daily.shown(spark.read.parquet(path).withColumn("utc_date", F.col("utc_date").cast("string"))).select(*columns)
        assert sorted(map(tuple, found.collect()), key=str) == rebuilt(now.values())
        assert {k: v for k, v in now.items()} == {x[0]: tuple(x) for x in daily.next_state(state, keys, after).collect()}


def test_untouched_days_keep_their_files(spark, tmp_path):
    path, r = tmp_path / "daily", random.Random(1)
    rows = [(*event(r, f"e{k}")[:4], f"2026-02-0{k}", *event(r, "x")[5:]) for k in range(1, 5)]
    state = spark.createDataFrame(rows, STATE)
    daily.rewrite_days(spark, f"file://{path}", daily.day_changes(state.where("false"), state), 1, Scratch(spark))
    files = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    daily.rewrite_days(spark, f"file://{path}", daily.day_changes(state.where("source_event_id = 'e2'"), state.where("false")), 2, Scratch(spark))
    kept = {f for f in path.rglob("*.parquet") if files.get(f) == f.stat().st_mtime_ns}
    assert {f.parent.name for f in kept} == {"utc_date=2026-02-01", "utc_date=2026-02-03", "utc_date=2026-02-04"}
    assert daily.shown(spark.read.parquet(f"file://{path}")).where("utc_date = '2026-02-02'").isEmpty()
