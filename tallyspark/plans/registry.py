"""All queries of the ledger engine over the supplied tables, and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import derive, derive_inline
from ..functions.remote import normalize_remote, remote_error, resolve_remote
from ..functions.text import canonical_json, short_identifier, single_line
from ..operators import daily, doctor, graph, lifecycle, projects, replay
from ..operators.attribution import activity_evidence, cascade, lineage_hints, thread_hints
from ..operators.report import ReportQuery, daily_usage_utc, grand_total, latest_names, records, usage_report
from ..operators.tour import euler_tour
from ..operators.validate import location_codes, schema_violations
from ..sources.appendonly import append_only, split_digests
from ..sources.rollouts import parse_rollouts, read_lines
from ..work import Scratch, spread
from .views import duckdb_view as dv
from .views import view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TEST_KEY = b"test key of thirty-two bytes ..."
SUMS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- reports ---

RAW = {"project": "coalesce(effective_project_id, '')", "date": "strftime(occurred_ts + INTERVAL 9 HOUR, '%Y-%m-%d')", "thread": "thread_key", "model": "coalesce(model, '')", "effort": "coalesce(reasoning_effort, '')", "device": "device_id", "source": "source_kind"}


def report_sql(dims: tuple[str, ...], where: str = "true", source: str = "usage") -> str:
    raw = ", ".join(f"{RAW[d]} AS raw_{d}" for d in dims)
    known = "delta_total_tokens IS NOT NULL"
    sums = ", ".join(f"CAST(sum(delta_{c}) FILTER ({known}) AS BIGINT) AS {c}, count(delta_{c}) FILTER ({known}) BETWEEN 1 AND count(delta_total_tokens) - 1 AS {c}_partial" for c in SUMS)
    names = ", ".join(f"raw_{d}" for d in dims)
    series = ", ".join(f"raw_{d}" for d in dims if d != "date") or "0"
    running = f"CAST(sum(coalesce(total_tokens, 0)) OVER (PARTITION BY {series} ORDER BY raw_date ROWS UNBOUNDED PRECEDING) AS BIGINT)" if "date" in dims else "coalesce(total_tokens, 0)"
    return f"""WITH r AS (SELECT {raw}, * FROM {dv(source)}), g AS (SELECT {names}, {sums}, count(delta_total_tokens) AS included_events, count(*) - count(delta_total_tokens) AS excluded_events FROM r WHERE {where} GROUP BY {names})
SELECT *, {running} AS cumulative_total_tokens FROM g"""


def run_report(spark: SparkSession, sf_dir: str, q: ReportQuery, source: str = "usage") -> DataFrame:
    report = usage_report(records(view(spark, sf_dir, source), None, q), q)
    return report.select(*[f"raw_{d}" for d in q.group_by], *[x for c in SUMS for x in (c, f"{c}_partial")], "included_events", "excluded_events", "cumulative_total_tokens")


def add_report(name: str, q: ReportQuery, where: str = "true", source: str = "usage") -> None:
    query(name, report_sql(q.group_by, where, source))(lambda spark, sf_dir: run_report(spark, sf_dir, q, source))


add_report("report_project_date", ReportQuery())
add_report("report_model_device", ReportQuery(("model", "device")))
add_report("report_all_dimensions", ReportQuery(("source", "effort", "project", "date", "device", "model")))
add_report("report_filtered_range", ReportQuery(("date", "model"), dt.date(2024, 1, 5), dt.date(2024, 1, 20), device="device-1", source="click"), f"device_id = 'device-1' AND source_kind = 'click' AND {RAW['date']} BETWEEN '2024-01-05' AND '2024-01-20'")
add_report("report_unclassified", ReportQuery(("thread",), project="unclassified"), "effective_project_id IS NULL")
add_report("report_model_filter", ReportQuery(("project",), model="purchase"), "model = 'purchase'")
add_report("bench_report_lineitem", ReportQuery(("project", "date")), source="bench")


@query("report_grand_total", f"""SELECT {", ".join(f"CAST(sum(delta_{c}) FILTER (delta_total_tokens IS NOT NULL) AS BIGINT) AS {c}" for c in SUMS)}, count(delta_total_tokens) AS included_events, count(*) - count(delta_total_tokens) AS excluded_events FROM {dv("usage")}""")
def report_grand_total(spark, sf_dir):
    return grand_total(records(view(spark, sf_dir, "usage"), None, ReportQuery())).select(*SUMS, "included_events", "excluded_events")


@query("report_labels", f"""SELECT DISTINCT CASE WHEN effective_project_id IS NULL THEN '미분류' ELSE 'prj_' || substr(split_part(effective_project_id, '_h1_', 2), 1, 8) || '…' END AS label_project, 'thread_' || substr(split_part(thread_key, '_h1_', 2), 1, 8) || '…' AS label_thread, coalesce(model, '알 수 없음') AS label_model FROM {dv("usage")}""")
def report_labels(spark, sf_dir):
    return records(view(spark, sf_dir, "usage"), None, ReportQuery()).select("label_project", "label_thread", "label_model").distinct()


@query("report_thread_top", f"""SELECT thread_key, CAST(sum(delta_total_tokens) AS BIGINT) AS total_tokens FROM {dv("usage")} GROUP BY thread_key ORDER BY 2 DESC, 1 LIMIT 20""")
def report_thread_top(spark, sf_dir):
    """The 20 busiest threads."""
    rows = view(spark, sf_dir, "usage").groupBy("thread_key").agg(F.sum("delta_total_tokens").alias("total_tokens"))
    return rows.orderBy(F.col("total_tokens").desc_nulls_last(), "thread_key").limit(20)


@query("period_week", f"""SELECT strftime(occurred_ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS events FROM {dv("usage")} WHERE strftime(occurred_ts + INTERVAL 9 HOUR, '%Y-%m-%d') BETWEEN '2024-01-15' AND '2024-01-18' GROUP BY 1""")
def period_week(spark, sf_dir):
    from ..operators.report import period

    first, last = period("week", dt.datetime(2024, 1, 18, 3, tzinfo=dt.UTC), "Asia/Seoul")
    return records(view(spark, sf_dir, "usage"), None, ReportQuery(from_date=first, to_date=last)).groupBy(F.col("raw_date").alias("day")).agg(F.count("*").alias("events"))


@query("daily_usage_utc", f"""SELECT substr(occurred_at, 1, 10) AS utc_date, effective_project_id, device_id, model, {", ".join(f"CAST(sum(delta_{c}) AS BIGINT) AS {c}" for c in SUMS)}, count(*) AS event_count FROM {dv("usage")} WHERE delta_total_tokens IS NOT NULL GROUP BY 1, 2, 3, 4""")
def q_daily_usage_utc(spark, sf_dir):
    return daily_usage_utc(view(spark, sf_dir, "usage")).select("utc_date", "effective_project_id", "device_id", "model", *SUMS, "event_count")


_FLAT = f"""WITH RECURSIVE e AS (SELECT * FROM {dv("aliases")}), w(src, dst, path) AS (SELECT src, dst, [src, dst] FROM e UNION ALL SELECT w.src, e.dst, list_append(path, e.dst) FROM w JOIN e ON w.dst = e.src WHERE NOT list_contains(path, e.dst)),
cyc AS (SELECT DISTINCT e.src AS node FROM e LEFT JOIN w ON w.src = e.dst AND w.dst = e.src WHERE w.src IS NOT NULL OR e.src = e.dst), ends AS (SELECT src, dst, len(path) - 1 AS depth FROM w WHERE src NOT IN (SELECT node FROM cyc) AND (dst IN (SELECT node FROM cyc) OR dst NOT IN (SELECT src FROM e)))
"""


@query("names_latest", _FLAT + """, f AS (SELECT src, arg_min(dst, depth) AS dst FROM ends GROUP BY src), m AS (SELECT n_nationkey AS n, 'name ' || n_nationkey AS display, '2024-01-01T00:00:00' || CASE WHEN n_nationkey % 2 = 0 THEN 'Z' ELSE '.5Z' END AS told FROM nation)
SELECT CAST(coalesce(f.dst, m.n) AS VARCHAR) AS subject, arg_max(display, told || 'map-' || lpad(CAST(n AS VARCHAR), 3, '0')) AS name FROM m LEFT JOIN f ON f.src = m.n GROUP BY 1""")
def names_latest(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    edges = view(spark, sf_dir, "aliases").selectExpr("cast(src as string) src", "cast(dst as string) dst")
    flat, _ = graph.flatten_aliases(edges, Scratch(spark))
    n = F.col("n_nationkey").cast("string")
    names = nation.select(F.lit("project_name").alias("kind"), n.alias("subject_id"), F.concat(F.lit("name "), n).alias("display_value"), F.concat(F.lit("2024-01-01T00:00:00"), F.when(F.col("n_nationkey") % 2 == 0, "Z").otherwise(".5Z")).alias("occurred_at"), F.concat(F.lit("map-"), F.lpad(n, 3, "0")).alias("event_id"))
    return latest_names(names, flat).select("subject", "name")


# --- projects and diagnostics ---


@query("project_list", f"""SELECT effective_project_id AS project_id, count(DISTINCT thread_key) AS threads, CAST(coalesce(sum(delta_total_tokens), 0) AS BIGINT) AS total_tokens, count(delta_total_tokens) AS included_events, count(*) - count(delta_total_tokens) AS excluded_events FROM {dv("usage")} WHERE effective_project_id IS NOT NULL GROUP BY 1""")
def project_list(spark, sf_dir):
    return projects.project_list(view(spark, sf_dir, "usage"))


@query("unresolved_threads", f"""SELECT thread_key, array_to_string(list_sort(list(DISTINCT project_resolution)), ',') AS reasons, CAST(sum(delta_total_tokens) AS BIGINT) AS total_tokens, count(delta_total_tokens) AS included_events, count(*) - count(delta_total_tokens) AS excluded_events FROM {dv("usage")} WHERE effective_project_id IS NULL GROUP BY 1""")
def unresolved_threads(spark, sf_dir):
    return projects.unresolved_threads(view(spark, sf_dir, "usage")).withColumn("reasons", F.array_join("reasons", ","))


@query("unresolved_reasons", f"""SELECT project_resolution, count(*) AS events, count(DISTINCT thread_key) AS threads FROM {dv("usage")} WHERE effective_project_id IS NULL GROUP BY 1""")
def unresolved_reasons(spark, sf_dir):
    return projects.unresolved_reasons(view(spark, sf_dir, "usage"))


@query("source_join_audit", "SELECT count(*) FILTER (l.doc_id IS NULL) AS left_only, count(*) FILTER (d.doc_id IS NULL) AS right_only, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def source_join_audit(spark, sf_dir):
    return doctor.source_join(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_ISSUES = f"""WITH RECURSIVE c AS (SELECT DISTINCT child, parent, CASE source WHEN 'sqlite_spawn' THEN 30 WHEN 'session_source' THEN 20 WHEN 'fork' THEN 10 ELSE 0 END AS prio FROM {dv("parents")}),
o AS (SELECT *, max(prio) OVER (PARTITION BY child) AS best FROM c WHERE child <> parent), t AS (SELECT child, parent, count(*) OVER (PARTITION BY child) AS n FROM (SELECT DISTINCT child, parent FROM o WHERE prio = best)),
e AS (SELECT child AS src, parent AS dst FROM t WHERE n = 1), w(src, dst, path) AS (SELECT src, dst, [src, dst] FROM e UNION ALL SELECT w.src, e.dst, list_append(path, e.dst) FROM w JOIN e ON w.dst = e.src WHERE w.src <> w.dst AND (NOT list_contains(path, e.dst) OR e.dst = w.src)),
issues AS (SELECT DISTINCT child, parent, 'self_parent_ignored' AS code FROM c WHERE child = parent UNION ALL SELECT child, parent, 'conflicting_parent_ignored' FROM t WHERE n > 1
 UNION ALL SELECT DISTINCT o.child, o.parent, 'lower_priority_parent_ignored' FROM o LEFT JOIN e ON e.src = o.child WHERE prio < best AND (e.dst IS NULL OR o.parent <> e.dst) UNION ALL SELECT src, dst, 'lineage_cycle_ignored' FROM e WHERE src IN (SELECT src FROM w WHERE src = dst))
"""


@query("doctor_checks", _ISSUES + f"""SELECT 'parser-issues' AS name, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status, count(*) || ': click=' || count(*) FILTER (source_kind = 'click') || ', error=' || count(*) FILTER (source_kind = 'error') AS message FROM {dv("usage")} WHERE source_kind IN ('click', 'error')
UNION ALL SELECT 'outbox', CASE WHEN count(*) FILTER (delta_total_tokens IS NULL) > 0 THEN 'warning' ELSE 'ok' END, count(*) FILTER (delta_total_tokens IS NULL) || ' pending' FROM {dv("usage")}
UNION ALL SELECT 'lineage', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END, count(*) || ' issues' FROM issues""")
def doctor_checks(spark, sf_dir):
    usage = view(spark, sf_dir, "usage")
    outbox = usage.select(F.when(F.col("delta_total_tokens").isNotNull(), F.col("occurred_ts")).alias("flushed_at"))
    return doctor.doctor(doctor.parser_issues(usage.where("source_kind in ('click', 'error')").select(F.col("source_kind").alias("code"))), doctor.outbox(outbox), doctor.lineage(graph.build_lineage(view(spark, sf_dir, "parents").select("child", "parent", "source"), Scratch(spark))[1]))


@query("known_projects", f"""SELECT DISTINCT p AS project_id FROM (SELECT project_id AS p FROM {dv("usage")} UNION ALL SELECT CAST(src AS VARCHAR) FROM {dv("aliases")} UNION ALL SELECT CAST(dst AS VARCHAR) FROM {dv("aliases")}) WHERE p IS NOT NULL""")
def known_projects(spark, sf_dir):
    mappings = view(spark, sf_dir, "aliases").select(F.lit("project").alias("subject_type"), F.col("src").cast("string").alias("subject_id"), F.col("dst").cast("string").alias("target_project_id"))
    return projects.known_projects(view(spark, sf_dir, "usage"), mappings)


# --- deltas and forks ---


def checkpoints(spark: SparkSession, sf_dir: str, name: str = "checkpoints") -> DataFrame:
    rows, null = view(spark, sf_dir, name), F.lit(None).cast("bigint")
    counts = F.struct("input_tokens", "cached_input_tokens", null.alias("cache_write_input_tokens"), "output_tokens", null.alias("reasoning_output_tokens"), "total_tokens")
    last = F.when(F.col("last_total").isNotNull(), F.struct(*[null.alias(c) for c in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")], F.col("last_total").alias("total_tokens")))
    return rows.select("file", "n", "record_index", "thread_id", "forked_from", "turn_id", "ordinal", "operation", "model", "reasoning_effort", counts.alias("cumulative"), last.alias("reported_last"))


_DELTA = f"""SELECT *, CASE WHEN fell THEN NULL WHEN pt IS NULL THEN total_tokens ELSE total_tokens - pt END AS d_total, CASE WHEN fell THEN NULL WHEN pt IS NULL THEN input_tokens WHEN input_tokens >= pi THEN input_tokens - pi END AS d_input, CASE WHEN fell THEN NULL WHEN pt IS NULL THEN output_tokens WHEN output_tokens >= po THEN output_tokens - po END AS d_output, CASE WHEN fell THEN NULL WHEN pt IS NULL THEN cached_input_tokens WHEN cached_input_tokens >= pc THEN cached_input_tokens - pc END AS d_cached
 FROM (SELECT *, coalesce(total_tokens < pt, false) AS fell FROM (SELECT *, lag(total_tokens) OVER w AS pt, lag(input_tokens) OVER w AS pi, lag(output_tokens) OVER w AS po, lag(cached_input_tokens) OVER w AS pc FROM {{}} WINDOW w AS (PARTITION BY file ORDER BY record_index)))"""
_FLAGS = """concat_ws(',', CASE WHEN operation = 'compact' AND d_total = 0 AND last_total > 0 THEN 'compact_reported_last_excluded' END, CASE WHEN NOT fell AND cached_input_tokens < pc THEN 'component_regression:cached_input_tokens' END, CASE WHEN NOT fell AND input_tokens < pi THEN 'component_regression:input_tokens' END, CASE WHEN NOT fell AND output_tokens < po THEN 'component_regression:output_tokens' END,
 CASE WHEN fell THEN 'counter_regression' END, CASE WHEN d_input + d_output <> d_total THEN 'delta_total_mismatch' END, CASE WHEN operation <> 'compact' AND d_total > 0 AND last_total <> d_total THEN 'reported_last_mismatch' END, CASE WHEN input_tokens + output_tokens <> total_tokens THEN 'token_total_mismatch' END, CASE WHEN turn_id IS NULL THEN 'weak_dedupe_key' END)"""


@query("delta_lifecycle", f"""SELECT file, record_index, d_total AS delta_total, d_input AS delta_input, d_output AS delta_output, d_cached AS delta_cached FROM ({_DELTA.format(dv("checkpoints"))})""")
def delta_lifecycle(spark, sf_dir):
    return lifecycle.calculate_deltas(checkpoints(spark, sf_dir)).select("file", "record_index", F.col("delta.total_tokens").alias("delta_total"), F.col("delta.input_tokens").alias("delta_input"), F.col("delta.output_tokens").alias("delta_output"), F.col("delta.cached_input_tokens").alias("delta_cached"))


@query("delta_flags", f"""SELECT file, record_index, {_FLAGS} AS flags FROM ({_DELTA.format(dv("checkpoints"))})""")
def delta_flags(spark, sf_dir):
    return lifecycle.calculate_deltas(checkpoints(spark, sf_dir)).select("file", "record_index", F.array_join("flags", ",").alias("flags"))


_KEYED = f"""SELECT *, CASE WHEN turn_id IS NOT NULL THEN 'turn ' || turn_id || ' ' || ordinal ELSE 'record ' || thread_id || ' ' || record_index END AS key, CASE WHEN forked_from IS NULL THEN 0 ELSE 1 END AS depth FROM ({_DELTA.format(dv("forks"))})"""


@query("fork_dedup", f"""SELECT key, arg_min(file, (depth, thread_id, file, record_index)) AS file, CAST(arg_min(d_total, (depth, thread_id, file, record_index)) AS BIGINT) AS delta_total FROM ({_KEYED}) GROUP BY key""")
def fork_dedup(spark, sf_dir):
    return _deduplicated(spark, sf_dir).select("key", "file", F.col("delta.total_tokens").alias("delta_total"))


@query("metadata_merge", f"""SELECT key, CASE WHEN count(DISTINCT model) = 1 THEN max(model) END AS model, CASE WHEN count(DISTINCT reasoning_effort) = 1 THEN max(reasoning_effort) END AS reasoning_effort, count(DISTINCT model) > 1 AS model_conflict FROM ({_KEYED}) GROUP BY key""")
def metadata_merge(spark, sf_dir):
    return _deduplicated(spark, sf_dir).select("key", "model", "reasoning_effort", F.array_contains("flags", "metadata_conflict:model").alias("model_conflict"))


def _deduplicated(spark, sf_dir):
    work = Scratch(spark)
    rows = checkpoints(spark, sf_dir, "forks")
    events = lifecycle.calculate_deltas(rows)
    done = lifecycle.deduplicate_events(events, lifecycle.fork_depths(rows.select("thread_id", "forked_from"), work))
    k = F.col("logical_key")
    return done.withColumn("key", F.concat_ws(" ", k["kind"], k["id"], k["n"].cast("string")))


@query("fork_conflicts", f"""SELECT key FROM (SELECT * REPLACE (CASE WHEN n % 12 = 0 AND depth = 1 THEN last_total + 1 ELSE last_total END AS last_total) FROM ({_KEYED})) GROUP BY key HAVING count(DISTINCT (turn_id, ordinal, operation, input_tokens, cached_input_tokens, output_tokens, total_tokens, last_total, d_total, d_input, d_output, d_cached, {_FLAGS})) > 1""")
def fork_conflicts(spark, sf_dir):
    k, total = F.col("logical_key"), F.col("reported_last")["total_tokens"]
    changed = F.when((F.col("n") % 12 == 0) & F.col("forked_from").isNotNull(), F.col("reported_last").withField("total_tokens", total + 1)).otherwise(F.col("reported_last"))
    return lifecycle.fork_conflicts(lifecycle.calculate_deltas(checkpoints(spark, sf_dir, "forks").withColumn("reported_last", changed))).select(F.concat_ws(" ", k["kind"], k["id"], k["n"].cast("string")).alias("key"))


@query("fork_depth", f"""WITH RECURSIVE w(thread_id, up, d) AS (SELECT src, dst, 1 FROM {dv("tree")} UNION ALL SELECT w.thread_id, t.dst, d + 1 FROM w JOIN {dv("tree")} t ON t.src = w.up) SELECT n AS thread_id, coalesce(max(d), 0)::INTEGER AS fork_depth FROM (SELECT src AS n FROM {dv("tree")} UNION SELECT 0) LEFT JOIN w ON w.thread_id = n GROUP BY 1""")
def fork_depth(spark, sf_dir):
    tree = view(spark, sf_dir, "tree").select(F.col("src").alias("thread_id"), F.col("dst").alias("forked_from"))
    root = spark.range(1).select(F.col("id").alias("thread_id"), F.lit(None).cast("bigint").alias("forked_from"))
    return lifecycle.fork_depths(tree.unionByName(root), Scratch(spark))


# --- replay ---


@query("latest_revision", f"""SELECT source_event_id, event_id, revision, voided FROM (SELECT *, row_number() OVER (PARTITION BY source_event_id ORDER BY revision DESC, event_id DESC) AS k FROM {dv("revisions")}) WHERE k = 1""")
def latest_revision(spark, sf_dir):
    return replay.latest_revisions(view(spark, sf_dir, "revisions"), "source_event_id").select("source_event_id", "event_id", "revision", "voided")


@query("revision_violations", f"""SELECT * FROM (SELECT source_event_id, revision, CASE WHEN revision = was THEN 'revision_conflict' WHEN revision <> coalesce(was, 0) + 1 THEN 'revision_gap' WHEN supersedes IS DISTINCT FROM bef THEN 'supersedes_mismatch' END AS code FROM (SELECT *, lag(event_id) OVER w AS bef, lag(revision) OVER w AS was FROM {dv("revisions")} WINDOW w AS (PARTITION BY source_event_id ORDER BY revision, event_id))) WHERE code IS NOT NULL""")
def revision_violations(spark, sf_dir):
    return replay.revision_violations(view(spark, sf_dir, "revisions"), "source_event_id")


@query("void_filter", f"""SELECT source_event_id, total FROM (SELECT *, row_number() OVER (PARTITION BY source_event_id ORDER BY revision DESC, event_id DESC) AS k FROM {dv("revisions")}) WHERE k = 1 AND NOT voided""")
def void_filter(spark, sf_dir):
    return replay.latest_revisions(view(spark, sf_dir, "revisions"), "source_event_id").where("not voided").select("source_event_id", "total")


@query("daily_incremental", _FLAT + f""", f AS (SELECT src, arg_min(dst, depth) AS dst FROM ends GROUP BY src), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_event_id ORDER BY revision DESC, event_id DESC) AS k FROM {dv("revisions")}) WHERE k = 1 AND NOT voided AND total IS NOT NULL)
SELECT right(source_event_id, 10) AS utc_date, CAST(coalesce(f.dst, last.project_id) AS BIGINT) AS effective_project_id, CAST(sum(total) AS BIGINT) AS total_tokens, count(*) AS event_count FROM last LEFT JOIN f ON f.src = last.project_id GROUP BY 1, 2""")
def daily_incremental(spark, sf_dir):
    """First the first revisions, without aliases; then all later ones, voids and aliases as signed changes of days."""
    work, shape = Scratch(spark), daily.Shape(("utc_date", "effective_project_id"), ("total_tokens",))
    ledger = view(spark, sf_dir, "revisions")
    flat, _ = graph.flatten_aliases(view(spark, sf_dir, "aliases"), work)

    def state_of(events: DataFrame, aliases: DataFrame) -> DataFrame:
        rows = replay.latest_revisions(events, "source_event_id").where("not voided and total is not null")
        rows = rows.join(aliases.select(F.col("source").alias("project_id"), "target"), "project_id", "left")
        return rows.select("source_event_id", "thread_key", "turn_key", F.col("project_id").alias("own_project_id"), F.expr("right(source_event_id, 10)").alias("utc_date"), F.coalesce("target", "project_id").cast("bigint").alias("effective_project_id"), F.col("total").alias("total_tokens"))

    nothing = flat.where("false")
    first = ledger.where("revision = 1")
    state = work.save(state_of(first, nothing), "state")
    stored = work.save(daily.day_changes(state.where("false"), state, shape), "daily")
    keys = daily.affected(state, ledger.where("revision > 1"), projects=daily.changed_aliases(nothing, flat))
    keys = work.save(keys, "keys")
    after = work.save(state_of(ledger.join(keys, "source_event_id", "left_semi"), flat), "after")
    changes = daily.day_changes(state.join(keys, "source_event_id", "left_semi"), after, shape)
    return daily.shown(daily.merged(stored, changes, shape), shape)


@query("alias_cycles", _FLAT + "SELECT node FROM cyc")
def alias_cycles(spark, sf_dir):
    return graph.cycle_nodes(view(spark, sf_dir, "aliases"), Scratch(spark), "cycles")


@query("alias_flatten", _FLAT + "SELECT src AS source, arg_min(dst, depth) AS target, CAST(min(depth) AS BIGINT) AS depth FROM ends GROUP BY src")
def alias_flatten(spark, sf_dir):
    return graph.flatten_aliases(view(spark, sf_dir, "aliases"), Scratch(spark))[0]


@query("alias_refusals", _FLAT + """SELECT a AS src, b AS dst FROM (SELECT n.n_nationkey::BIGINT AS a, m.n_nationkey::BIGINT AS b FROM nation n, nation m WHERE n.n_nationkey % 3 = 0 AND m.n_nationkey % 2 = 0) WHERE a = b OR EXISTS (SELECT 1 FROM w WHERE w.src = b AND w.dst = a)""")
def alias_refusals(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    new = nation.where("k % 3 = 0").select(F.col("k").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(24), F.lit(2)).cast("array<bigint>")).alias("dst"))
    return graph.would_close_cycle(view(spark, sf_dir, "aliases"), new, Scratch(spark))


@query("manual_override", _FLAT + f""", f AS (SELECT src AS source, arg_min(dst, depth) AS target FROM ends GROUP BY src UNION ALL SELECT node, node FROM cyc),
own AS (SELECT event_id, coalesce(CASE WHEN user_id % 5 = 0 AND revision = 1 THEN 3 END, CASE WHEN user_id % 4 = 0 THEN 11 END, project_id) AS p FROM {dv("revisions")})
SELECT event_id, coalesce(f.target, own.p)::BIGINT AS effective_project_id FROM own LEFT JOIN f ON f.source = own.p""")
def manual_override(spark, sf_dir):
    usage = view(spark, sf_dir, "revisions")
    # here a turn is named by its first revision, so that several turns of a thread differ
    usage = usage.withColumn("turn_key", F.when(F.col("revision") == 1, F.col("turn_key")))
    turns = usage.where("user_id % 5 = 0 and turn_key is not null").select("turn_key", F.lit(3).cast("bigint").alias("manual_turn")).distinct()
    threads = usage.where("user_id % 4 = 0").select("thread_key", F.lit(11).cast("bigint").alias("manual_thread")).distinct()
    flat, _ = graph.flatten_aliases(view(spark, sf_dir, "aliases"), Scratch(spark))
    return replay.effective_projects(usage, turns, threads, flat).select("event_id", "effective_project_id")


@query("exact_event_dedup", f"""SELECT DISTINCT event_id, total FROM (SELECT event_id, total FROM {dv("revisions")} UNION ALL SELECT event_id, total FROM {dv("revisions")} WHERE user_id % 3 = 0)""")
def exact_event_dedup(spark, sf_dir):
    rows = view(spark, sf_dir, "revisions").select("event_id", "total", "user_id")
    return replay.exact_events(rows.unionByName(rows.where("user_id % 3 = 0"))).select("event_id", "total")


@query("event_id_conflicts", f"""SELECT event_id, 2::BIGINT AS payloads FROM {dv("revisions")} WHERE user_id % 3 = 0 AND total IS NOT NULL""")
def event_id_conflicts(spark, sf_dir):
    rows = view(spark, sf_dir, "revisions").select("event_id", "user_id", F.col("total").cast("string").alias("payload_json"))
    return replay.event_id_conflicts(rows.unionByName(rows.where("user_id % 3 = 0").withColumn("payload_json", F.concat("payload_json", F.lit("!")))))


# --- lineage and attribution ---

_TOP = f"""SELECT child, CASE WHEN count(DISTINCT parent) = 1 THEN max(parent) END AS parent, count(DISTINCT parent) AS n FROM (SELECT *, max(p) OVER (PARTITION BY child) AS best FROM (SELECT DISTINCT child, parent, CASE source WHEN 'sqlite_spawn' THEN 30 WHEN 'session_source' THEN 20 ELSE 10 END AS p FROM {dv("parents")} WHERE child <> parent)) WHERE p = best GROUP BY child"""


@query("parent_selection", f"SELECT child, parent FROM ({_TOP}) WHERE n = 1")
def parent_selection(spark, sf_dir):
    return graph.select_parents(view(spark, sf_dir, "parents"))[0]


@query("lineage_cycles_removed", f"""WITH RECURSIVE e AS (SELECT child AS src, parent AS dst FROM ({_TOP}) WHERE n = 1), w(src, dst, path) AS (SELECT src, dst, [src, dst] FROM e UNION ALL SELECT w.src, e.dst, list_append(path, e.dst) FROM w JOIN e ON w.dst = e.src WHERE w.src <> w.dst AND (NOT list_contains(path, e.dst) OR e.dst = w.src))
SELECT src AS child, dst AS parent FROM e WHERE src NOT IN (SELECT src FROM w WHERE src = dst)""")
def lineage_cycles_removed(spark, sf_dir):
    return graph.build_lineage(view(spark, sf_dir, "parents"), Scratch(spark))[0]


@query("lineage_issues", _ISSUES + "SELECT child, parent, code FROM issues")
def lineage_issues(spark, sf_dir):
    return graph.build_lineage(view(spark, sf_dir, "parents"), Scratch(spark))[1]


_UP = f"""WITH RECURSIVE w(node, ancestor, depth) AS (SELECT src, dst, 1::BIGINT FROM {dv("tree")} UNION ALL SELECT w.node, t.dst, depth + 1 FROM w JOIN {dv("tree")} t ON t.src = w.ancestor) """


@query("ancestors", _UP + "SELECT node, ancestor, depth FROM w")
def ancestors(spark, sf_dir):
    return graph.ancestors(view(spark, sf_dir, "tree"), Scratch(spark), "up")


@query("descendants", _UP + "SELECT ancestor AS node, count(*) AS descendants, max(depth) AS height FROM w GROUP BY 1")
def descendants(spark, sf_dir):
    return graph.ancestors(view(spark, sf_dir, "tree"), Scratch(spark), "up").groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.max("depth").alias("height"))


@query("root_of", _UP + "SELECT node AS thread_id, CASE WHEN node % 10 = 3 THEN node + 1000 ELSE arg_max(ancestor, depth) END AS root FROM w GROUP BY node")
def root_of(spark, sf_dir):
    tree = view(spark, sf_dir, "tree").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    threads = tree.select(F.col("child").alias("thread_id"))
    declared = threads.where("thread_id % 10 = 3").select("thread_id", (F.col("thread_id") + 1000).alias("root"))
    return graph.roots(threads, tree, declared, Scratch(spark))


_OWN = """own AS (SELECT src AS t, CASE WHEN src % 3 = 0 THEN 'p' || (src % 4) END AS a, CASE WHEN src % 6 = 0 THEN 'q' END AS b FROM {}), sure AS (SELECT t, coalesce(a, b) AS hint FROM own WHERE (a IS NULL) <> (b IS NULL)), silent AS (SELECT t FROM own WHERE a IS NULL AND b IS NULL)"""


@query("descendant_consensus", _UP + f""", {_OWN.format(dv("tree"))} SELECT t AS thread_id, hint FROM sure UNION ALL SELECT ancestor, max(hint) FROM w JOIN sure ON sure.t = w.node WHERE ancestor IN (SELECT t FROM silent UNION SELECT 0) GROUP BY ancestor HAVING count(DISTINCT hint) = 1""")
def descendant_consensus(spark, sf_dir):
    tree, direct = _hinted(spark, sf_dir)
    work = Scratch(spark)
    return thread_hints(direct, euler_tour(tree, work), work)


def _hinted(spark, sf_dir):
    """(tree, threads that have one identity, two or none)."""
    tree = view(spark, sf_dir, "tree")
    t = F.col("src")
    ids = F.array(F.when(t % 3 == 0, F.concat(F.lit("p"), (t % 4).cast("string"))), F.when(t % 6 == 0, F.lit("q")))
    return tree, tree.select(t.alias("thread_id"), F.explode(F.array_compact(ids)).alias("identity"))


@query("lineage_hints", _UP + f""", {_OWN.format(dv("tree"))}, agreed AS (SELECT ancestor AS t, max(hint) AS hint FROM w JOIN sure ON sure.t = w.node GROUP BY ancestor HAVING count(DISTINCT hint) = 1),
hints AS (SELECT t, hint FROM sure UNION ALL SELECT t, hint FROM agreed WHERE t NOT IN (SELECT t FROM own WHERE a IS NOT NULL OR b IS NOT NULL)),
near AS (SELECT w.node AS t, arg_min(hint, depth) AS hint FROM w JOIN hints ON hints.t = w.ancestor GROUP BY w.node)
SELECT n.t AS thread_id, near.hint AS ancestor_project, r.hint AS root_project, agreed.hint AS descendant_project FROM (SELECT src AS t FROM {dv("tree")} UNION SELECT 0) n LEFT JOIN near ON near.t = n.t LEFT JOIN hints r ON r.t = 0 AND n.t <> 0 LEFT JOIN agreed ON agreed.t = n.t""")
def q_lineage_hints(spark, sf_dir):
    tree, direct = _hinted(spark, sf_dir)
    threads = tree.select(F.col("src").alias("thread_id")).union(tree.select("dst"))
    parents = tree.select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    work = Scratch(spark)
    roots = work.save(graph.roots(threads, parents, None, work), "roots")
    found = lineage_hints(threads, parents, roots, direct, work)
    return found.select("thread_id", "ancestor_project", "root_project", F.get("descendant_projects", F.lit(0)).alias("descendant_project"))


@query("preorder", f"""WITH RECURSIVE t AS (SELECT * FROM {dv("tree")}), d(node, parent, depth, path) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, [0::BIGINT] UNION ALL SELECT t.src, t.dst, depth + 1, list_append(path, t.src) FROM d JOIN t ON t.dst = d.node),
w(node, ancestor) AS (SELECT src, dst FROM t UNION ALL SELECT w.node, t.dst FROM w JOIN t ON t.src = w.ancestor), s AS (SELECT ancestor, count(*) AS n FROM w GROUP BY 1)
SELECT node, coalesce(parent, -1) AS parent, row_number() OVER (ORDER BY path) - 1 AS pre, coalesce(s.n, 0) + 1 AS size, depth FROM d LEFT JOIN s ON s.ancestor = d.node""")
def preorder(spark, sf_dir):
    return euler_tour(view(spark, sf_dir, "tree"), Scratch(spark)).select("node", F.coalesce("parent", F.lit(-1).cast("bigint")).alias("parent"), "pre", "size", "depth")


@query("attribution_resolution", f"""SELECT thread_id, CASE WHEN n % 11 = 0 THEN 'manual' WHEN n % 7 = 0 AND n % 2 = 0 THEN 'activity_git' WHEN n % 7 = 0 THEN 'ambiguous_multi_repo' WHEN n % 5 = 0 THEN 'self_origin' WHEN n % 5 = 1 THEN 'unique_remote' WHEN n % 5 = 2 AND n % 3 = 0 THEN 'ambiguous_remote' WHEN n % 13 < 3 THEN 'ancestor' WHEN n % 13 = 4 THEN 'root' WHEN n % 13 = 6 THEN 'descendant_consensus' WHEN n % 13 = 8 THEN 'local_mapping' ELSE 'unclassified' END AS project_resolution,
CASE WHEN n % 11 = 0 THEN 'm' WHEN n % 7 = 0 AND n % 2 = 0 THEN 'a' WHEN n % 7 = 0 THEN NULL WHEN n % 5 < 2 THEN 's' WHEN n % 5 = 2 AND n % 3 = 0 THEN NULL WHEN n % 13 < 3 THEN 'up' WHEN n % 13 = 4 THEN 'r' WHEN n % 13 = 6 THEN 'd' WHEN n % 13 = 8 THEN 'l' END AS project_identity FROM (SELECT DISTINCT thread_id, n FROM {dv("checkpoints")})""")
def attribution_resolution(spark, sf_dir):
    n = F.col("n")
    rows = view(spark, sf_dir, "checkpoints").select("thread_id", "n").distinct().withColumns(
        {
            "manual_project": F.when(n % 11 == 0, "m"),
            "activity_kind": F.when((n % 7 == 0) & (n % 2 == 0), "activity_git").when(n % 7 == 0, "ambiguous_multi_repo"),
            "activity_identity": F.when((n % 7 == 0) & (n % 2 == 0), "a"),
            "self_kind": F.when(n % 5 == 0, "self_origin").when(n % 5 == 1, "unique_remote").when((n % 5 == 2) & (n % 3 == 0), "ambiguous_remote").otherwise("local_only"),
            "self_canonical": F.when(n % 5 < 2, "s"),
            "ancestor_project": F.when(n % 13 < 3, "up"),
            "root_project": F.when(n % 13 <= 4, F.when(n % 13 != 3, "r")),
            "descendant_projects": F.when(n % 13 == 6, F.array(F.lit("d"), F.lit("d"))).when(n % 13 == 7, F.array(F.lit("d"), F.lit("e"))),
            "local_project": F.when(n % 13 == 8, "l"),
        }
    )
    return cascade(rows).select("thread_id", "project_resolution", "project_identity")


@query("activity_ambiguity", f"""WITH a AS (SELECT file AS c, record_index % 3 AS repo, CASE WHEN n % 4 = 0 THEN 'm' || (record_index % 2) END AS m, CASE WHEN (n + record_index) % 5 <> 0 THEN 'r' || (n % 2 * record_index) END AS r, (n + record_index) % 9 = 0 AS amb FROM {dv("checkpoints")}),
g AS (SELECT c, repo, list(DISTINCT m) FILTER (m IS NOT NULL) AS ms, list(DISTINCT r) FILTER (r IS NOT NULL) AS rs, bool_or(amb) AS amb FROM a GROUP BY c, repo),
i AS (SELECT *, CASE WHEN ms IS NOT NULL THEN ms ELSE coalesce(rs, []) END AS ids FROM g),
t AS (SELECT c, count(*) AS n, bool_or(amb OR len(ids) <> 1) AS op, list_sort(list_distinct(flatten(list(ids)))) AS ids, bool_or(ms IS NULL) AS rem FROM i GROUP BY c)
SELECT c AS checkpoint, n AS n_repositories, CASE WHEN op AND n = 1 AND len(ids) = 0 THEN NULL WHEN op AND n = 1 THEN 'ambiguous_remote' WHEN op OR len(ids) > 1 THEN 'ambiguous_multi_repo' WHEN rem THEN 'activity_git' ELSE 'local_mapping' END AS activity_kind, array_to_string(ids, ',') AS candidates FROM t""")
def activity_ambiguity(spark, sf_dir):
    n, r = F.col("n"), F.col("record_index")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    rows = view(spark, sf_dir, "checkpoints").select(F.col("file").alias("checkpoint"), (r % 3).alias("repository"), F.when(n % 4 == 0, F.array(name("m", r % 2))).alias("mapped"), F.when((n + r) % 5 != 0, name("r", n % 2 * r)).alias("canonical"), ((n + r) % 9 == 0).alias("ambiguous"))
    return activity_evidence(rows).select("checkpoint", "n_repositories", "activity_kind", F.array_join("activity_candidates", ",").alias("candidates"))


@query("normalize_remote", f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN host || '/' || path WHEN 1 THEN host || '/' || path WHEN 2 THEN host || ':2222/' || path WHEN 3 THEN 'github.com/owner/' || lower(path) END AS canonical, page_id % 8 IN (5, 6) AS error FROM {dv("remotes")}""")
def q_normalize_remote(spark, sf_dir):
    return view(spark, sf_dir, "remotes").select("page_id", normalize_remote(F.col("remote")).alias("canonical"), remote_error(F.col("remote")).alias("error"))


_NAMES = """CASE page_id % 8 WHEN 0 THEN host || '/' || path WHEN 1 THEN host || '/' || path WHEN 2 THEN host || ':2222/' || path WHEN 3 THEN 'github.com/owner/' || lower(path) END"""


@query("resolve_remote", f"""WITH c AS (SELECT page_id // 6 AS repo, page_id % 8 AS k, {_NAMES} AS n, page_id % 7 = 0 AS origin FROM {dv("remotes")}),
g AS (SELECT repo, list_sort(list(DISTINCT n) FILTER (n IS NOT NULL)) AS names, max(n) FILTER (origin) AS own, bool_or(k NOT IN (0, 1, 2, 3, 5, 6)) AS loc, bool_or(k IN (5, 6)) AS malformed FROM c GROUP BY repo)
SELECT repo, CASE WHEN own IS NOT NULL THEN 'self_origin' WHEN len(names) = 1 THEN 'unique_remote' WHEN len(names) > 1 THEN 'ambiguous_remote' WHEN loc THEN 'local_only' ELSE 'unclassified' END AS kind, CASE WHEN own IS NOT NULL THEN own ELSE coalesce(array_to_string(names, ','), '') END AS candidates, malformed FROM g""")
def q_resolve_remote(spark, sf_dir):
    """Six remotes to a repository, malformed ones among them; these name nothing and are told."""
    rows = view(spark, sf_dir, "remotes").withColumns({"repo": F.floor(F.col("page_id") / 6), "bad": remote_error(F.col("remote")), "origin": F.when(F.col("page_id") % 7 == 0, F.col("remote"))})
    rows = rows.groupBy("repo").agg(F.collect_set("remote").alias("remotes"), F.max("origin").alias("origin"), F.max("bad").alias("malformed"))
    return rows.select("repo", resolve_remote(F.col("origin"), F.col("remotes")).alias("r"), "malformed").select("repo", "r.kind", F.array_join("r.candidates", ",").alias("candidates"), "malformed")


# --- parsing, validation, identifiers ---


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session logs: a first record of metadata, turns that start and end, counts after each."""
    rows = view(spark, sf_dir, "checkpoints")
    at = F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("record_index").cast("string"), 2, "0"), F.lit(":00+00:00"))
    counts = F.struct("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")
    line = lambda kind, payload: F.to_json(F.struct(at.alias("timestamp"), F.lit(kind).alias("type"), payload.alias("payload")))
    records = F.array(
        F.when((F.col("turn_id").isNotNull()) & (F.col("record_index") % 2 == 1), line("event_msg", F.struct(F.lit("task_started").alias("type"), "turn_id"))),
        F.when(F.col("model").isNotNull(), line("turn_context", F.struct("turn_id", "model", F.col("reasoning_effort").alias("effort")))),
        F.when(F.col("operation") == "compact", line("compacted", F.struct(F.lit(1).alias("x")))),
        line("event_msg", F.struct(F.lit("token_count").alias("type"), F.struct(counts.alias("total_token_usage")).alias("info"))),
        F.when(F.col("record_index") % 2 == 0, line("event_msg", F.struct(F.lit("task_complete").alias("type"), "turn_id"))),
    )
    body = rows.select("file", F.col("record_index").alias("r"), F.posexplode(F.array_compact(records)).alias("p", "line"))
    meta = rows.select("file", "thread_id").distinct().select("file", F.lit(0).cast("bigint").alias("r"), F.lit(0).alias("p"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.col("thread_id").alias("id"), F.lit("cli").alias("source")).alias("payload"))).alias("line"))
    order = F.row_number().over(Window.partitionBy("file").orderBy("r", "p"))
    return meta.unionByName(body).select("file", order.alias("record_index"), "line")


# record 1 of a log starts a turn, record 2 ends it; a context without a started turn opens one of its own
_STATE = f"""SELECT file, record_index AS r, total_tokens, model IS NOT NULL AS ctx, turn_id IS NOT NULL AS named, * EXCLUDE (file, record_index, total_tokens) FROM {dv("checkpoints")}"""


@query("turn_ordinals", f"""SELECT file, total_tokens, turn_id, CASE WHEN turn_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY file, turn_id ORDER BY r) - 1 END::INTEGER AS ordinal FROM ({_STATE})""")
def turn_ordinals(spark, sf_dir):
    return parse_rollouts(rollout_lines(spark, sf_dir)).checkpoints.select("file", F.col("cumulative.total_tokens").alias("total_tokens"), "turn_id", "ordinal")


@query("carry_forward_context", f"""SELECT file, total_tokens, model, CASE WHEN model IS NOT NULL THEN reasoning_effort END AS reasoning_effort, CASE WHEN operation = 'compact' THEN 'compact' WHEN turn_id IS NULL THEN CASE WHEN r > 1 AND lag(operation) OVER w = 'compact' AND r % 2 = 0 THEN 'compact' ELSE 'unknown' END WHEN r % 2 = 0 AND lag(operation) OVER w = 'compact' THEN 'compact' ELSE 'turn' END AS operation FROM ({_STATE}) WINDOW w AS (PARTITION BY file ORDER BY r)""")
def carry_forward_context(spark, sf_dir):
    return parse_rollouts(rollout_lines(spark, sf_dir)).checkpoints.select("file", F.col("cumulative.total_tokens").alias("total_tokens"), "model", "reasoning_effort", "operation")


@query("log_record_numbers", """SELECT conv_id // 50 AS log, row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) AS record_index, concat('{"conv":', conv_id, ',"turn":', turn, ',"role":"', role, '"}') AS line FROM conversations""")
def log_record_numbers(spark, sf_dir):
    """Fifty conversations to a log, written as text and numbered as the blocks of the files are read."""
    work = Scratch(spark)
    line = F.format_string('{"conv":%d,"turn":%d,"role":"%s"}', F.col("conv_id"), F.col("turn"), F.col("role"))
    rows = table(spark, sf_dir, "conversations").select(F.expr("conv_id div 50").alias("log"), "conv_id", "turn", line.alias("value"))
    rows.repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "value").write.partitionBy("log").text(f"{work.root}/logs")
    found = read_lines(spark, f"{work.root}/logs", work=work, pattern="*.txt")
    return found.select(F.regexp_extract("file", r"/log=(\d+)/", 1).cast("bigint").alias("log"), "record_index", "line")


@query("split_log_deltas", f"""SELECT file, record_index, d_total AS delta_total, d_input AS delta_input, {_FLAGS} AS flags FROM ({_DELTA.format(dv("checkpoints"))})""")
def split_log_deltas(spark, sf_dir):
    """Splits of two records, dealt out in any order."""
    rows = Scratch(spark).save(checkpoints(spark, sf_dir).repartition(7, F.rand(3)), "rows")
    return lifecycle.calculate_deltas(rows, split_rows=2).select("file", "record_index", F.col("delta.total_tokens").alias("delta_total"), F.col("delta.input_tokens").alias("delta_input"), F.array_join("flags", ",").alias("flags"))


@query("split_log_ordinals", ORACLE_SQL["turn_ordinals"])
def split_log_ordinals(spark, sf_dir):
    """turn_ordinals again, where no task sees more than two records of a log."""
    parsed = parse_rollouts(rollout_lines(spark, sf_dir), split_rows=2)
    return parsed.checkpoints.select("file", F.col("cumulative.total_tokens").alias("total_tokens"), "turn_id", "ordinal")


@query("rollout_metadata", f"""SELECT DISTINCT file, thread_id, thread_id AS root_session_id, 'cli' AS source_kind FROM {dv("checkpoints")}""")
def rollout_metadata(spark, sf_dir):
    return parse_rollouts(rollout_lines(spark, sf_dir)).metadata.select("file", "thread_id", "root_session_id", "source_kind")


@query("parser_issue_counts", f"""SELECT 'token_count_without_turn' AS code, count(*) AS n FROM {dv("checkpoints")} WHERE turn_id IS NULL""")
def parser_issue_counts(spark, sf_dir):
    return parse_rollouts(rollout_lines(spark, sf_dir)).issues.groupBy("code").agg(F.count("*").alias("n"))


@query("privacy_scan")
def privacy_scan(spark, sf_dir):
    """All codes over the texts as they are. DuckDB has no Unicode word edges; tests compare with Python patterns."""
    codes = location_codes(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(codes), ",").alias("codes"))


@query("privacy_scan_ascii", r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[\x00-\x1f\x7f]') THEN 'control_character' END, CASE WHEN regexp_matches(text, '(?i)\b[a-z0-9.-]+\.[a-z]{2,}(?::[0-9]+)?/[^ \t\n]+') THEN 'host_path' END, CASE WHEN regexp_matches(text, '(?i)\b(?:https?|ssh|git|file)://') OR regexp_matches(text, '(?:^|[ \t\n])[^@ \t\n]+@[^: \t\n]+:[^ \t\n]+') THEN 'network_location' END) AS codes FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7f]', 'x', 'g') AS text FROM documents)""")
def privacy_scan_ascii(spark, sf_dir):
    ascii_text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f]", "x")  # as the SQL engine's \b is ASCII-only
    codes = F.filter(location_codes(ascii_text), lambda c: c != "filesystem_path")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(codes), ",").alias("codes"))


@query("schema_violations", """SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN 'missing:kind' END, CASE WHEN event_id % 11 = 0 THEN 'occurred_at' END, CASE WHEN event_id % 7 = 0 THEN 'revision' END, CASE WHEN event_id % 3 = 0 THEN 'unexpected:extra' END) AS codes FROM events""")
def q_schema_violations(spark, sf_dir):
    e = F.col("event_id")
    text = lambda v: F.lit(v).cast("string")
    common = {"schema_version": F.lit(1), "event_type": text("mapping"), "event_id": F.concat(F.lit("map-event-"), e.cast("string")), "revision": F.when(e % 7 == 0, 0).otherwise(1), "device_id": text("11111111-1111-4111-8111-111111111111"), "key_id": text("key_h1_0123456789"), "occurred_at": F.when(e % 11 == 0, "yesterday").otherwise("2026-08-25T15:30:00Z"), "subject_type": text("thread"), "subject_id": text("thr_h1_0123456789")}
    nulls = F.lit(',"supersedes":null,"target_project_id":null,"display_value":null')
    optional = F.concat(nulls, F.when(e % 5 != 0, F.lit(',"kind":"manual_assignment"')).otherwise(""), F.when(e % 3 == 0, F.lit(',"extra":[1]')).otherwise(""))
    json = F.to_json(F.struct(*[v.alias(k) for k, v in common.items()]))
    lines = spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", F.concat(F.regexp_replace(json, r"\}$", ""), optional, F.lit("}")).alias("value"))
    return schema_violations(lines).select("event_id", F.array_join("violations", ",").alias("codes"))


_COMMON = '"schema_version":1,"device_id":"11111111-1111-4111-8111-111111111111","key_id":"key_h1_0123456789","occurred_at":"2026-08-25T15:30:00Z"'
_NULLS = ("supersedes", "project_id", "root_thread_key", "parent_thread_key", "forked_from_thread_key", "turn_key", "model", "reasoning_effort", "cli_version", "delta")


def _event_lines(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """A JSON line for each event: parts are texts and columns, one after the other."""
    line = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return spread(table(spark, sf_dir, "events").select("event_id")).select("event_id", line.alias("value"))


def _every(n: int, then: str, otherwise: str):
    return F.when(F.col("event_id") % n == 0, then).otherwise(otherwise)


@query("schema_usage", """SELECT event_id, concat_ws(',', CASE WHEN event_id % 7 = 0 THEN 'cumulative.output_tokens' END, CASE WHEN event_id % 11 = 0 THEN 'flags' END, CASE WHEN event_id % 13 = 0 THEN 'missing:reported_last.total_tokens' END, CASE WHEN event_id % 5 = 0 THEN 'operation' END, CASE WHEN event_id % 3 = 0 THEN 'unexpected:path' END) AS codes FROM events""")
def schema_usage(spark, sf_dir):
    """Usage events with faults at two depths."""
    counters = ",".join(f'"{c}":null' for c in ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens"))
    lines = _event_lines(
        spark,
        sf_dir,
        "{" + _COMMON + ',"event_type":"usage_checkpoint","source_event_id":"src_h1_0123456789","revision":1,"voided":false,"parser_version":"1","project_resolution":"root","activity_repository_count":0,"thread_key":"thr_h1_0123456789","source_kind":"cli",',
        ",".join(f'"{c}":null' for c in _NULLS) + ',"event_id":"evt_h1_0123456789","token_event_ordinal":',
        F.col("event_id").cast("string"),
        ',"operation":',
        _every(5, '"other"', '"turn"'),
        ',"flags":',
        _every(11, '["a","a"]', '["a","b"]'),
        ',"cumulative":{"total_tokens":9,' + counters + ',"output_tokens":',
        _every(7, "-1", "1"),
        '},"reported_last":{"output_tokens":1,' + counters,
        _every(13, "", ',"total_tokens":2'),
        "}",
        _every(3, ',"path":{"a":[1]}', ""),
        "}",
    )
    return schema_violations(lines).select("event_id", F.array_join("violations", ",").alias("codes"))


@query("schema_quota", """SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'event_type' END, CASE WHEN event_id % 13 <> 0 AND event_id % 7 = 0 THEN 'missing:reset_at' END, CASE WHEN event_id % 13 <> 0 AND event_id % 5 = 0 THEN 'used_percent' END, CASE WHEN event_id % 13 <> 0 AND event_id % 3 = 0 THEN 'window_minutes' END) AS codes FROM events""")
def schema_quota(spark, sf_dir):
    """Quota snapshots beyond their bounds, and events of no known type."""
    lines = _event_lines(
        spark,
        sf_dir,
        "{" + _COMMON + ',"event_id":"quota_h1_0123456789","scope_key":null,"remaining_percent":0.5,"event_type":',
        _every(13, '"gauge"', '"quota_snapshot"'),
        ',"used_percent":',
        _every(5, "100.25", "99.75"),
        ',"window_minutes":',
        _every(3, "0", "null"),
        _every(7, "", ',"reset_at":"2026-08-25T15:30:00+09:00"'),
        "}",
    )
    return schema_violations(lines).select("event_id", F.array_join("violations", ",").alias("codes"))


_FILES = "SELECT concat('log-', user_id % 60) AS file, user_id % 60 AS k, row_number() OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id % 60) AS n, concat(event_id, ' ', event_type) AS line FROM {events}"
_OLD = "SELECT file, CAST(i AS BIGINT) AS record_index, line FROM ({files}) f WHERE k % 10 <> 9 AND i <= n - (k % 3) * 4"
_NEW = "SELECT file, CAST(i AS BIGINT) AS record_index, CASE WHEN k % 10 = 0 AND i = 3 THEN concat(line, '!') ELSE line END AS line FROM ({files}) f WHERE k % 10 <> 2 AND (k % 10 <> 1 OR i <= n - 20)"


@query("append_only_files", f"""WITH o AS ({_OLD.format(files=_FILES.format(events="events"))}), n AS ({_NEW.format(files=_FILES.format(events="events"))}),
b AS (SELECT coalesce(o.file, n.file) AS file, count(o.file) AS olds, count(n.file) AS news, count(*) FILTER (o.line <> n.line) AS other, count(*) FILTER (n.file IS NULL) AS missing FROM o FULL JOIN n ON n.file = o.file AND n.record_index = o.record_index GROUP BY 1)
SELECT file, CASE WHEN olds = 0 THEN 'new' WHEN news = 0 THEN 'gone' WHEN other > 0 THEN 'changed' WHEN missing > 0 THEN 'cut' WHEN news > olds THEN 'appended' ELSE 'same' END AS status FROM b""")
def append_only_files(spark, sf_dir):
    """Two states of logs made of events, in splits of 16 lines."""
    events = table(spark, sf_dir, "events")
    old, new = (spark.sql(text.format(files=_FILES), events=events) for text in (_OLD, _NEW))
    state = Scratch(spark).save(split_digests(old, 16), "state")
    return append_only(state, new, 16)


@query("short_identifier", "SELECT page_id, CASE WHEN len(url) > 12 THEN substr(url, 1, 8) || '…' ELSE url END AS short, regexp_replace(url, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS line FROM pages")
def q_short_identifier(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", short_identifier(F.col("url")).alias("short"), single_line(F.col("url")).alias("line"))


@query("hmac_ids")
def hmac_ids(spark, sf_dir):
    """Identifiers from Python workers beside those of the JVM: equal in every row."""
    url = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", derive(TEST_KEY, "thread", url).alias("thread_key"), derive_inline(TEST_KEY, "thread", url).alias("inline_key"))


@query("canonical_json", """SELECT event_id, sha256('{"event_type":' || to_json(event_type) || ',"props":' || to_json(props) || ',"user_id":' || user_id || '}') AS digest FROM events""")
def q_canonical_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.sha2(canonical_json("user_id", "event_type", "props"), 256).alias("digest"))
