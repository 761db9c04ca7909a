"""The supplied tables as ledger tables: each view once as Spark SQL and once as DuckDB SQL.

The two dialects differ in a few functions only, so a view is one text with named pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {
        "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
        "iso": "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\"), 'Z')",
        "day": "date_format(ts, 'yyyy-MM-dd')",
        "half": "(n - 1) div 2",
        "quarter": "n div 4",
        "ship": "concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00Z')",
        "ship_ts": "CAST(l_shipdate AS TIMESTAMP_NTZ)",
        "ts": "CAST(ts AS TIMESTAMP_NTZ)",
    },
    "duckdb": {
        "k": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
        "iso": "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')",
        "day": "strftime(ts, '%Y-%m-%d')",
        "half": "(n - 1) // 2",
        "quarter": "n // 4",
        "ship": "strftime(l_shipdate, '%Y-%m-%dT00:00:00Z')",
        "ship_ts": "l_shipdate",
        "ts": "ts",
    },
}

#: Usage: users are threads, event types models and sources; errors have no known total.
USAGE = """SELECT concat('evt-', event_id) AS event_id, {ts} AS occurred_ts, {iso} AS occurred_at, concat('thread_h1_', lpad(CAST(user_id AS STRING), 12, '0')) AS thread_key, concat('device-', user_id % 3) AS device_id,
 CASE WHEN user_id % 7 <> 0 THEN concat('prj_h1_', user_id % 7, 'abcdefghijk') END AS effective_project_id, CASE WHEN user_id % 7 <> 0 THEN concat('prj_h1_', user_id % 7, 'abcdefghijk') END AS project_id,
 CASE WHEN user_id % 7 <> 0 THEN 'self_origin' WHEN event_id % 3 = 0 THEN 'ambiguous_remote' ELSE 'unclassified' END AS project_resolution,
 nullif(event_type, 'signup') AS model, CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS reasoning_effort, event_type AS source_kind,
 CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) - {k} END AS delta_input_tokens, CASE WHEN {k} % 3 <> 0 THEN {k} END AS delta_cached_input_tokens, CAST(NULL AS BIGINT) AS delta_cache_write_input_tokens,
 {k} AS delta_output_tokens, CASE WHEN user_id % 2 = 0 THEN {k} END AS delta_reasoning_output_tokens, CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS delta_total_tokens FROM events"""

#: Lineitem as usage, for the benchmark.
BENCH = """SELECT {ship_ts} AS occurred_ts, {ship} AS occurred_at, concat('thr_', l_orderkey) AS thread_key, 'device' AS device_id, concat('prj_', l_suppkey % 50) AS effective_project_id, l_returnflag AS model, l_linestatus AS reasoning_effort, 'cli' AS source_kind,
 CAST(l_quantity AS BIGINT) AS delta_input_tokens, CAST(NULL AS BIGINT) AS delta_cached_input_tokens, CAST(NULL AS BIGINT) AS delta_cache_write_input_tokens, CAST(l_linenumber AS BIGINT) AS delta_output_tokens, CAST(NULL AS BIGINT) AS delta_reasoning_output_tokens,
 CAST(round(l_extendedprice) AS BIGINT) AS delta_total_tokens FROM lineitem"""

#: Cumulative counters: a conversation is a log, a turn a record; every tenth log falls back at its third record,
#: and every fourth has a fork that copies it, some with another model.
_SUMS = """SELECT conv_id AS n, turn, role, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END) OVER w AS BIGINT) AS i, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) OVER w AS BIGINT) AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
_LOGS = f"""SELECT n, turn, role, CASE WHEN n % 10 = 0 AND turn = 2 THEN CAST(floor(i / 2) AS BIGINT) ELSE i END AS i, CASE WHEN n % 10 = 0 AND turn = 2 THEN CAST(floor(o / 2) AS BIGINT) ELSE o END AS o FROM ({_SUMS})"""
CHECKPOINTS = f"""SELECT concat('log-', n) AS file, n, turn + 1 AS record_index, concat('thread-', n) AS thread_id, CAST(NULL AS STRING) AS forked_from, CASE WHEN n % 9 <> 0 THEN concat('turn-', n, '-', {{quarter_turn}}) END AS turn_id, CASE WHEN n % 9 <> 0 THEN turn % 2 ELSE 0 END AS ordinal,
 CASE WHEN role = 'system' THEN 'compact' ELSE 'turn' END AS operation, CASE WHEN n % 3 <> 0 THEN concat('model-', n % 5) END AS model, CASE WHEN n % 2 = 0 THEN 'high' END AS reasoning_effort, i AS input_tokens, CASE WHEN n % 4 = 1 THEN i - turn END AS cached_input_tokens, o AS output_tokens, i + o AS total_tokens, CASE WHEN turn % 3 = 1 THEN i END AS last_total FROM ({_LOGS})"""
FORKS = f"""SELECT * FROM ({CHECKPOINTS}) UNION ALL SELECT concat('fork-', n), n, record_index, concat('fork-', n), concat('thread-', n), turn_id, ordinal, operation, CASE WHEN n % 8 = 0 THEN 'other' ELSE model END, reasoning_effort, input_tokens, cached_input_tokens, output_tokens, total_tokens, last_total FROM ({CHECKPOINTS}) WHERE n % 4 = 0 AND n % 9 <> 0"""
for _d, _half in (("spark", "turn div 2"), ("duckdb", "turn // 2")):
    DIALECT[_d]["quarter_turn"] = _half

#: Threads as a binary tree; node 0 is the root.
TREE = "SELECT n AS src, {half} AS dst FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n > 0"
#: Aliases between nations, with one cycle and tails into it.
ALIASES = "SELECT CAST(n_nationkey AS BIGINT) AS src, CAST((n_nationkey * n_nationkey * n_nationkey + 2) % 25 AS BIGINT) AS dst FROM nation WHERE n_nationkey % 3 <> 0"
#: Revisions: a user's day is a key, and what follows supersedes what was before; some links and numbers are wrong.
REVISIONS = """SELECT concat('evt-', id) AS event_id, concat('day-', user_id, '-', d) AS source_event_id, r + CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS revision, CASE WHEN id % 89 = 0 THEN 'wrong' ELSE p END AS supersedes, event_type = 'error' AS voided,
 concat('thread-', user_id) AS thread_key, concat('turn-', user_id, '-', d) AS turn_key, CASE WHEN user_id % 6 <> 0 THEN user_id % 25 END AS project_id, user_id, total FROM (
 SELECT event_id AS id, user_id, event_type, {day} AS d, CAST(round(value * 100) AS BIGINT) AS total, CAST(row_number() OVER w AS BIGINT) AS r, lag(concat('evt-', event_id)) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id, {day} ORDER BY ts, event_id))"""
#: Evidence for parents, with ties, self-parents and a cycle.
PARENTS = """SELECT n AS child, {half} AS parent, 'sqlite_spawn' AS source FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n % 2 = 0 AND n > 0
 UNION ALL SELECT n, n - 1, 'session_source' FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n % 3 = 0 AND n > 0
 UNION ALL SELECT n, {quarter}, 'session_source' FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n % 5 = 0
 UNION ALL SELECT n, n + 2, 'fork' FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n % 7 = 0
 UNION ALL SELECT n, n, 'fork' FROM (SELECT DISTINCT conv_id AS n FROM conversations) WHERE n % 11 = 0"""
#: Remotes in several spellings from page URLs; some are local or wrong.
REMOTES = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://user:secret@', h, ':443/', p, '.git?x=1#y') WHEN 1 THEN concat('git@', upper(h), ':', p, '.git') WHEN 2 THEN concat('ssh://git@', h, ':2222//', p, '/') WHEN 3 THEN concat('git://GitHub.com/Owner/', p) WHEN 4 THEN concat('/home/', p)
 WHEN 5 THEN concat('ftp://', h, '/', p) WHEN 6 THEN concat('https://', h, '/../', p) ELSE concat('file:///', p) END AS remote, h AS host, p AS path FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/.*$', '') AS h, concat('Repo-', page_id % 13) AS p FROM pages)"""

VIEWS = {"usage": USAGE, "bench": BENCH, "checkpoints": CHECKPOINTS, "forks": FORKS, "tree": TREE, "aliases": ALIASES, "revisions": REVISIONS, "parents": PARENTS, "remotes": REMOTES}
SOURCES = {"usage": ["events"], "bench": ["lineitem"], "checkpoints": ["conversations"], "forks": ["conversations"], "tree": ["conversations"], "aliases": ["nation"], "revisions": ["events"], "parents": ["conversations"], "remotes": ["pages"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES[name]}
    text = VIEWS[name].format(**DIALECT["spark"])
    for t in frames:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **frames)


def duckdb_view(name: str) -> str:
    """The view in parentheses, to stand after FROM."""
    return "(" + VIEWS[name].format(**DIALECT["duckdb"]).replace("AS STRING)", "AS VARCHAR)") + ")"
