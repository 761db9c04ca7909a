"""Column names and closed schemas of the usage ledger."""

from __future__ import annotations

COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
COUNTS = "struct<" + ",".join(f"{c}:bigint" for c in COUNTERS) + ">"

# Fixed values of the ledger format.
RESOLUTIONS = ("manual", "activity_git", "self_origin", "unique_remote", "ancestor", "root", "descendant_consensus", "local_mapping", "ambiguous_remote", "ambiguous_multi_repo", "unclassified")
OPERATIONS = ("turn", "compact", "unknown")
SOURCE_KINDS = ("cli", "vscode", "exec", "appServer", "subAgent", "subAgentReview", "subAgentCompact", "subAgentThreadSpawn", "subAgentOther", "unknown")
MAPPING_KINDS = ("manual_assignment", "project_alias", "local_repo_link", "project_name", "device_name")
SUBJECT_TYPES = ("project", "thread", "turn", "local_repo", "device")

USAGE = (
    "schema_version bigint, event_type string, event_id string, source_event_id string, revision bigint, supersedes string, voided boolean, parser_version string, device_id string, key_id string, "
    "project_id string, project_resolution string, activity_repository_count bigint, thread_key string, root_thread_key string, parent_thread_key string, forked_from_thread_key string, turn_key string, "
    f"token_event_ordinal bigint, operation string, occurred_at string, model string, reasoning_effort string, source_kind string, cli_version string, cumulative {COUNTS}, delta {COUNTS}, reported_last {COUNTS}, flags array<string>"
)
MAPPING = "schema_version bigint, event_type string, event_id string, revision bigint, supersedes string, device_id string, key_id string, occurred_at string, kind string, subject_type string, subject_id string, target_project_id string, display_value string"
QUOTA = "schema_version bigint, event_type string, event_id string, device_id string, key_id string, occurred_at string, scope_key string, window_minutes bigint, used_percent double, remaining_percent double, reset_at string"


def fields(schema: str) -> list[str]:
    """Top-level names of a DDL schema, in order."""
    names, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            names.append(schema[start:i].split()[0])
            start = i + 1
    return names


#: One table for events of all three types: a field that a type lacks is null there.
EVENT_FIELDS = {"usage_checkpoint": fields(USAGE), "mapping": fields(MAPPING), "quota_snapshot": fields(QUOTA)}
EVENT = USAGE + ", kind string, subject_type string, subject_id string, target_project_id string, display_value string, scope_key string, window_minutes bigint, used_percent double, remaining_percent double, reset_at string"
