"""Schemas of the engine's tables, and versions of the exchanged files."""

FILES = "rel string, content string"
COMMITS = "commit string, ts timestamp, file string"
CHURN = "rel string, n bigint, last_modified timestamp"
COVERAGE = "rel string, lines array<int>, stale boolean"
FINDINGS = "rel string, line int, function string, signal string, kind string, severity string, message string"
NODES = "kind string, name string, qualified_name string, file_path string, line_start int, community_id bigint"
EDGES = "kind string, source string, target string, file_path string"
GRAPH = f"contract_version bigint, nodes array<struct<{', '.join(x.replace(' ', ': ', 1) for x in NODES.split(', '))}>>, edges array<struct<{', '.join(x.replace(' ', ': ', 1) for x in EDGES.split(', '))}>>, communities map<string, string>"
BASELINE = "actions array<string>, config_ignored map<string, bigint>"
SCAN_VERSION, GRAPH_VERSION = 4, 1


def assert_version(found: int | None, wanted: int, what: str) -> None:
    if found != wanted:
        raise ValueError(f"{what}: version {found} instead of {wanted}")
