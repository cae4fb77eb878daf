"""The tables of the evidence index and the values their columns take."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 3
HASH_ALGORITHM = "sha256-v1"

_TYPES = {"bigint": LongType(), "string": StringType(), "boolean": BooleanType()}


def _struct(columns: str) -> StructType:
    """A struct of `name type` pairs; other than fromDDL it needs no session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "files": "id bigint, path string, file_kind string, content string, content_hash string, hash_algorithm string, byte_len bigint, modified_unix_seconds bigint, language string, language_detected boolean, parser_availability string, parse_outcome string, parse_error_reason string, extraction_completeness string, last_revision_id bigint",
        "evidence": "id bigint, file_id bigint, path string, ord bigint, key string, kind string, origin string, span_availability string, start_byte bigint, end_byte bigint, start_line bigint, start_column bigint, end_line bigint, end_column bigint, payload string",
        "dependency_edges": "id bigint, from_file_id bigint, to_file_id bigint, from_path string, to_path string, raw_import_text string, resolution_kind string, confidence string, syntax_unmodeled boolean",
        "findings": "id bigint, path string, source_hash string, line_start bigint, line_end bigint, severity string, category string, title string, description string, created_at_unix bigint, evidence_revision string, status string, session_id string",
        "revisions": "id bigint, revision_id string, manifest_hash string, parser_pack_version string, created_at_unix bigint, is_current boolean",
        "project": "id bigint, project_id string, root_path string, contract_version bigint, schema_version bigint, created_at_unix bigint",
    }.items()
}

#: Columns that the index keeps for its own joins; the query verb doesn't show them.
INTERNAL = {"evidence": {"path", "ord"}, "dependency_edges": {"from_path", "to_path"}}

#: Payload structs by evidence kind, for from_json.
PAYLOADS = {
    "Structure": "kind string, name string, visibility string, decorators array<string>, signature string",
    "Import": "source string, items array<string>, alias string, is_wildcard boolean",
    "Export": "name string, kind string",
    "Comment": "text string, kind string, associated_node string",
    "Docstring": "text string, format string, associated_item string",
    "Symbol": "name string, kind string, type_annotation string, doc string",
    "Diagnostic": "message string, severity string, original_item_count bigint, kept_item_count bigint",
}
