"""Limits that are part of the semantics; injectable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    max_file_bytes: int = 8 << 20
    max_total_import_bytes: int = 256 << 20
    evidence_items: int = 10_000
    evidence_item_bytes: int = 64 << 10
    evidence_file_bytes: int = 4 << 20
    evidence_reserve_bytes: int = 512
    query_text_bytes: int = 10_000
    query_rows: int = 500
    query_value_bytes: int = 1 << 20
    query_response_bytes: int = 2 << 20
    query_seconds: float = 5.0
    query_recursion_levels: int = 10_000
    query_recursion_rows: int = 2_000_000
    structure_text_bytes: int = 8_000
    structure_matches: int = 500
    structure_seconds: float = 5.0
    structure_match_bytes: int = 2_000
    sync_seconds: float = 60.0
    report_failures: int = 20
    barrier_loops: int = 16
    publish_retries: int = 4
    concurrent_calls: int = 8


DEFAULT = Limits()
