"""Schemas of the relations that all parts share."""

from __future__ import annotations

SCALARS = (
    "file string, doc_index int, resource string, kind string, field_path string, line int, column int, "
    "key_name string, nearby_keys array<string>, value string, scan_mode string"
)
FINDINGS = (
    "rule_id string, description string, severity string, confidence string, file string, line int, column int, "
    "field_path string, resource string, kind string, match string"
)
ERRORS = "file string, message string"
SUMMARY = (
    "files_scanned bigint, findings bigint, errors bigint, critical bigint, high bigint, medium bigint, low bigint, "
    "duration_ms bigint, scanner_version string"
)
FINDING_COLUMNS = [c.split()[0] for c in FINDINGS.split(", ")]
SCHEMA_VERSION = "1.0"
SCANNER_VERSION = "0.1.0"
EMPTY_SCALAR = {
    "file": "''", "doc_index": "1", "resource": "''", "kind": "''", "field_path": "''", "line": "1", "column": "1",
    "key_name": "''", "nearby_keys": "array()", "scan_mode": "'full'",
}
