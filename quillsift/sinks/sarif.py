"""SARIF 2.1.0. Rules stand in the order of their identifiers."""

from __future__ import annotations

import hashlib
import json

from ..schemas import SCANNER_VERSION
from .report import Report

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}


def _level(severity: str) -> str:
    return LEVELS.get(severity, "warning")


def _result(f: dict) -> dict:
    place = ":".join(str(f[k]) for k in ("rule_id", "file", "line", "column", "field_path"))
    region = {"startLine": max(1, f["line"]), "startColumn": max(1, f["column"])}
    return {
        "ruleId": f["rule_id"],
        "level": _level(f["severity"]),
        "message": {"text": f"Potential secret detected by rule {f['rule_id']} in field {f['field_path']}"},
        "locations": [{"physicalLocation": {"artifactLocation": {"uri": f["file"]}, "region": region}}],
        "partialFingerprints": {"primaryLocationLineHash": hashlib.sha256(place.encode()).hexdigest()},
    }


def sarif_report(r: Report) -> str:
    rules: dict[str, dict] = {}
    for f in r.findings:
        rules.setdefault(f["rule_id"], {"id": f["rule_id"], "shortDescription": {"text": f["description"]}, "defaultConfiguration": {"level": _level(f["severity"])}})
    call: dict = {"executionSuccessful": r.summary["errors"] == 0}
    if r.errors:
        call["toolExecutionNotifications"] = [{"message": {"text": f"Scan warning in {e['file']}: {e['message']}"}, "level": "warning", "descriptor": {"text": "ScanWarning"}} for e in r.errors]
    driver = {"name": "quillsift", "version": SCANNER_VERSION, "rules": [rules[k] for k in sorted(rules)]}
    doc = {"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "invocations": [call], "results": [_result(f) for f in r.findings]}]}
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
