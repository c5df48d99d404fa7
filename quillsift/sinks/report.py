"""A collected report, and its text, JSON and summary forms."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators.summarise import OTHER_REMEDIATION, REMEDIATION, SEVERITIES
from ..schemas import SCHEMA_VERSION


@dataclass
class Report:
    """``findings`` and ``errors`` in their order; ``summary`` as the summary relation's row."""

    summary: dict
    findings: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    schema_version: str = SCHEMA_VERSION

    def exit_code(self) -> int:
        return 2 if self.summary["errors"] else 1 if self.summary["findings"] else 0


def as_dict(r: Report) -> dict:
    """Empty resources and kinds are left out."""
    found = [{k: v for k, v in f.items() if v or k not in ("resource", "kind")} for f in r.findings]
    return {"schema_version": r.schema_version, "summary": r.summary, "findings": found, "errors": r.errors}


def json_report(r: Report) -> str:
    if r.schema_version != SCHEMA_VERSION:
        raise ValueError(f"unsupported schema version {r.schema_version}")
    text = json.dumps(as_dict(r), indent=2, ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"


HEADS = ("SEVERITY", "CONFIDENCE", "RULE ID", "LOCATION", "RESOURCE", "FIELD PATH", "MATCH")


def text_report(r: Report) -> str:
    s = r.summary
    if not r.findings:
        out = f"No secrets detected across {s['files_scanned']} scanned files.\n"
        return out + (f"Encountered {s['errors']} scan errors (see stderr for details).\n" if s["errors"] else "")
    rows = [HEADS]
    for f in r.findings:
        rows.append((f["severity"].upper(), f["confidence"].upper(), f["rule_id"], f"{f['file']}:{f['line']}:{f['column']}", f.get("resource") or "-", f["field_path"] or "-", f["match"]))
    widths = [max(len(row[k]) for row in rows) + 2 for k in range(len(HEADS) - 1)]
    lines = ["".join(c.ljust(w) for c, w in zip(row, widths)) + row[-1] for row in rows]
    return "\n".join(lines) + f"\n\nScan summary: {s['files_scanned']} files scanned | {s['findings']} findings detected | {s['errors']} errors\n"


def aggregate(r: Report) -> dict:
    """The summary document: status, counts, rules, files, findings with advice, errors."""
    s = r.summary
    rules: dict[str, dict] = {}
    for f in r.findings:
        seen = rules.get(f["rule_id"], {"count": 0})
        rules[f["rule_id"]] = {"count": seen["count"] + 1, "severity": f["severity"], "description": f["description"], "remediation": advice(f["rule_id"])}
    files = sorted({f["file"] for f in r.findings})
    return {
        "schema_version": r.schema_version,
        "status": "ERROR" if s["errors"] else "FAILED" if s["findings"] else "PASSED",
        "summary": s | {"severity_distribution": {level: s[level] for level in SEVERITIES}},
        "rule_distribution": rules,
        "affected_files_count": len(files),
        "affected_files": files,
        "findings": [{k: f.get(k) for k in ("rule_id", "description", "severity", "confidence", "file", "line", "column", "field_path", "resource", "kind", "match")} | {"remediation": advice(f["rule_id"])} for f in r.findings],
        "errors": r.errors,
    }


def advice(rule_id: str) -> str:
    return REMEDIATION.get(rule_id, OTHER_REMEDIATION)


def summary_report(r: Report) -> str:
    return json.dumps(aggregate(r), indent=2)
