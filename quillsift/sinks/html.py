"""One self-contained page: status, counts, chart, findings with advice, errors. Every value is escaped."""

from __future__ import annotations

from html import escape

from .chart import LANE_WIDTH, NAME, chart
from .report import Report, aggregate

_STYLE = """
body{font:15px/1.5 system-ui,sans-serif;margin:2rem auto;max-width:70rem;padding:0 1rem;color:#1d2733;background:#fff}
h1{font-size:1.5rem}h2{font-size:1.15rem;margin-top:2rem}table{border-collapse:collapse;width:100%}
th,td{text-align:left;padding:.35rem .6rem;border-bottom:1px solid #d8dee6;vertical-align:top;overflow-wrap:anywhere}
code{font:13px ui-monospace,monospace}.critical{color:#8f1d1d}.high{color:#a1500c}.medium{color:#7a6200}.low{color:#33566e}
.status{display:inline-block;padding:.1rem .6rem;border:2px solid;font-weight:600}svg{width:100%;height:auto}
"""


def _svg(c: dict) -> str:
    ink = {"critical": "#8f1d1d", "high": "#a1500c", "medium": "#7a6200", "low": "#33566e"}
    parts = [f'<svg viewBox="0 0 {c["width"]} {c["height"]}" role="img" aria-label="Findings by file and severity">']
    for lane in c["lanes"]:
        y = lane["middle"]
        parts.append(f'<text x="0" y="{y + 4}" font-size="11">{escape(lane["file"].rsplit("/", 1)[-1][:36])}</text><line x1="{NAME}" x2="{NAME + LANE_WIDTH}" y1="{y}" y2="{y}" stroke="#d8dee6"/>')
        for m in lane["marks"]:
            parts.append(f'<circle cx="{m["left"]}" cy="{y}" r="5" fill="{ink[m["severity"]]}"><title>{m["number"]}: {m["severity"]}</title></circle>')
        for p in lane["bar"]:
            parts.append(f'<rect x="{p["left"]}" y="{y - 7}" width="{p["width"]}" height="14" fill="{ink[p["severity"]]}"><title>{p["count"]} {p["severity"]}</title></rect>')
    return "".join(parts) + "</svg>"


def _table(heads: list[str], rows: list[list[str]]) -> str:
    head = "".join(f"<th>{escape(h)}</th>" for h in heads)
    return f"<table><thead><tr>{head}</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</tbody></table>"


def html_report(r: Report) -> str:
    a = aggregate(r)
    s, text = a["summary"], lambda x: escape(str(x if x is not None else ""))
    code = lambda x: f"<code>{text(x)}</code>"
    level = lambda x: f'<span class="{escape(x)}">{escape(x.upper())}</span>'
    out = [
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Secret scan: {a["status"]}</title><style>{_STYLE}</style></head><body>',
        f'<h1>Secret scan <span class="status">{a["status"]}</span></h1>',
        f"<p>{s['files_scanned']} files scanned, {s['findings']} findings, {s['errors']} errors; {s['duration_ms']} ms; version {text(s['scanner_version'])}.</p>",
        _table([k.upper() for k in s["severity_distribution"]], [[str(v) for v in s["severity_distribution"].values()]]),
    ]
    if a["findings"]:
        out.append("<h2>Chart</h2>" + _svg(chart(a["findings"], a["affected_files"])))
        rows = [[str(k), level(f["severity"]), code(f["rule_id"]) + "<br>" + text(f["description"]), code(f"{f['file']}:{f['line']}:{f['column']}"), text(f"{f['kind'] or 'Resource'}/{f['resource'] or 'Unnamed'}"), code(f["field_path"]), code(f["match"]), text(f["remediation"])] for k, f in enumerate(a["findings"], 1)]
        out.append("<h2>Findings</h2>" + _table(["#", "Severity", "Rule", "Location", "Resource", "Field", "Match", "Remediation"], rows))
        rules = [[code(k), level(v["severity"]), str(v["count"]), text(v["description"])] for k, v in sorted(a["rule_distribution"].items())]
        out.append("<h2>Rules</h2>" + _table(["Rule", "Severity", "Count", "Description"], rules))
    if a["errors"]:
        out.append("<h2>Errors</h2>" + _table(["File", "Message"], [[code(e["file"]), text(e["message"])] for e in a["errors"]]))
    return "\n".join(out) + "\n</body></html>\n"
