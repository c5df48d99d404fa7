"""A chart of findings: a lane for each file, a mark for each finding where its line lies in the file, and the file's counts by
severity as a stacked bar. Nothing is random, so the same input gives the same bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..operators.summarise import SEVERITIES

LANE, NAME, LANE_WIDTH, BAR_WIDTH, GAP = 26, 220, 520, 180, 20


@dataclass
class Lane:
    file: str
    top: int
    marks: list[dict] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(SEVERITIES, 0))


def severity_of(finding: dict) -> str:
    said = str(finding.get("severity") or "").strip().lower()
    return said if said in SEVERITIES else SEVERITIES[-1]


def lanes(findings: Sequence[dict], files: Sequence[str]) -> list[Lane]:
    """Files in the order of their first finding, then those without one. A finding without a file has no lane."""
    named = [(number, f) for number, f in enumerate(findings, 1) if f.get("file")]
    names = dict.fromkeys([*(f["file"] for _, f in named), *filter(None, files)])
    out = {name: Lane(name, LANE * k) for k, name in enumerate(names)}
    last: dict[str, int] = {}
    for _, f in named:
        last[f["file"]] = max(last.get(f["file"], 1), f.get("line") or 1)
    for number, f in named:
        lane, severity = out[f["file"]], severity_of(f)
        lane.counts[severity] += 1
        lane.marks.append({"number": number, "severity": severity, "left": NAME + round(LANE_WIDTH * (f.get("line") or 1) / last[f["file"]], 1)})
    return list(out.values())


def bar(lane: Lane, most: int) -> list[dict]:
    """The parts of a lane's bar, the gravest first; the fullest lane's bar has the whole width."""
    parts, left = [], NAME + LANE_WIDTH + GAP
    for severity, n in lane.counts.items():
        if n:
            width = round(BAR_WIDTH * n / most, 1)
            parts.append({"severity": severity, "count": n, "left": round(left, 1), "width": width})
            left += width
    return parts


def chart(findings: Sequence[dict], files: Sequence[str]) -> dict:
    """``width``, ``height`` and ``lanes``, each with its file, place, marks and bar."""
    found = lanes(findings, files)
    most = max((len(lane.marks) for lane in found), default=0) or 1
    return {
        "width": NAME + LANE_WIDTH + 2 * GAP + BAR_WIDTH,
        "height": LANE * len(found),
        "lanes": [{"file": lane.file, "middle": lane.top + LANE // 2, "marks": lane.marks, "bar": bar(lane, most)} for lane in found],
    }
