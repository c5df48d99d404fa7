"""Report writers. A report is small: what the driver gets are findings, not scalars."""

from __future__ import annotations

from collections.abc import Callable

from .html import html_report
from .report import Report, json_report, summary_report, text_report
from .sarif import sarif_report

FORMATS: dict[str, Callable[[Report], str]] = {"text": text_report, "": text_report, "json": json_report, "sarif": sarif_report}


def formatter(name: str) -> Callable[[Report], str]:
    key = name.strip().lower()
    if key not in FORMATS:
        raise ValueError(f"unsupported output format: {name}")
    return FORMATS[key]


__all__ = ["FORMATS", "Report", "formatter", "html_report", "json_report", "sarif_report", "summary_report", "text_report"]
