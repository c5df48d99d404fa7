"""Command line: ``scan`` a directory, turn a scan's JSON into a ``report``, or answer admission reviews as a ``webhook``.

Exit codes of ``scan``: 2 for errors or a wrong configuration, 1 for findings, else 0. With ``--fail-on`` the code is 1 if the gate fails.
"""

from __future__ import annotations

import argparse
import os
import sys

from .functions.re2 import PatternError, to_java
from .operators.detect import DEFAULT_THRESHOLD
from .operators.policy import PolicyConfig
from .operators.summarise import SEVERITIES
from .operators.validate import ReportError, load_report
from .sinks import Report, formatter, html_report, summary_report
from .sources.manifests import MAX_FILE_SIZE
from .sources.rules import RulesError, load_rules


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillsift", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("--dir", default=".")
    scan.add_argument("--format", default="text")
    scan.add_argument("--rules")
    scan.add_argument("--workers", type=int)
    scan.add_argument("--entropy-threshold", type=float, default=DEFAULT_THRESHOLD)
    scan.add_argument("--entropy-allow", action="append", default=[])
    scan.add_argument("--max-file-size", type=int, default=MAX_FILE_SIZE)
    scan.add_argument("--fail-on", choices=[*SEVERITIES, "none"])
    scan.add_argument("--verbose", action="store_true")
    report = sub.add_parser("report")
    report.add_argument("--input", "-i", required=True)
    report.add_argument("--output", "-o", required=True)
    report.add_argument("--format", "-f", choices=["html", "json"], required=True)
    hook = sub.add_parser("webhook")
    hook.add_argument("--port", type=int, default=8443)
    hook.add_argument("--tls-cert")
    hook.add_argument("--tls-key")
    hook.add_argument("--mode", default="enforce")
    hook.add_argument("--min-severity", default="high")
    hook.add_argument("--ignore-namespaces", default=",".join(PolicyConfig.ignore_namespaces))
    hook.add_argument("--rules")
    return top


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillsift").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _webhook(args: argparse.Namespace) -> int:
    try:
        rules = tuple(load_rules(args.rules)) if args.rules else ()
    except RulesError as e:
        print(f"Configuration error: {e}", file=sys.stderr)
        return 2
    from .streaming.endpoint import Judge, server

    config = PolicyConfig(args.mode, args.min_severity, tuple(args.ignore_namespaces.split(",")))
    http = server(Judge(_session(), config, rules=rules), args.port, args.tls_cert, args.tls_key)
    try:
        http.serve_forever()
    except KeyboardInterrupt:
        http.server_close()
    return 0


def _scan(args: argparse.Namespace) -> int:
    try:
        write = formatter(args.format)
        for p in args.entropy_allow:
            to_java(p)
        rules = tuple(load_rules(args.rules)) if args.rules else ()
    except (ValueError, PatternError, RulesError) as e:
        print(f"Configuration error: {e}", file=sys.stderr)
        return 2
    if "://" not in args.dir and not os.path.isdir(args.dir):
        print(f"Fatal scan error: target is not a directory: {args.dir}", file=sys.stderr)
        return 2
    from .plans.engine import ScanOptions, scan_directory

    options = ScanOptions(rules, args.entropy_threshold, tuple(args.entropy_allow), args.max_file_size, args.workers)
    if args.verbose:
        print(f"Scanning {args.dir} with {len(rules)} custom rules, entropy threshold {args.entropy_threshold}", file=sys.stderr)
    scan = scan_directory(_session(), args.dir, options)
    report = scan.report()
    scan.close()
    if args.verbose:
        print(f"{report.summary['files_scanned']} files in {report.summary['duration_ms']} ms", file=sys.stderr)
    for e in report.errors:
        print(f"Warning in {e['file']}: {e['message']}", file=sys.stderr)
    sys.stdout.write(write(report))
    if args.fail_on:
        levels = SEVERITIES[: SEVERITIES.index(args.fail_on) + 1] if args.fail_on != "none" else ()
        return int(report.summary["errors"] > 0 or any(report.summary[s] for s in levels))
    return report.exit_code()


def _report(args: argparse.Namespace) -> int:
    try:
        data = load_report(args.input)
        report = Report(data["summary"], data["findings"], data["errors"])
        if folder := os.path.dirname(args.output):
            os.makedirs(folder, exist_ok=True)
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(html_report(report) if args.format == "html" else summary_report(report))
        return 0
    except (ReportError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    return {"scan": _scan, "report": _report, "webhook": _webhook}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
