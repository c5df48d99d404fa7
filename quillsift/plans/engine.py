"""The scan as a whole: source, scalars, findings, report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators import summarise
from ..operators.detect import DEFAULT_THRESHOLD, Rule, findings
from ..operators.precedence import ordered, ordered_errors
from ..sinks.report import Report
from ..sources.manifests import MAX_FILE_SIZE, extract, from_documents, read_directory


#: Findings in a report at most.
MOST_REPORTED = 1_000_000


@dataclass(frozen=True)
class ScanOptions:
    rules: tuple[Rule, ...] = ()
    entropy_threshold: float = DEFAULT_THRESHOLD
    #: RE2 patterns of values that the entropy detector ignores.
    entropy_allow: tuple[str, ...] = ()
    max_file_size: int = MAX_FILE_SIZE
    #: Input partitions, 1 to 128; by default twice the cores.
    workers: int | None = None


@dataclass
class Scan:
    """The relations of a scan; nothing runs until they are read."""

    files: DataFrame
    findings: DataFrame
    errors: DataFrame
    began: float = field(default_factory=time.monotonic)
    walked: DataFrame | None = None

    def close(self) -> None:
        """Give the cached scalars back."""
        if self.walked is not None:
            self.walked.unpersist()

    def summary(self, duration_ms: int = 0) -> DataFrame:
        return summarise.summary(self.findings, self.errors, self.files.select("file"), duration_ms)

    def report(self, most: int = MOST_REPORTED) -> Report:
        """Read in order, a partition at a time. Counts come from what was read, so the scan runs once. A report
        is a document for people: beyond ``most`` findings this raises, and ``findings`` is to be written as a table."""
        found = []
        for r in ordered(self.findings).toLocalIterator():
            if len(found) == most:
                raise ValueError(f"more than {most} findings: write the relation instead of a report")
            found.append(r.asDict())
        errors = [r.asDict() for r in ordered_errors(self.errors).limit(most).toLocalIterator()]
        levels = {s: sum(f["severity"] == s for f in found) for s in summarise.SEVERITIES}
        total = {"files_scanned": self.files.select("file").count(), "findings": len(found), "errors": len(errors), **levels, "duration_ms": int(1000 * (time.monotonic() - self.began)), "scanner_version": summarise.SCANNER_VERSION}
        return Report(total, found, errors)


def scan_scalars(scalars: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return findings(scalars, rules=options.rules, threshold=options.entropy_threshold, allow=options.entropy_allow)


def scan_files(files: DataFrame, options: ScanOptions = ScanOptions()) -> Scan:
    scalars, errors, walked = extract(files)
    return Scan(files, scan_scalars(scalars, options), errors, walked=walked)


def scan_directory(spark: SparkSession, target: str, options: ScanOptions = ScanOptions()) -> Scan:
    return scan_files(read_directory(spark, target, options.max_file_size, options.workers), options)


def scan_documents(docs: DataFrame, name_col: str, text_col: str, options: ScanOptions = ScanOptions()) -> Scan:
    """Named YAML texts of a table."""
    return scan_files(from_documents(docs, name_col, text_col), options)
