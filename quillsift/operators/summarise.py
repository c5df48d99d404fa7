"""Counts, groups, status and gates over findings and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fingerprint, sarif_level, severity_rank
from ..schemas import SCANNER_VERSION

SEVERITIES = ("critical", "high", "medium", "low")
ORDER = ("file", "line", "column", "rule_id", "field_path")

#: Advice by rule, and for all others.
REMEDIATION = {
    "internal.aws-access-key-id": "Rotate the exposed AWS Access Key ID and migrate authentication to IAM Roles for Service Accounts (IRSA) or AWS Secrets Manager.",
    "internal.aws-secret-access-key": "Revoke the exposed AWS Secret Access Key immediately and inject credentials via External Secrets Operator or Kubernetes Secrets.",
    "internal.google-api-key": "Restrict Google API Key scopes in GCP IAM and mount the key securely via Secret or Workload Identity Federation.",
    "internal.ssh-private-key": "Revoke and regenerate the compromised private key immediately; manage SSH credentials with cert-manager or Vault.",
    "internal.jwt-token": "Invalidate the active token session and avoid hardcoding long-lived authorization tokens directly in manifest files.",
    "internal.sensitive-env-var": "Refactor hardcoded container environment variables to reference Kubernetes Secrets using secretKeyRef or valueFrom.",
    "internal.shannon-entropy": "Inspect the high-entropy string. If it represents a secret or API token, migrate it into a managed secret store.",
}
OTHER_REMEDIATION = "Remove the hardcoded secret and migrate to a secure secrets manager (External Secrets, HashiCorp Vault, or SealedSecrets)."


def _order() -> Column:
    return F.struct(*ORDER)


def summary(found: DataFrame, errors: DataFrame, files_scanned: Column | DataFrame | int, duration_ms: int = 0) -> DataFrame:
    """One row. ``files_scanned``: a number, or a relation with a row for each file."""
    counts = found.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    failed = errors.agg(F.count("*").alias("errors"))
    files = files_scanned.agg(F.count("*").alias("files_scanned")) if isinstance(files_scanned, DataFrame) else found.sparkSession.range(1).select(F.lit(files_scanned).cast("long").alias("files_scanned"))
    # three relations of one row each
    joined = files.crossJoin(counts).crossJoin(failed)
    return joined.select("files_scanned", "findings", "errors", *SEVERITIES, F.lit(duration_ms).cast("long").alias("duration_ms"), F.lit(SCANNER_VERSION).alias("scanner_version"))


def rule_distribution(found: DataFrame) -> DataFrame:
    """Count by rule; severity and description are those of the last finding in order."""
    groups = found.groupBy("rule_id").agg(F.count("*").alias("count"), F.max_by("severity", _order()).alias("severity"), F.max_by("description", _order()).alias("description"))
    return with_remediation(groups)


def with_remediation(found: DataFrame) -> DataFrame:
    """A left outer lookup in a table of seven rows, as a map literal."""
    advice = F.create_map(*[F.lit(x) for pair in REMEDIATION.items() for x in pair])
    return found.withColumn("remediation", F.coalesce(F.try_element_at(advice, F.col("rule_id")), F.lit(OTHER_REMEDIATION)))


def affected_files(found: DataFrame) -> DataFrame:
    return found.groupBy("file").agg(F.count("*").alias("findings"), F.max("line").alias("max_line"))


def resource_groups(found: DataFrame) -> DataFrame:
    some = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    return found.groupBy(F.concat(some("kind", "Resource"), F.lit("/"), some("resource", "Unnamed")).alias("resource_key")).agg(F.count("*").alias("findings"))


def status(total: DataFrame) -> DataFrame:
    said = F.when(F.col("errors") > 0, "ERROR").when(F.col("findings") > 0, "FAILED").otherwise("PASSED")
    code = F.when(F.col("errors") > 0, 2).when(F.col("findings") > 0, 1).otherwise(0)
    return total.withColumn("status", said).withColumn("exit_code", code)


def fail_on(total: DataFrame, level: str) -> DataFrame:
    """``failed``: there are errors, or findings at ``level`` or above; ``none`` looks at errors only."""
    if level not in (*SEVERITIES, "none"):
        raise ValueError(f"unknown level {level}")
    counted = F.lit(0)
    for s in SEVERITIES[: SEVERITIES.index(level) + 1] if level != "none" else ():
        counted = counted + F.col(s)
    return total.withColumn("at_or_above", counted.cast("long")).withColumn("failed", (F.col("errors") > 0) | (counted > 0))


def sarif_rules(found: DataFrame) -> DataFrame:
    """A row for each rule; its first finding gives description and level."""
    first = found.groupBy("rule_id").agg(F.min_by(F.struct("description", "severity"), _order()).alias("f"))
    return first.select("rule_id", F.col("f.description").alias("description"), sarif_level(F.col("f.severity")).alias("level"))


def sarif_results(found: DataFrame) -> DataFrame:
    said = F.concat(F.lit("Potential secret detected by rule "), F.col("rule_id"), F.lit(" in field "), F.col("field_path"))
    return found.select(
        "rule_id", sarif_level(F.col("severity")).alias("level"), said.alias("message"), F.col("file").alias("uri"),
        F.greatest(F.lit(1), "line").alias("start_line"), F.greatest(F.lit(1), "column").alias("start_column"),
        fingerprint(*map(F.col, ("rule_id", "file", "line", "column", "field_path"))).alias("fingerprint"),
    )


def min_severity(found: DataFrame, level: str) -> DataFrame:
    return found.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(level)))


def outside(found: DataFrame, errors: DataFrame, prefixes: list[str], known_errors: list[str]) -> DataFrame:
    """Findings outside the allowed path prefixes and errors outside the known files, as ``kind, file``."""
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | F.col("file").startswith(p)
    own = found.where(~allowed).select(F.lit("finding").alias("kind"), "file")
    return own.unionByName(errors.where(~F.col("file").isin(known_errors)).select(F.lit("error").alias("kind"), "file"))
