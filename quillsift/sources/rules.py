"""Custom rules from a YAML file, validated in a fixed order; the first failure stops the load."""

from __future__ import annotations

import yaml

from ..functions.re2 import PatternError, to_java
from ..operators.detect import MOST_RULES, Rule

MOST_BYTES = 1024
SEVERITIES, CONFIDENCES = ("critical", "high", "medium", "low"), ("high", "medium", "low")


class RulesError(ValueError):
    """The rules can't be loaded."""


def load_rules(path: str) -> list[Rule]:
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError as e:
        raise RulesError(f"failed to read rules file: {e.strerror}") from None
    return parse_rules(content)


def parse_rules(content: bytes | str) -> list[Rule]:
    if not content.strip():
        raise RulesError("rules file is empty")
    try:
        root = yaml.load(content, Loader=yaml.BaseLoader)  # every scalar as its text
    except yaml.YAMLError:
        raise RulesError("failed to parse rules file as YAML") from None
    items = root.get("rules") if isinstance(root, dict) else None
    if root is not None and not isinstance(root, dict) or items is not None and items != "" and not isinstance(items, list):
        raise RulesError("failed to parse rules file as YAML")
    if not items:
        raise RulesError("rules file has no rules")
    if len(items) > MOST_RULES:
        raise RulesError(f"too many rules ({len(items)}), the limit is {MOST_RULES}")
    ids: set[str] = set()
    patterns: set[str] = set()
    return [_rule(k, x, ids, patterns) for k, x in enumerate(items)]


def _rule(k: int, item: object, ids: set[str], patterns: set[str]) -> Rule:
    if not isinstance(item, dict) or any(not isinstance(item.get(c, ""), str) for c in ("id", "description", "severity", "confidence", "pattern", "secret_type")):
        raise RulesError("failed to parse rules file as YAML")
    get = lambda c: item.get(c, "")
    rule_id = get("id").strip()
    severity, confidence = get("severity").strip().lower(), get("confidence").strip().lower()
    pattern, description = get("pattern").strip(), get("description").strip()
    checks = [
        (not rule_id, f"rule {k} has no id"),
        (rule_id.startswith("internal."), f"rule id {rule_id!r} has the reserved prefix 'internal.'"),
        (rule_id in ids, f"rule id {rule_id!r} repeats"),
        (not description, f"rule {rule_id!r} has no description"),
        (severity not in SEVERITIES, f"rule {rule_id!r} has an invalid severity"),
        (confidence not in CONFIDENCES, f"rule {rule_id!r} has an invalid confidence"),
        (not pattern, f"rule {rule_id!r} has an empty pattern"),
        (len(pattern.encode()) > MOST_BYTES, f"rule {rule_id!r} has a pattern over {MOST_BYTES} bytes"),
        (pattern in patterns, f"rule {rule_id!r} repeats a pattern"),
    ]
    for failed, said in checks:
        if failed:
            raise RulesError(said)
    try:
        to_java(pattern)
    except PatternError as e:
        raise RulesError(f"rule {rule_id!r} has an invalid pattern: {e}") from None
    ids.add(rule_id)
    patterns.add(pattern)
    return Rule(rule_id, description, severity, confidence, pattern, get("secret_type").strip() or "custom-secret")


def rules_relation(spark, rules: list[Rule]):
    """``id, description, severity, confidence, pattern, secret_type``, with Java patterns, for the join with rules as data."""
    rows = [(r.id, r.description, r.severity, r.confidence, to_java(r.pattern), r.secret_type) for r in rules]
    return spark.createDataFrame(rows, "id string, description string, severity string, confidence string, pattern string, secret_type string")
