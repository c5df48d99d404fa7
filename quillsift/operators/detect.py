"""Detectors: each turns a scalar and its context into an array of matches, as built-in expressions.

All matches of a scalar stand in one array in the scalar's own row, so precedence and duplicates are
settled there, without a shuffle, and the raw value is masked in the projection that finds it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import JAVA, SSH_BASE64
from ..functions.re2 import to_java
from ..functions.scalar import STRICT_BASE64, bind, entropy, mask, matches, tokens, trim_space
from ..schemas import FINDING_COLUMNS

MATCH = "struct<seq: int, rule_id: string, description: string, severity: string, confidence: string, value: string>"
ENTROPY, ENV = "internal.shannon-entropy", "internal.sensitive-env-var"
DEFAULT_THRESHOLD = 4.5
MOST_RULES = 500


@dataclass(frozen=True)
class Rule:
    """A custom rule; ``pattern`` is in RE2's dialect."""

    id: str
    description: str
    severity: str
    confidence: str
    pattern: str
    secret_type: str = "custom-secret"


#: Id, description, severity, confidence of the built-in rules.
BUILT_IN = {
    "aws_key": ("internal.aws-access-key-id", "AWS Access Key ID exposed", "critical", "high"),
    "aws_secret": ("internal.aws-secret-access-key", "AWS Secret Access Key exposed in sensitive context", "critical", "high"),
    "google_key": ("internal.google-api-key", "Google API Key exposed", "critical", "high"),
    "private_key": ("internal.ssh-private-key", "Private Key block exposed", "critical", "high"),
    "jwt": ("internal.jwt-token", "JSON Web Token (JWT) exposed", "critical", "high"),
    "entropy": (ENTROPY, "High-entropy string detected in sensitive context", "medium", "medium"),
    "env": (ENV, "Hardcoded sensitive credential in environment variable", "high", "high"),
}
#: In the order in which they run.
ALL = ("aws_key", "aws_secret", "google_key", "private_key", "custom", "jwt", "entropy", "env")


@dataclass(frozen=True)
class Context:
    """The columns that describe a scalar."""

    value: Column
    key_name: Column
    field_path: Column
    nearby_keys: Column

    @classmethod
    def columns(cls) -> Context:
        return cls(*map(F.col, ("value", "key_name", "field_path", "nearby_keys")))


def _none() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def _found(values: Column, seq: int, rule: tuple[str, str, str, str]) -> Column:
    parts = zip(("rule_id", "description", "severity", "confidence"), rule)
    return F.transform(values, lambda v: F.struct(F.lit(seq).alias("seq"), *[F.lit(x).alias(n) for n, x in parts], v.alias("value")))


def _any_key(c: Context, name: str) -> Column:
    return matches(c.key_name, name) | matches(c.field_path, name) | F.coalesce(F.exists(c.nearby_keys, lambda k: matches(k, name)), F.lit(False))


def aws_context(c: Context) -> Column:
    near = F.exists(c.nearby_keys, lambda k: F.upper(k).isin("AWS_ACCESS_KEY_ID", "AWS_ACCESS_KEY"))
    return _any_key(c, "AWS_CONTEXT") | F.coalesce(near, F.lit(False))


def _all(c: Context, name: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c.value, F.lit(JAVA[name]), F.lit(group))


def aws_key(c: Context) -> Column:
    return F.when(c.value.contains("AKIA"), _all(c, "AWS_KEY_ID")).otherwise(F.array().cast("array<string>"))


def aws_secret(c: Context) -> Column:
    varied = F.filter(_all(c, "AWS_SECRET"), lambda v: F.size(F.array_distinct(F.split(v, ""))) > 8)
    return F.when(aws_context(c), varied).otherwise(F.array().cast("array<string>"))


def google_key(c: Context) -> Column:
    return F.when(c.value.contains("AIza"), _all(c, "GOOGLE_KEY")).otherwise(F.array().cast("array<string>"))


def private_key(c: Context) -> Column:
    """The first header only."""
    return F.array_remove(F.array(F.regexp_extract(c.value, JAVA["PRIVATE_KEY"], 0)), "")


def jwt_candidates(c: Context) -> Column:
    def shaped(t: Column) -> Column:
        parts = F.split(t, r"\.")
        size = lambda i: F.octet_length(F.get(parts, F.lit(i)))
        return (F.octet_length(t) <= 4096) & (size(0) <= 1024) & (size(1) <= 2048)

    return F.when(c.value.contains("eyJ"), F.filter(_all(c, "JWT"), shaped)).otherwise(F.array().cast("array<string>"))


def json_object(segment: str) -> bool:
    """The segment is base64url of a JSON object; numbers beyond a double, NaN and Infinity don't count as JSON."""
    import base64
    import json

    def finite(text: str) -> float:
        x = float(text)
        if x in (float("inf"), float("-inf")):
            raise ValueError(text)
        return x

    def refused(text: str) -> None:
        raise ValueError(text)

    if len(segment) % 4 == 1:
        return False
    try:
        text = base64.urlsafe_b64decode(segment + "=" * (-len(segment) % 4)).decode("utf-8", "replace").strip(" \t\r\n")
        return text[:1] == "{" and isinstance(json.loads(text, parse_constant=refused, parse_float=finite), dict)
    except (ValueError, RecursionError):
        return False


def _jwt_filter():
    @F.pandas_udf("array<string>")
    def valid(candidates: pd.Series) -> pd.Series:
        keep = lambda t: all(map(json_object, t.split(".")[:2]))
        return candidates.map(lambda ts: [t for t in ts if keep(t)] if ts is not None else [])

    return valid


def jwt(c: Context) -> Column:
    """The one detector that needs Python: strict JSON. The rows that hold no candidate pass an empty array."""
    return _jwt_filter()(jwt_candidates(c))


def template_expression(x: Column) -> Column:
    """Of a trimmed value."""
    around = lambda a, b: x.startswith(a) & x.endswith(b)
    return around("{{", "}}") | around("${", "}") | around("$(", ")") | (around("<", ">") & ~x.contains(" "))


def public_material(trimmed: Column) -> Column:
    return matches(trimmed, "SSH_PUBLIC") | (matches(trimmed, "PEM_PUBLIC") & ~matches(trimmed, "PEM_PRIVATE"))


def value_suppressed(value: Column) -> Column:
    """Values that are no credential as a whole."""
    whole = lambda t: public_material(t) | template_expression(t) | matches(t, "CRYPT_HASH") | matches(t, "DATA_URI")
    return bind(trim_space(value), whole)


def base64_public(t: Column, ascii_only: bool = False) -> Column:
    """The aligned head of the token, 64 characters at most, decodes to public key material: valid UTF-8, or ASCII only."""

    def decoded(head: Column) -> Column:
        text = F.unbase64(F.when(head.rlike(STRICT_BASE64), head).otherwise("")).cast("string")
        valid = F.is_valid_utf8(text)
        if ascii_only:
            valid = valid & (F.length(text) == F.octet_length(text))
        return valid & (matches(text, "PEM_PUBLIC") | matches(text, "SSH_PUBLIC"))

    n = F.octet_length(t)
    size = F.least(F.lit(64), n - n % 4)
    return F.when(size >= 40, bind(F.substr(t, F.lit(1), size), decoded)).otherwise(F.lit(False))


def token_suppressors(t: Column, ascii_only: bool = False) -> dict[str, Column]:
    """What is known not to be a credential, by name, in the order of the checks. ``ascii_only``: as in ``base64_public``."""
    ssh = F.lit(False)
    for prefix in SSH_BASE64:
        ssh = ssh | t.startswith(prefix)
    return {
        "number": matches(t, "NUMBER"),
        "uuid": matches(t, "UUID"),
        "hex_digest": matches(t, "HEX_DIGEST"),
        "image": matches(t, "IMAGE"),
        "dns_name": matches(t, "DNS_NAME") & ~t.contains("_"),
        "ssh_base64": ssh,
        "base64_public": base64_public(t, ascii_only),
        "reference": matches(t, "REFERENCE"),
        "url": matches(t, "URL") & ~matches(t, "URL_USER"),
        "crypt_hash": matches(t, "CRYPT_HASH"),
        "data_uri": matches(t, "DATA_URI"),
        "template": matches(t, "TEMPLATE"),
        "placeholder": matches(t, "PLACEHOLDER"),
    }


def entropy_tokens(c: Context, threshold: float = DEFAULT_THRESHOLD, allow: Iterable[str] = ()) -> Column:
    """Dense tokens of a value in a sensitive context. Cheap checks come first; the sum comes last."""
    threshold = threshold if threshold > 0 else DEFAULT_THRESHOLD
    allowed = [to_java(p) for p in allow if p.strip()]

    def dense(t: Column) -> Column:
        out = F.octet_length(t) >= 16
        for known in token_suppressors(t).values():
            out = out & ~known
        for pattern in allowed:
            out = out & ~t.rlike(pattern)
        return out & (entropy(t) >= threshold)

    gate = _any_key(c, "CONTEXT") & ~value_suppressed(c.value)
    return F.when(gate, F.filter(tokens(c.value), dense)).otherwise(F.array().cast("array<string>"))


def env_literal(c: Context) -> Column:
    field = c.field_path.contains(".env[") | c.field_path.startswith("env[")

    def literal(t: Column) -> Column:
        return (t != "") & ~matches(t, "VARIABLE") & ~template_expression(t) & ~matches(t, "PLACEHOLDER") & matches(c.key_name, "ENV_NAME")

    none = F.array().cast("array<string>")
    return F.when(field, bind(trim_space(c.value), lambda t: F.when(literal(t), F.array(t)).otherwise(none))).otherwise(none)


def custom(c: Context, rules: Iterable[Rule], seq: int) -> list[Column]:
    """Patterns are literals of the plan, so that each is compiled once."""
    return [_found(F.regexp_extract_all(c.value, F.lit(to_java(r.pattern)), F.lit(0)), seq, (r.id, r.description, r.severity, r.confidence)) for r in rules]


def match_array(
    c: Context, detectors: Iterable[str] = ALL, rules: Iterable[Rule] = (), threshold: float = DEFAULT_THRESHOLD, allow: Iterable[str] = (), jwt_values: Column | None = None
) -> Column:
    """All matches of a scalar in the order of the detectors, then of their places.
    ``jwt_values``: a column that already holds the JWTs, as a Python function can't stand inside a condition."""
    made = {"aws_key": aws_key, "aws_secret": aws_secret, "google_key": google_key, "private_key": private_key, "env": env_literal}
    parts = []
    for seq, name in enumerate(ALL):
        if name not in detectors:
            continue
        if name == "custom":
            parts += custom(c, rules, seq)
        elif name == "jwt":
            parts.append(_found(jwt_values if jwt_values is not None else jwt(c), seq, BUILT_IN[name]))
        elif name == "entropy":
            parts.append(_found(entropy_tokens(c, threshold, allow), seq, BUILT_IN[name]))
        else:
            parts.append(_found(made[name](c), seq, BUILT_IN[name]))
    return F.concat(*parts) if parts else _none()


def resolved(found: Column) -> Column:
    """Precedence within a scalar: a specific rule removes the environment and the entropy rule, the environment rule
    removes the entropy rule; of each rule the first match stays."""

    def kept(ms: Column) -> Column:
        specific = F.exists(ms, lambda m: ~m.rule_id.isin(ENTROPY, ENV))
        env = F.exists(ms, lambda m: m.rule_id == ENV)
        strong = F.filter(ms, lambda m: ~((m.rule_id.isin(ENTROPY, ENV) & specific) | ((m.rule_id == ENTROPY) & env)))
        first = lambda ks: F.filter(ks, lambda m, i: ~F.exists(F.slice(ks, 1, i), lambda o: o.rule_id == m.rule_id))
        return F.when(F.size(ms) < 2, ms).otherwise(bind(strong, first))

    return bind(found, kept)


def all_matches(scalars: DataFrame, detectors: Iterable[str] = ALL, **options) -> DataFrame:
    """``scalars`` with ``matches``, an array of raw matches; not to be written anywhere."""
    c, detectors = Context.columns(), tuple(detectors)
    if "jwt" in detectors:
        scalars = scalars.withColumn("__jwts", jwt(c))
        only_jwt = _found(F.col("__jwts"), ALL.index("jwt"), BUILT_IN["jwt"])
        full = match_array(c, detectors, jwt_values=F.col("__jwts"), **options)
    else:
        only_jwt, full = _none(), match_array(c, detectors, **options)
    return scalars.withColumn("matches", F.when(F.col("scan_mode") == "jwt_only", only_jwt).otherwise(full)).drop("__jwts")


def masked(matched: DataFrame) -> DataFrame:
    """A row for each match, masked in the projection that reads it."""
    # not ``explode``: the optimiser would push a filter on the array's size below it and compute all matches for that once more
    rows = matched.select("file", "line", "column", "field_path", "resource", "kind", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    of = {n: F.col(f"m.{n}") for n in ("rule_id", "description", "severity", "confidence")} | {"match": mask(F.col("m.value"))}
    return rows.select(*[of[c].alias(c) if c in of else c for c in FINDING_COLUMNS])


def findings(scalars: DataFrame, detectors: Iterable[str] = ALL, resolve: bool = True, **options) -> DataFrame:
    """The findings relation of a scalars relation. Needs no shuffle: a location is one scalar."""
    found = all_matches(scalars, detectors, **options)
    return masked(found.withColumn("matches", resolved(F.col("matches"))) if resolve else found)


def as_scalars(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Any table as a scalars relation: ``columns`` names or computes its columns; the rest are empty."""
    from ..schemas import EMPTY_SCALAR, SCALARS

    made = []
    for part in SCALARS.split(", "):
        name, kind = part.split(" ", 1)
        c = columns.get(name)
        made.append((F.col(c) if isinstance(c, str) else c if c is not None else F.expr(EMPTY_SCALAR.get(name, "''"))).cast(kind).alias(name))
    return df.select(*made)


def cross_rules(scalars: DataFrame, rules: DataFrame) -> DataFrame:
    """Custom rules as a relation (with Java patterns), for rule sets that are data: ``MOST_RULES`` at most. They become literals of
    the plan, so that each is compiled once and the scalars are read once."""
    known = rules.limit(MOST_RULES + 1).collect()
    if len(known) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    value = F.col("value")
    parts = [_found(F.regexp_extract_all(value, F.lit(r["pattern"]), F.lit(0)), ALL.index("custom"), (r["id"], r["description"], r["severity"], r["confidence"])) for r in known]
    return masked(scalars.withColumn("matches", resolved(F.concat(*parts) if parts else _none())))
