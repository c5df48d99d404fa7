"""Admission reviews: envelope, scan of the object, decision and response, as expressions on one row each."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import parse_severity, severity_rank
from .detect import resolved

REVIEW = (
    "apiVersion string, kind string, request struct<uid: string, kind: struct<group: string, version: string, kind: string>, "
    "resource: struct<group: string, version: string, resource: string>, subResource: string, name: string, namespace: string, operation: string, dryRun: boolean>"
)
MAX_BODY = 10 * 1024 * 1024


@dataclass(frozen=True)
class PolicyConfig:
    mode: str = "enforce"
    min_severity: str = "high"
    ignore_namespaces: tuple[str, ...] = ("kube-system", "monitoring")
    #: An extension: deny objects that can't be scanned, where the default lets them pass.
    deny_unscannable: bool = False


def severity_at_least(findings: Column, level: Column) -> Column:
    return F.filter(findings, lambda f: severity_rank(f.severity) >= severity_rank(level))


def warnings_of(findings: Column) -> Column:
    return F.transform(findings, lambda f: F.concat(F.lit("potential credential detected by rule "), f.rule_id, F.lit(" in field "), f.field_path))


def decide(requests: DataFrame, config: PolicyConfig) -> DataFrame:
    """``requests`` (``namespace, kind, name`` and ``findings``, an ordered array of structs with ``rule_id, severity, field_path``)
    with ``allowed``, ``deny_message`` and ``warnings``. Any mode but ``warn`` enforces."""
    ignored = [n.strip().lower() for n in config.ignore_namespaces]
    skip = F.coalesce((F.col("namespace") != "") & F.lower("namespace").isin(ignored), F.lit(False))
    level = parse_severity(F.lit(config.min_severity))
    active = F.when(skip, F.slice("findings", 1, 0)).otherwise(severity_at_least(F.col("findings"), level))
    counted = requests.withColumn("__active", active)
    some = F.size("__active") > 0
    enforce = F.lit(config.mode != "warn")
    first = F.get("__active", F.lit(0))
    said = F.concat(F.lit("admission denied: potential credential detected by rule "), first.rule_id, F.lit(" in field "), first.field_path, F.lit(" (resource: "), F.coalesce("kind", F.lit("")), F.lit("/"), F.coalesce("name", F.lit("")), F.lit(")"))
    return counted.withColumn("allowed", ~(some & enforce)).withColumn("deny_message", F.when(some & enforce, said)).withColumn("warnings", F.when(some, warnings_of(F.col("__active")))).drop("__active")


def reviews(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """The envelope of each request body: ``status`` 200 or 400 with ``reason``, its fields and ``object``, the raw JSON or null."""
    raw = F.col(body_col)
    parsed = bodies.withColumn("review", F.from_json(raw, REVIEW, {"mode": "PERMISSIVE"})).withColumn("__json", F.try_parse_json(raw))
    too_long = F.octet_length(raw) > MAX_BODY
    bad = F.col("__json").isNull() | F.col("review").isNull()
    reason = F.when(too_long, "request body too large").when(bad, "invalid JSON").when(F.col("review.request").isNull(), "missing request envelope")
    body = F.get_json_object(raw, "$.request.object")
    r = F.col("review.request")
    return parsed.select(
        *[F.col(f"`{c}`") for c in bodies.columns],
        F.when(reason.isNull(), 200).otherwise(400).alias("status"), reason.alias("reason"),
        F.col("review.apiVersion").alias("api_version"), F.col("review.kind").alias("review_kind"), r.uid.alias("uid"),
        F.coalesce(r.kind.kind, F.lit("")).alias("kind"), F.coalesce(r["name"], F.lit("")).alias("name"), F.coalesce(r.namespace, F.lit("")).alias("namespace"),
        F.when(reason.isNull(), body).alias("object"),
    )


def source_name(namespace: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(namespace, F.lit("")), kind, name)


def _scanned(options: dict):
    """The scalars of each request's object, in its own row."""
    from collections.abc import Iterator

    import pyarrow as pa

    from ..sources.yamlwalk import walk

    fields = [("field_path", pa.string()), ("key_name", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("scan_mode", pa.string()), ("value", pa.string()), ("doc_index", pa.int32()), ("kind", pa.string()), ("resource", pa.string())]
    kind = pa.list_(pa.struct(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, failed = [], []
            for text in batch.column("object").to_pylist():
                found = walk(text.encode()) if text else None
                rows.append(found.scalars if found else [])
                failed.append(bool(found and found.errors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind), pa.array(failed, pa.bool_())], names=[*batch.schema.names, "scalars", "scan_failed"])

    return run


_SCALARS = "array<struct<field_path: string, key_name: string, line: int, column: int, scan_mode: string, value: string, doc_index: int, kind: string, resource: string>>"


def scan_objects(found: DataFrame, **options) -> DataFrame:
    """``found`` (with ``object``) with ``findings``, in order of place, and ``scan_failed``. Stateless and without a
    shuffle, so that it runs on a stream: each scalar of the array is judged in the request's own row."""
    from ..functions.scalar import decode_secret, mask, trim_space
    from .detect import ALL, Context, match_array

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    walked = found.mapInArrow(_scanned(options), f"{schema}, scalars {_SCALARS}, scan_failed boolean")

    def opened(s: Column) -> Column:
        d = decode_secret(trim_space(s.value))
        return F.when(s.scan_mode == "secret_data", F.coalesce(d.text, F.lit(""))).otherwise(s.value)

    def judged(s: Column, i: Column) -> Column:
        c = Context(opened(s), s.key_name, s.field_path, F.array().cast("array<string>"))
        jwts = F.get(F.col("jwts"), i)
        from .detect import BUILT_IN, _found

        only = _found(jwts, ALL.index("jwt"), BUILT_IN["jwt"])
        full = match_array(c, options.get("detectors", ALL), rules=options.get("rules", ()), threshold=options.get("threshold", 4.5), allow=options.get("allow", ()), jwt_values=jwts)
        kept = resolved(F.when(s.scan_mode == "jwt_only", only).otherwise(full))
        return F.transform(kept, lambda m: F.struct(s.line.alias("line"), s.column.alias("column"), m.rule_id.alias("rule_id"), s.field_path.alias("field_path"), m.severity.alias("severity"), mask(m.value).alias("match")))

    values = F.transform("scalars", opened)
    with_jwts = walked.withColumn("jwts", _jwts_of(values))
    return with_jwts.withColumn("findings", F.array_sort(F.flatten(F.transform("scalars", judged)))).drop("scalars", "jwts")


def _jwts_of(values: Column) -> Column:
    import re

    from ..functions.patterns import JWT
    from .detect import json_object

    pattern = re.compile(JWT, re.ASCII)

    @F.pandas_udf("array<array<string>>")
    def valid(rows: pd.Series) -> pd.Series:
        def ok(t: str) -> bool:
            head, body, _ = t.split(".")
            return len(t) <= 4096 and len(head) <= 1024 and len(body) <= 2048 and json_object(head) and json_object(body)

        return rows.map(lambda vs: [[t for t in pattern.findall(v) if ok(t)] if "eyJ" in v else [] for v in vs])

    return valid(values)


def respond(decided: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``uid, response``: the review that goes back, as JSON; ``keep``: further columns to keep."""
    body = F.struct(
        F.col("api_version").alias("apiVersion"), F.col("review_kind").alias("kind"),
        F.struct("uid", "allowed", F.when(~F.col("allowed"), F.struct(F.lit(403).alias("code"), F.col("deny_message").alias("message"))).alias("status"), "warnings").alias("response"),
    )
    return decided.select(*keep, "uid", F.to_json(body).alias("response"))


def failed_response(body: str, why: str) -> tuple[int, str]:
    """Status and body for a request whose scan failed: what can be read of it is denied."""
    import json

    try:
        review = json.loads(body)
    except ValueError:
        return 400, "invalid JSON"
    request = review.get("request") if isinstance(review, dict) else None
    if not isinstance(request, dict):
        return 400, "missing request envelope"
    said = {"uid": request.get("uid"), "allowed": False, "status": {"code": 403, "message": f"admission denied: internal scanner failure: {why}"}}
    return 200, json.dumps({"apiVersion": review.get("apiVersion"), "kind": review.get("kind"), "response": said})


def admit(bodies: DataFrame, config: PolicyConfig = PolicyConfig(), body_col: str = "body", keep: tuple[str, ...] = (), **options) -> tuple[DataFrame, DataFrame]:
    """Responses to the valid reviews, and the others with their status and reason. Requests without an object are allowed."""
    read = reviews(bodies, body_col)
    scanned = scan_objects(read.where("status = 200"), **options)
    decided = decide(scanned, config)
    if config.deny_unscannable:
        failed = F.col("scan_failed")
        decided = decided.withColumn("deny_message", F.when(failed, "admission denied: the object can't be scanned").otherwise(F.col("deny_message"))).withColumn("allowed", F.col("allowed") & ~failed)
    return respond(decided, keep), read.where("status <> 200").select(*keep, body_col, "status", "reason")
