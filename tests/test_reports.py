import copy
import json

import pytest
from pyspark.sql import functions as F

from quillsift.operators import policy, summarise, validate
from quillsift.sinks import Report, formatter, html_report, json_report, sarif_report, summary_report, text_report
from quillsift.sinks.chart import chart


def finding(**more):
    return {"rule_id": "internal.jwt-token", "description": "d", "severity": "critical", "confidence": "high", "file": "a.yaml", "line": 3, "column": 2, "field_path": "p", "resource": "", "kind": "", "match": "eyJh****x"} | more


def report(found=(), errors=()):
    levels = {s: sum(f["severity"] == s for f in found) for s in summarise.SEVERITIES}
    return Report({"files_scanned": 2, "findings": len(found), "errors": len(errors), **levels, "duration_ms": 1, "scanner_version": "0.1.0"}, list(found), list(errors))


SOME = report([finding(), finding(rule_id="corp.<b>", severity="low", file="b.yaml", resource="r", kind="Pod")], [{"file": "c.yaml", "message": "bad <x>"}])


def test_json():
    data = json.loads(json_report(SOME))
    assert data["findings"][0].keys().isdisjoint({"resource", "kind"}) and data["findings"][1]["kind"] == "Pod"
    assert "\\u003cx\\u003e" in json_report(SOME) and json.loads(json_report(report()))["findings"] == []
    assert validate.check(data)["summary"]["findings"] == 2
    with pytest.raises(ValueError):
        json_report(Report({}, schema_version="2.0"))


def test_text():
    lines = text_report(SOME).split("\n")
    assert lines[0].split() == ["SEVERITY", "CONFIDENCE", "RULE", "ID", "LOCATION", "RESOURCE", "FIELD", "PATH", "MATCH"]
    assert lines[1].startswith("CRITICAL  HIGH        internal.jwt-token  a.yaml:3:2  -") and lines[4] == "Scan summary: 2 files scanned | 2 findings detected | 1 errors"
    assert text_report(report()) == "No secrets detected across 2 scanned files.\n"


def test_sarif():
    run = json.loads(sarif_report(SOME))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["corp.<b>", "internal.jwt-token"] and [r["level"] for r in run["results"]] == ["error", "note"]
    assert run["invocations"][0]["executionSuccessful"] is False and len(run["results"][0]["partialFingerprints"]["primaryLocationLineHash"]) == 64


def test_html_is_escaped():
    page = html_report(SOME)
    assert "corp.&lt;b&gt;" in page and "<b>" not in page and "bad &lt;x&gt;" in page and page == html_report(SOME)


def test_summary():
    data = json.loads(summary_report(SOME))
    assert data["status"] == "ERROR" and data["affected_files"] == ["a.yaml", "b.yaml"] and data["rule_distribution"]["corp.<b>"]["remediation"] == summarise.OTHER_REMEDIATION


def test_formats():
    assert formatter(" JSON ") is json_report and formatter("") is text_report
    with pytest.raises(ValueError):
        formatter("pdf")


def test_chart():
    more = [*SOME.findings, finding(line=1, severity="odd"), finding(file="")]
    c = chart(more, ["a.yaml", "z.yaml"])
    assert [x["file"] for x in c["lanes"]] == ["a.yaml", "b.yaml", "z.yaml"] and chart([], [])["lanes"] == []
    assert [[m["number"] for m in x["marks"]] for x in c["lanes"]] == [[1, 3], [2], []]
    first = c["lanes"][0]
    assert [p["severity"] for p in first["bar"]] == ["critical", "low"] and first["marks"][1]["left"] < first["marks"][0]["left"] <= c["width"]
    assert chart(more, ["a.yaml", "z.yaml"]) == c and html_report(SOME) == html_report(SOME)


def broken():
    good = json.loads(json_report(report([finding()])))
    yield "V1", [1]
    yield "V1", {k: v for k, v in good.items() if k != "errors"}
    yield "V1", good | {"more": 1}
    yield "V2", good | {"schema_version": "1"}
    yield "V2", good | {"schema_version": "2.0"}
    for path, value, code in ((("summary", "high"), -1, "V3"), (("summary", "high"), True, "V3"), (("summary", "high"), 1.0, "V3"), (("summary", "scanner_version"), 1, "V3"), (("findings", 0, "severity"), "odd", "V4"), (("findings", 0, "line"), 0, "V4"), (("findings", 0, "kind"), 3, "V4"), (("findings", 0, "x"), 3, "V4"), (("errors",), {}, "V5"), (("errors",), [{"file": 1, "message": ""}], "V5"), (("summary", "findings"), 2, "V6"), (("summary", "critical"), 0, "V7")):
        x = copy.deepcopy(good)
        at = x
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        yield code, x


def test_validation(tmp_path):
    for code, x in broken():
        with pytest.raises(validate.ReportError) as e:
            validate.check(x)
        assert e.value.code == code, x
    with pytest.raises(validate.ReportError):
        validate.load_report(str(tmp_path / "none"))
    assert validate.violation(None)[0] == "V0" and validate.violation(json_report(report([finding(severity="HIGH", confidence="critical")])).replace('"high": 0', '"high": 1')) is None


def bodies(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "body string")


def review(namespace="prod", obj=None, uid="u1"):
    request = {"uid": uid, "kind": {"group": "", "version": "v1", "kind": "Pod"}, "name": "n", "namespace": namespace}
    return json.dumps({"apiVersion": "admission.k8s.io/v1", "kind": "AdmissionReview", "request": request | ({"object": obj} if obj is not None else {})})


POD = {"kind": "Pod", "metadata": {"name": "n"}, "spec": {"containers": [{"env": [{"name": "DB_PASSWORD", "value": "hunter2hunter2"}]}]}}


def answers(spark, *texts, **config):
    good, bad = policy.admit(bodies(spark, *texts), policy.PolicyConfig(**config))
    return [json.loads(r.response)["response"] for r in good.collect()], [r.reason for r in bad.collect()]


def test_admission(spark):
    (deny,), _ = answers(spark, review(obj=POD))
    assert not deny["allowed"] and deny["status"]["code"] == 403 and deny["uid"] == "u1" and deny["status"]["message"].endswith("env[0].value (resource: Pod/n)") and "hunter2" not in str(deny)
    (warn,), _ = answers(spark, review(obj=POD), mode="warn")
    assert warn["allowed"] and len(warn["warnings"]) == 1 and "status" not in warn
    for texts, config in ((review("KUBE-system", POD), {}), (review(obj=POD), {"min_severity": "critical"}), (review(), {}), (review(obj={"kind": "Pod"}), {})):
        (ok,), _ = answers(spark, texts, **config)
        assert ok["allowed"]
    assert answers(spark, "{oops", '{"kind": "x"}', "[1]", "")[1].count("invalid JSON") >= 2
    assert answers(spark, review(obj=POD), min_severity="nonsense")[0][0]["allowed"] is False


def test_admission_secret(spark):
    import base64

    key = "AKI" + "AIOSFODNN7EXAMPLE"
    secret = {"kind": "Secret", "metadata": {"name": "s"}, "data": {"a": base64.b64encode(key.encode()).decode(), "b": "%"}}
    (deny,), _ = answers(spark, review(obj=secret))
    assert not deny["allowed"] and "data.a" in deny["status"]["message"]


def test_admission_stream(spark, tmp_path):
    from quillsift.streaming.admission import read_reviews, serve

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text(review(obj=POD, uid="a") + "\n" + review(uid="b") + "\n{oops\n")
    query = serve(read_reviews(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    query.awaitTermination(120)
    got = {r.uid: json.loads(r.response)["response"]["allowed"] for r in spark.read.json(str(tmp_path / "out/responses")).collect()}
    assert got == {"a": False, "b": True} and spark.read.json(str(tmp_path / "out/rejects")).count() == 1


def test_gates(spark):
    total = spark.createDataFrame([(0, 0, 2, 1, 0)], "errors int, critical int, high int, medium int, low int")
    assert [summarise.fail_on(total, s).first().failed for s in ("none", "critical", "high", "low")] == [False, False, True, True]
    with pytest.raises(ValueError):
        summarise.fail_on(total, "odd")
    ranks = spark.createDataFrame([("Critical",), ("odd",), (None,)], "s string")
    from quillsift.functions.scalar import parse_severity, severity_rank

    assert [tuple(r) for r in ranks.select(severity_rank(F.col("s")), parse_severity(F.col("s"))).collect()][:2] == [(4, "critical"), (0, "high")]
