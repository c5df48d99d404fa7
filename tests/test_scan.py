"""Directories, manifests, rules and the command line."""

import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsift import cli
from quillsift.plans.engine import ScanOptions, scan_directory, scan_documents
from quillsift.sources.manifests import list_manifests
from quillsift.sources.rules import RulesError, parse_rules
from quillsift.sources.yamlwalk import walk

AWS_ID = "AKI" + "AIOSFODNN7EXAMPLE"
JWT = "eyJ" + "hbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
DEPLOYMENT = f"""apiVersion: apps/v1
kind: Deployment
metadata:
  name: shop
spec:
  template:
    spec:
      containers:
        - name: api
          env:
            - name: DB_PASSWORD
              value: hunter2hunter2
            - name: AWS_KEY
              value: {AWS_ID}
            - name: JWT_X
              value: {JWT}
"""
SECRET = f"""kind: Secret
metadata: {{name: s, annotations: {{token: {AWS_ID}}}}}
data:
  id: {base64.b64encode(AWS_ID.encode()).decode()}
  bin: {base64.b64encode(bytes([0, 1, 2, 255])).decode()}
  bad: "%%%"
stringData:
  id: {AWS_ID}
"""


@pytest.fixture
def tree(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a/deployment.yaml", DEPLOYMENT)
    put("b/.hidden.YML", SECRET)
    put("c/service.yaml", "kind: Service\nmetadata: {name: x}\nspec: {ports: [{port: 80}]}\n")
    put("c/broken.yaml", "kind: [x\n")
    for d in (".git", "vendor", "c/node_modules"):
        put(f"{d}/x.yaml", SECRET)
    put("c/readme.txt", SECRET)
    os.symlink(tmp_path / "a/deployment.yaml", tmp_path / "link.yaml")
    return tmp_path


def test_listing(tree):
    assert sorted(os.path.relpath(p, tree) for p, _ in list_manifests(str(tree))) == ["a/deployment.yaml", "b/.hidden.YML", "c/broken.yaml", "c/service.yaml"]
    with pytest.raises(NotADirectoryError):
        list(list_manifests(str(tree / "none")))
    assert list(list_manifests(str(tree / "vendor"))) == []


def test_directory_scan(spark, tree):
    r = scan_directory(spark, str(tree)).report()
    got = [(os.path.relpath(f["file"], tree), f["line"], f["column"], f["rule_id"].removeprefix("internal."), f["field_path"]) for f in r.findings]
    env = "spec.template.spec.containers[0].env"
    assert got == [
        ("a/deployment.yaml", 12, 22, "sensitive-env-var", f"{env}[0].value"), ("a/deployment.yaml", 14, 22, "aws-access-key-id", f"{env}[1].value"), ("a/deployment.yaml", 16, 22, "jwt-token", f"{env}[2].value"),
        ("b/.hidden.YML", 4, 7, "aws-access-key-id", "data.id"), ("b/.hidden.YML", 8, 7, "aws-access-key-id", "stringData.id"),
    ]
    assert sorted(e["message"].split(":")[0] for e in r.errors) == ["failed to decode Secret.data.bad", "invalid YAML syntax in document 1"]
    assert r.summary["files_scanned"] == 4 and r.summary["errors"] == 2 and r.exit_code() == 2
    again = scan_directory(spark, str(tree), ScanOptions(workers=3)).report()
    assert again.findings == r.findings and again.errors == r.errors


def test_size_limit(spark, tree):
    r = scan_directory(spark, str(tree / "a"), ScanOptions(max_file_size=100)).report()
    assert r.summary["files_scanned"] == 1 and r.errors[0]["message"] == f"file size ({len(DEPLOYMENT)} bytes) exceeds maximum limit of 100 bytes"


def test_documents(spark):
    df = spark.createDataFrame([("ns\\x", DEPLOYMENT + "---\n" + SECRET), ("e", ""), ("n", None)], "name string, text string")
    r = scan_documents(df, "name", "text").report()
    assert r.summary["files_scanned"] == 3 and len(r.findings) == 5 and {f["file"] for f in r.findings} == {"ns/x"}
    assert {f["kind"] for f in r.findings} == {"Deployment", "Secret"}


def paths(text):
    return [(s["field_path"], s["value"], s["scan_mode"], s["line"], s["column"]) for s in walk(text.encode()).scalars]


def test_walk_rules():
    assert paths("- a: b\n") == [] and paths("just text") == []
    assert paths("labels: {token: x}\nselector: {a: b}\nenvFrom: [{secret: y}]\nb: 1\n") == [("b", "1", "jwt_only", 4, 4)]
    assert paths("metadata: {annotations: {token: x, other: y}}\n") == [("metadata.annotations[token]", "x", "full", 1, 33)]
    assert paths("annotations: {token: x}\n")[0][0] == ".annotations[token]"
    assert paths("kind: configmap\nspec: {data: {my-key: x, plain: y}}\n")[1:] == [("data.my-key", "x", "full", 2, 23)]
    assert paths("a: &x v\nb: [*x, w]\ntoken: *x\n") == [("a", "v", "jwt_only", 1, 4), ("b[1]", "w", "jwt_only", 2, 9)]
    assert [p[0] for p in paths("env: [{name: A, value: x}, {name: B}, {name: C, valueFrom: {x: y}}, z]\n")] == ["env[0].value"]
    assert [p[:2] for p in paths("secrets: [[a], {b: c}]\n")] == [("secrets[0][0]", "a"), ("secrets[1].b", "c")]
    assert paths("key: |\n  two\n  lines\n") == [("key", "two\nlines\n", "full", 1, 6)]
    assert [p[0] for p in paths("kind: SECRET\nKind: Pod\ndata: {a: b}\n")] == ["kind", "Kind", "data.a"]
    assert [p[:3] for p in paths("kind: Secret\ndata: {a: &q x, b: *q}\nother: {token: t}\n")] == [("data.a", "x", "secret_data"), ("data.b", "q", "secret_data")]


def test_walk_errors():
    found = walk(b"a: 1\n---\nb: [1\n---\nc: 2\n")
    assert [s["field_path"] for s in found.scalars] == ["a"] and found.errors[0].startswith("invalid YAML syntax in document 2: ")
    assert walk(b"a: *nope\n").errors and not walk(b"").errors and walk(b"\xff\xfe\xfa").errors


def test_walk_is_deep():
    depth = 3000
    assert walk(("{a: " * depth + "x" + "}" * depth).encode()).scalars or walk(("{a: " * depth + "x" + "}" * depth).encode()).errors


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=200))
def test_walk_never_raises(content):
    walk(content)


RULES = """rules:
  - id: corp
    description: d
    severity: HIGH
    confidence: low
    pattern: 'corp_[0-9]{4}'
"""


def test_rules():
    (rule,) = parse_rules(RULES)
    assert (rule.id, rule.severity, rule.secret_type) == ("corp", "high", "custom-secret")
    two = RULES + RULES.split("\n", 1)[1].replace("'corp_", "'other_")
    bad = [b" \n", b"rules: [", b"rules: []", RULES.replace("id: corp", "id: ''"), RULES.replace("id: corp", "id: internal.x"), two, RULES.replace("description: d", "x: y"), RULES.replace("HIGH", "odd"), RULES.replace("confidence: low", "confidence: critical"), RULES.replace("pattern", "regex"), RULES.replace("{4}", "{4}" + "a" * 1024), two.replace("- id: corp", "- id: c2", 1).replace("other_", "corp_"), RULES.replace("corp_[0-9]{4}", "([a-z"), RULES.replace("corp_[0-9]{4}", "(?=a)b")]
    for content in bad:
        with pytest.raises(RulesError):
            parse_rules(content)
    with pytest.raises(RulesError, match="too many"):
        parse_rules("rules:\n" + "- {id: a}\n" * 501)


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    run = lambda *a: cli.main(["scan", "--dir", *a])
    assert run(str(tree / "a"), "--format", "json") == 1
    out = capsys.readouterr().out
    assert '"findings": 3' in out and "hunter2" not in out and AWS_ID not in out
    assert run(str(tree)) == 2 and run(str(tree / "a"), "--format", "pdf") == 2 and run(str(tree / "none")) == 2
    assert run(str(tree / "a"), "--entropy-allow", "([") == 2 and run(str(tree / "a"), "--fail-on", "critical") == 1
    (tree / "clean").mkdir()
    (tree / "clean/x.yaml").write_text("kind: Service\n")
    capsys.readouterr()
    assert run(str(tree / "clean")) == 0 and "No secrets detected across 1 scanned files." in capsys.readouterr().out
    report = tmp_path / "r.json"
    cli.main(["scan", "--dir", str(tree / "a"), "--format", "json"])
    report.write_text(capsys.readouterr().out)
    for kind in ("html", "json"):
        assert cli.main(["report", "-i", str(report), "-o", str(tmp_path / f"o/x.{kind}"), "-f", kind]) == 0
    assert "FAILED" in (tmp_path / "o/x.html").read_text()
    report.write_text("{}")
    assert cli.main(["report", "-i", str(report), "-o", str(tmp_path / "y"), "-f", "html"]) == 1
