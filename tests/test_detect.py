import base64
import json

import pytest
from pyspark.sql import functions as F

from quillsift.functions.scalar import decode_secret, entropy, mask, trim_space
from quillsift.operators import detect

AWS_ID = "AKI" + "AIOSFODNN7EXAMPLE"
AWS_SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX" + "AMPLEKEY"
DENSE = "p@$$w0rd_!#%&()*+-./:;=?[]^{|}~XyZq"


def scalar(value, key="x", path="data.x", nearby=(), mode="full"):
    return (value, key, path, list(nearby), mode)


def scan(spark, rows, detectors=detect.ALL, resolve=True, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "file int, value string, key_name string, field_path string, nearby_keys array<string>, scan_mode string")
    scalars = detect.as_scalars(df, file=F.col("file").cast("string"), value="value", key_name="key_name", field_path="field_path", nearby_keys="nearby_keys", scan_mode="scan_mode")
    out = {}
    for r in detect.findings(scalars, detectors, resolve, **options).collect():
        out.setdefault(int(r.file), []).append(r.rule_id.removeprefix("internal."))
    return [sorted(out.get(i, [])) for i in range(len(rows))]


def test_mask_and_trim(spark):
    values = ["", "abcd", "12345678", "a" * 20, "k" * 40, "  AKIA1234567890  ", " x ", "éééééééé"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(mask(F.col("v")), trim_space(F.col("v"))).collect()
    assert [r[0] for r in rows[:6]] == ["", "*" * 8, "*" * 8, "aaaa" + "*" * 12 + "aaaa", "kkkk" + "*" * 32 + "kkkk", "AKIA" + "*" * 6 + "7890"]
    assert rows[6][1] == "x" and rows[7][0] == "éé" + "*" * 8 + "éé"


def test_entropy_values(spark):
    got = spark.createDataFrame([(AWS_SECRET,), ("",), ("aaaa",), ("é",)], "v string").select(entropy(F.col("v"))).collect()
    assert abs(got[0][0] - 4.662814895472355) < 1e-9 and got[1][0] == 0 and got[2][0] == 0 and abs(got[3][0] - 0.5) < 1e-9


def test_keys(spark):
    rows = [scalar(AWS_ID), scalar("B" + AWS_ID[1:]), scalar("é" + AWS_ID), scalar("AIz" + "a" + "b" * 35), scalar("AIz" + "a" + "b" * 36), scalar("-----BEGIN RSA PRIV" + "ATE KEY-----\nx")]
    assert scan(spark, rows, ("aws_key", "google_key", "private_key")) == [["aws-access-key-id"], [], ["aws-access-key-id"], ["google-api-key"], [], ["ssh-private-key"]]


def test_aws_secret_needs_context(spark):
    rows = [scalar(AWS_SECRET, "AWS_SECRET_ACCESS_KEY"), scalar(AWS_SECRET, "x", "data.secret_access_key"), scalar(AWS_SECRET, "x", "y", ["AWS_ACCESS_KEY_ID"]), scalar("0123456789abcdef" * 2 + "01234567", "GIT_COMMIT_SHA"), scalar(AWS_SECRET, "image"), scalar("A" * 40, "aws_key"), scalar(AWS_SECRET, "x", "y", ["OTHER"])]
    assert [bool(x) for x in scan(spark, rows, ("aws_secret",))] == [True, True, True, False, False, False, False]


def token(head, body):
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    return f"{part(head)}.{part(body)}.c2lnbmF0dXJl"


def test_jwt(spark):
    good = token({"alg": "HS256"}, {"sub": "1"})
    rows = [scalar("Bearer " + good), scalar(good, mode="jwt_only"), scalar(token({"alg": "x"}, b"not json")), scalar(token({"alg": "x"}, [1])), scalar(AWS_ID, mode="jwt_only"), scalar(token({"a": 1}, {"b": "x" * 2000}))]
    assert scan(spark, rows, ("aws_key", "jwt")) == [["jwt-token"], ["jwt-token"], [], [], [], []]


def test_json_object_is_strict():
    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    assert detect.json_object(enc('{"a":1,"a":2}')) and detect.json_object(enc(' {"a":1e5}'))
    assert not any(detect.json_object(enc(s)) for s in ('{"a":NaN}', '{"a":1e999}', '{"a":1} x', "[]", "1", ""))


SUPPRESSED = [
    "ssh-rsa AAAAB3NzaC1yc2EAAAADAQABAAABgQC7vbqajDhA8LMbbBHkzsLiOoBoDb deploy@ci", "AAAAB3NzaC1yc2EAAAADAQABAAABgQC7vbqajDhA8LMbbBHkzsLiOoBoDb",
    "-----BEGIN CERTIFICATE-----\nMIIDdzCCAl+gAwIBAgIEbGVjcnQwDQYJ9x7Kq2Zv\n-----END CERTIFICATE-----", "arn:aws:secretsmanager:eu-west-1:123456789012:secret:prod/db-AbCdEfXyZ",
    "projects/847362519204/secrets/payments-db-PassWord/versions/17", "https://sts.example.com/v1/token?audience=Projects/123XYZ&q=Kj8", "data:image/png;base64+Zx9Kq2LmNpQrStUvWyAbCdEfGhIjK",
    "$2y$10$N9qo8uLOickgx2ZMRZoMyeIjZAgcfl7p92ldGxad68LJZdL17lhWy", "$argon2id$v=19$m=65536,t=3,p=4$Zx9Kq2LmNpQrStUvWyAbCd$EfGhIjKlMnOpQrStUvWxYz0123", "{{ .Values.ZxKq2LmNpQrStUvWyAbCdEfGhIj }}", "CHANGEME-BEFORE-DEPLOY-Zx9Kq2LmNpQrStUvWyAb",
]


def test_entropy_suppressors_matter(spark):
    """Each shape is dense enough to be found without its suppressor."""
    rows = [scalar(v, "db_password") for v in SUPPRESSED]
    assert scan(spark, rows, ("entropy",), threshold=3.5) == [[]] * len(rows)
    dense = spark.createDataFrame([(v,) for v in SUPPRESSED], "v string").select(F.exists(detect.tokens(F.col("v")), lambda t: entropy(t) >= 3.5)).collect()
    assert all(r[0] for r in dense)


def test_entropy_gates(spark):
    base62 = "Zx9Kq2LmNpQrStUvWyAbCdEfGhIjK0"
    rows = [scalar(DENSE, "db_password"), scalar(DENSE, "app_name", "spec.app"), scalar("123e4567-e89b-12d3-a456-426614174000", "token"), scalar("1" * 30, "token"), scalar(base62, "password"), scalar("postgres://user:Zx9Kq2LmNpQrSt@db:5432/XyZ_Wv", "db_password"), scalar("-----BEGIN CERTIFICATE-----\nZx9Kq2LmNpQrStUvWyAbCdEfGhIjK0\n-----BEGIN PRIV" + "ATE KEY-----\n", "key")]
    assert [bool(x) for x in scan(spark, rows, ("entropy",))] == [True, False, False, False, True, True, True]
    assert scan(spark, [scalar(base62, "password")], ("entropy",), allow=("^Zx9Kq2",)) == [[]]


def test_env(spark):
    env = "spec.containers[0].env[0].value"
    values = ["hunter2", "$(DB)", "{{ .x }}", "${X}", "<replace-me>", "CHANGEME-now", "placeholder-x", "  "]
    assert [bool(x) for x in scan(spark, [scalar(v, "DATABASE_PASSWORD", env) for v in values], ("env",))] == [True] + [False] * 7
    assert scan(spark, [scalar("x", "DATABASE_PASSWORD", "data.env"), scalar("x", "HOST", env)], ("env",)) == [[], []]


def test_precedence(spark):
    env = "env[0].value"
    rows = [scalar(AWS_SECRET, "AWS_SECRET_ACCESS_KEY", env), scalar(DENSE, "DB_PASSWORD", env), scalar(f"{AWS_ID} {AWS_ID}", "x")]
    assert scan(spark, rows, threshold=4.0) == [["aws-secret-access-key"], ["sensitive-env-var"], ["aws-access-key-id"]]
    assert scan(spark, rows, resolve=False, threshold=4.0)[0] == ["aws-secret-access-key", "sensitive-env-var", "shannon-entropy"]


def test_custom_rules(spark):
    rule = detect.Rule("corp", "d", "low", "low", r"corp_tok_[0-9a-f]{16}")
    assert scan(spark, [scalar("token: corp_tok_0123456789abcdef"), scalar("corp_tok_x")], ("custom",), rules=(rule,)) == [["corp"], []]


def test_decode_secret(spark):
    values = {"aGk=": (False, "hi"), "aGk": (False, "hi"), "a Gk=": (True, None), "aGk\n=": (False, "hi"), "AAEC": (False, None), "//4=": (False, None), "a": (True, None), "": (False, "")}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(decode_secret(F.col("v")).alias("d")).collect()
    assert [(r.d.error, r.d.text) for r in rows] == list(values.values())


@pytest.mark.parametrize("secret", [AWS_ID, DENSE, AWS_SECRET])
def test_no_raw_value_leaves(spark, secret):
    rows = [scalar(secret, "AWS_SECRET_ACCESS_KEY", "env[0].value")]
    df = spark.createDataFrame([(0, *rows[0])], "file int, value string, key_name string, field_path string, nearby_keys array<string>, scan_mode string")
    scalars = detect.as_scalars(df, file=F.col("file").cast("string"), value="value", key_name="key_name", field_path="field_path")
    for r in detect.findings(scalars, threshold=3.5).collect():
        assert not any(secret[i : i + 6] in str(r.asDict()) for i in range(len(secret) - 5))
