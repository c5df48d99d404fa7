"""No text stalls or breaks a task; patterns made for that match what the written ones match; detectors run once for a row."""

import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from quillsift.functions.patterns import FLAT, RE2
from quillsift.functions.scalar import trim_space
from quillsift.operators import detect
from quillsift.plans import catalogue

N = 200_000
RUNS = ["a." * (N // 2), "." * N, "/" * N, "x" + " " * N + "y", " " * N, "a" * N, "a@b" + ".c" * N, "a://" + ":" * N, "arn:aws" + "-a" * N, "a/" * N + "b", "-" * N, "aB3$" * (N // 4), "QUJD" * (N // 4) + "*"]


def test_long_values(spark):
    rows = [(i, k, t) for i, t in enumerate(RUNS) for k in ("password", "env")]
    df = spark.createDataFrame(rows, "id long, key string, text string").repartition(4)
    scalars = detect.as_scalars(df, file=F.col("id").cast("string"), key_name=F.lit("DB_PASSWORD"), field_path=F.when(F.col("key") == "env", "env[0].value").otherwise("data.password"), value="text")
    began = time.monotonic()
    assert detect.findings(scalars).count() > 0
    assert time.monotonic() - began < 60
    suppressors = df.select(*[x.alias(k) for k, x in detect.token_suppressors(F.col("text")).items()])
    assert len(suppressors.collect()) == len(rows)


def test_trim(spark):
    texts = ["", " ", "\u2003a b\u00a0\u3000", "\x85\u1680x\u200a\n", "\u200bx", "a" + " " * 50 + "b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(trim_space(F.col("t"))).collect()]
    assert got == [t.strip("\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))) for t in texts]


@pytest.mark.parametrize("name", sorted(FLAT))
def test_flat_patterns(spark, name):
    """Random strings over the characters that matter, against the written pattern in RE2."""
    rng = random.Random(7)
    heads = {"IMAGE": ["", "a/", "@sha256:" + "a" * 64], "DNS_NAME": [""], "URL_USER": ["a://", "+://", "x:"], "REFERENCE": ["arn:aws", "vault", "projects/a/secrets/", "k8s://"]}[name]
    texts = sorted({"".join(rng.choice([rng.choice(heads), rng.choice("aZ0.-_/:@ \n\u212a")]) for _ in range(rng.randrange(12))) for _ in range(6000)})
    texts += ["a/b:1", "/a:1", "a//b:c", "x y/a:1", "a@sha256:" + "f" * 64, "a@sha256:" + "f" * 63, "u://a:b@", "u://a::@", "u://:@", "arn:aws-us-gov:", "arn:aws-:", "arn:aws:"]
    want = duckdb.execute(f"SELECT list_transform($1, lambda t: regexp_matches(t, {catalogue.q(RE2[name])}))", [texts]).fetchone()[0]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(F.col("t").rlike(FLAT[name])).collect()]
    assert got == want and any(want) and not all(want)


def test_detectors_run_once(spark, sf):
    plan = catalogue.found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"(AKIA[0-9A-Z]{16})") == 1
    plan = catalogue.found(spark, sf).groupBy("rule_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(AKIA[0-9A-Z]{16})") == 1
