"""The Java forms against DuckDB's RE2."""

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillsift.functions.patterns import JAVA, RE2
from quillsift.functions.re2 import PatternError, to_java

TEXTS = ["", "a", "A", "é", "ſ", "K", "foo bar", "foo\nbar", "foo\n", "x_1", " \t\v", " ", "a.b", "[x]", "a&b", "]", "{2}", "aa", "aaa", "-", "^", "ab\r", "éAB1", "AB1é", "0x7f", "$", "\\"]
PATTERNS = [r"\bAB1\b", r"a$", r"(?m)^bar$", r"foo$", r"(?i)s", r"(?i)k", r"\s", r"[\s]", r"\S+", r".", r"(?s).", r"foo.bar", r"[[:alpha:]]+", r"[^[:alpha:]]", r"[a&&b]", r"[]x]", r"[^]x]", r"(?P<n>a)b?", r"a{2}", r"a{,2}", r"(?U)a+", r"a+?", r"(a|aa)$", r"\x41", r"\x{e9}", r"[\d-]", r"\pL+", r"[\W\d]", r"[^\W\d]", r"\Qa.b\E", r"(?i:A)b|é", r"\B", r"[a-]", r"[-a]", r"[\]]", r"^$", r"\Aa", r"a\z"]
REFUSED = [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(a)\1", r"a++", r"a**", r"a{1001}", r"a{3,2}", r"*a", r"{2}", r"(a", r"a)", r"[a", r"\Z", r"\k<n>", r"(?>a)", "\\", r"[[:nope:]]", r"(|*)"]


def spans(spark, pattern, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [(r[0], r[1]) for r in df.select(F.col("t").rlike(to_java(pattern)), F.regexp_extract("t", to_java(pattern), 0), "i").orderBy("i").collect()]


def duck(pattern, texts):
    con = duckdb.connect()
    return [con.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?)", [t, pattern, t, pattern]).fetchone() for t in texts]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_as_re2(spark, pattern):
    assert spans(spark, pattern, TEXTS) == duck(pattern, TEXTS)


@pytest.mark.parametrize("pattern", REFUSED)
def test_refused(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZ09_/+-.=:$<>{}()AKIeyJ \n\té  ", max_size=50).filter(lambda s: "\0" not in s), min_size=5, max_size=20))
def test_catalogue_on_random_texts(spark, texts):
    for pattern in RE2.values():
        assert spans(spark, pattern, texts) == duck(pattern, texts)


def test_catalogue_is_translated():
    assert set(JAVA) == set(RE2) and len(JAVA) == 24
