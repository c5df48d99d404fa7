"""Column functions of the scanner. All are built-in expressions; lengths are in bytes where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import JAVA, SENSITIVE_KEYS

#: Unicode White_Space.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}(==)?|[A-Za-z0-9+/]{3}=?)?\z"
STRICT_BASE64 = r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"


def bind(value: Column, body) -> Column:
    """``body`` over ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_space(x: Column) -> Column:
    """By position from both ends, so that runs of blanks inside cost nothing."""
    return F.btrim(x, F.lit(BLANKS))


def matches(x: Column, name: str) -> Column:
    return x.rlike(JAVA[name])


def mask(x: Column) -> Column:
    """Trimmed; up to 8 bytes become 8 stars, else all but the first and last 4 bytes become
    stars. Where that cuts a character, its bytes are replaced by U+FFFD, as a string must be valid."""

    def masked(v: Column) -> Column:
        n, raw = F.octet_length(v), v.cast("binary")
        head, tail = F.substring(raw, 1, 4), F.substr(raw, n - 3, F.lit(4))
        text = lambda b: F.make_valid_utf8(b.cast("string"))
        return F.when(n == 0, "").when(n <= 8, "********").otherwise(F.concat(text(head), F.repeat(F.lit("*"), n - 8), text(tail)))

    return bind(trim_space(x), masked)


def tokens(x: Column) -> Column:
    """Between control characters, blanks, quotes, backticks and commas."""
    return F.array_remove(F.split(x, "[\\x00-\\x20\"'`,]"), "")


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters, by their share in the length in bytes, summed in order of first appearance."""

    def total(t: Column) -> Column:
        n = F.octet_length(t).cast("double")
        share = lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / F.length(c) / n
        return F.aggregate(F.array_distinct(F.split(t, "")), F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))

    return F.when(F.octet_length(x) == 0, 0.0).otherwise(bind(x, total))


def sensitive_key(k: Column) -> Column:
    low, out = F.lower(k), F.lit(False)
    for part in SENSITIVE_KEYS:
        out = out | low.contains(part)
    return out


def decode_secret(x: Column) -> Column:
    """A struct of ``error`` (it isn't base64, padded or not) and ``text`` (null if binary)."""
    bare = F.regexp_replace(x, "[\r\n]", "")

    def decoded(b: Column) -> Column:
        raw = F.unbase64(F.when(b.rlike(BASE64), b).otherwise(""))
        text = raw.cast("string")
        binary = F.contains(raw, F.lit(b"\0")) | ~F.is_valid_utf8(text)
        return F.struct((~b.rlike(BASE64)).alias("error"), F.when(b.rlike(BASE64) & ~binary, text).alias("text"))

    return bind(bare, decoded)


def severity_rank(s: Column) -> Column:
    low = F.lower(s)
    return F.when(low == "critical", 4).when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def parse_severity(s: Column) -> Column:
    low = F.lower(trim_space(s))
    return F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("high")


def sarif_level(s: Column) -> Column:
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").when(s == "low", "note").otherwise("warning")


def fingerprint(rule: Column, file: Column, line: Column, column: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, file, line.cast("string"), column.cast("string"), path), 256)


def location(file: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), column.cast("string"))


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
