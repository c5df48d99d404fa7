"""Format-preserving Feistel pseudonyms of personal data.

Numbers and dates of known shapes are found by one pattern and validated: cards by Luhn's
check digit, IPv4 addresses by their octets, social security numbers by their
reserved ranges, dates by the calendar; phone numbers and e-mail addresses by shape. A valid
value is permuted within its format by a keyed Feistel network, so that equal values, also in other
punctuation, get equal pseudonyms in all documents, and unequal ones unequal ones:

    card    all digits but the last are permuted, and the check digit is computed anew
    ip      its 32 bits as 8 hexadecimal digits
    phone   the 10 digits after the country code
    ssn     9 digits, again until they are valid
    date    the days since 1900-01-01 as 5 digits, again until below the end of 2099
    email   letters and digits of the local part, of 64 characters at most; the domain stays

A round adds to each character of one half, within its class (digit, lower-case or
upper-case letter), what SHA-256 of key, kind, round and the other half says. What isn't valid stays as it is.

A walk that finds no valid value in 8,256 steps (a chance below 0.3 ** 8256) leaves the value as it is.

Edge cases: null stays null and empty stays empty; texts of any length are rewritten whole; identifiers aren't read;
repeated rows are treated each; other columns stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

ROUNDS = 10
#: Steps along a cycle in a first and, where that finds nothing valid, in a second walk; one ends with a chance of over 0.7 at each step.
WALK, FAR = 64, 8192
#: Days from 1900-01-01 to 2099-12-31.
DAYS = 73049

#: Possessive, and from the start of a run of local characters only (or where the last match ended), so that no text makes the matcher
#: recurse or read a run twice. A local part has 64 characters at most, as the standard has it.
_LABEL = r"[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{{1,64}}+@{_LABEL}(?:\.{_LABEL})++"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
ANY = "|".join((EMAIL, IP, DATE, PHONE, CARD, SSN))


def _seq(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _shift(c: Column, k: Column, hexadecimal: bool) -> Column:
    if hexadecimal:
        return F.substr(F.lit("0123456789abcdef"), ((F.instr(F.lit("0123456789abcdef"), c) - 1 + k) % 16 + 1).cast("int"), F.lit(1))
    out = F.when(c.between("0", "9"), F.char(48 + (F.ascii(c) - 48 + k) % 10))
    out = out.when(c.between("a", "z"), F.char(97 + (F.ascii(c) - 97 + k) % 26))
    return out.when(c.between("A", "Z"), F.char(65 + (F.ascii(c) - 65 + k) % 26)).otherwise(c)


def feistel(x: Column, key: str, kind: str, hexadecimal: bool = False, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings with the classes of ``x`` in its places."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        def stream(k: Column) -> Column:  # 16 bits for each character, from as many hashes as it takes
            block = F.floor((k - 1) / 16).cast("int")
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), block.cast("string"), acc.r), 256)
            return F.conv(F.substr(digest, (((k - 1) % 16) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")

        moved = F.transform(_seq(F.length(acc.l)), lambda k: _shift(F.substr(acc.l, k, F.lit(1)), stream(k), hexadecimal))
        return F.struct(acc.r.alias("l"), F.array_join(moved, "").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda acc: F.concat(acc.l, acc.r))


def _walk(x: Column, step, valid) -> Column:
    """Steps along the permutation's cycle until a valid value comes; a cycle that starts
    at a valid value returns to one, so this is a permutation of the valid ones."""
    first = F.struct(step(x).alias("v"))
    walk = lambda begin, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), begin, lambda acc, _: F.when(valid(acc.v), acc).otherwise(F.struct(step(acc.v).alias("v"))), lambda acc: acc.v)
    far = lambda v: F.when(valid(v), v).otherwise(let(walk(F.struct(v.alias("v")), FAR), lambda w: F.when(valid(w), w).otherwise(x)))
    return let(walk(first, WALK), far)


def _refill(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced, in order."""
    return let(F.struct(x.alias("x"), digits.alias("d")), lambda p: F.array_join(F.transform(
        _seq(F.length(p.x)),
        lambda i: F.when(F.substr(p.x, i, F.lit(1)).between("0", "9"), F.substr(p.d, F.length(F.regexp_replace(F.substr(p.x, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substr(p.x, i, F.lit(1))),
    ), ""))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum, the last digit single."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        v = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))

    return F.aggregate(_seq(n), F.lit(0), lambda acc, i: acc + one(i))


def _card(x: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = feistel(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        full = let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _refill(x, full)).otherwise(x)

    return let(F.regexp_replace(x, "[^0-9]", ""), made)


def _ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("int"))

    def made(os: Column) -> Column:
        word = F.array_join(F.transform(os, lambda o: F.lpad(F.lower(F.hex(o)), 2, "0")), "")
        back = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10)), ".")
        valid = F.forall(os, lambda o: o <= 255) & (F.array_join(F.transform(os, lambda o: o.cast("string")), ".") == x)
        return F.when(valid, let(feistel(word, key, "ip", True), back)).otherwise(x)

    return let(octets, made)


def _phone(x: Column, key: str) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    return let(digits, lambda d: _refill(x, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), feistel(F.substr(d, F.length(d) - 9), key, "phone"))))


def _ssn_valid(d: Column) -> Column:
    area = F.substr(d, F.lit(1), F.lit(3))
    return ~area.isin("000", "666") & ~area.startswith("9") & (F.substr(d, F.lit(4), F.lit(2)) != "00") & (F.substr(d, F.lit(6)) != "0000")


def _ssn(x: Column, key: str) -> Column:
    walked = lambda d: _refill(x, _walk(d, lambda v: feistel(v, key, "ssn"), _ssn_valid))
    return let(F.regexp_replace(x, "[^0-9]", ""), lambda d: F.when(_ssn_valid(d), walked(d)).otherwise(x))


def _date(x: Column, key: str) -> Column:
    """Formats: 2024-01-31, and 31.01.2024 or 31/01/2024 or, where only that is a date, 01/31/2024."""
    iso = x.contains("-")
    sep = F.substr(x, F.lit(3), F.lit(1))
    day_first = F.try_to_date(F.translate(x, "./", "--"), "dd-MM-yyyy")
    month_first = F.try_to_date(F.translate(x, "./", "--"), "MM-dd-yyyy")
    parsed = F.when(iso, F.try_to_date(x, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, month_first))

    def made(day: Column) -> Column:
        n = F.datediff(day, F.lit("1900-01-01").cast("date"))
        code = _walk(F.lpad(n.cast("string"), 5, "0"), lambda v: feistel(v, key, "date"), lambda v: v.cast("int") < DAYS)
        new = F.date_add(F.lit("1900-01-01").cast("date"), code.cast("int"))
        order = F.when(day_first.isNotNull(), F.date_format(new, "dd~MM~yyyy")).otherwise(F.date_format(new, "MM~dd~yyyy"))
        shaped = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(order)
        return F.when((n >= 0) & (n < DAYS), F.replace(shaped, F.lit("~"), sep)).otherwise(x)

    return F.when(parsed.isNull(), x).otherwise(let(parsed, made))


def _email(x: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    return F.concat(feistel(local, key, "email"), F.substr(x, F.length(local) + 1))


KINDS = {"email": (EMAIL, _email), "ip": (IP, _ip), "date": (DATE, _date), "phone": (PHONE, _phone), "card": (CARD, _card), "ssn": (SSN, _ssn)}


def kind_of(x: Column) -> Column:
    """The kind of a match, by its shape alone."""
    out = F.when(x.contains("@"), "email")
    out = out.when(x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}\z"), "ip").when(x.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})\z"), "date")
    return out.when(x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn").when(x.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\z"), "card").otherwise("phone")


def pseudonym(x: Column, key: str) -> Column:
    kind = kind_of(x)
    out = F.when(F.lit(False), x)
    for name, (_, made) in KINDS.items():
        out = out.when(kind == name, made(x, key))
    return out.otherwise(x)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out: str | None = None, found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in the text. ``out``: the column for the new text (default: the
    text's own). ``found``: a column for what was replaced, an array of structs ``kind, pseudonym``."""
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col).cast("string")
    values = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    made = F.transform(values, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value"), pseudonym(x, key).alias("pseudonym")))

    def rewritten(ms: Column) -> Column:
        gaps = F.transform(F.split(text, ANY, -1), lambda g, i: F.concat(g, F.coalesce(F.get(ms, i).pseudonym, F.lit(""))))
        changed = F.filter(ms, lambda m: m.value != m.pseudonym)
        return F.struct(F.when(F.size(ms) > 0, F.array_join(gaps, "")).otherwise(text).alias("text"), F.transform(changed, lambda m: F.struct(m.kind.alias("kind"), m.pseudonym.alias("pseudonym"))).alias("found"))

    whole = docs.withColumn("__pii", let(made, rewritten)).withColumn(out or text_col, F.col("__pii.text"))
    if found:
        whole = whole.withColumn(found, F.col("__pii.found"))
    return whole.drop("__pii")


#: For the query and the pipeline; in earnest the key comes from a secret store.
DEMO_KEY = "demonstration key, not a secret"


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, DEMO_KEY, found="__found")
    count = lambda k: F.size(F.filter("__found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", "text", *map(count, KINDS))
