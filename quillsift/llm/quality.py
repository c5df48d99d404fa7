"""Quality rules with risk-controlled thresholds.

Each rule is a share in hundredths of a text's characters or words (symbols, repeated lines, repeated
five-word windows, capitals); it rejects a text whose share is over a cutoff. Cutoffs come from labelled
documents: for each stratum (a column, here the language) and rule, candidates are tested from the most
lenient on; a candidate holds if the exact binomial tail P(X <= k), with n good
documents, k of them rejected and a rejection rate of ``alpha / rules``, is at most ``delta / (strata * rules)``.
That order needs no correction within a rule, and Bonferroni's covers strata and rules, so
with probability 1 - delta every stratum loses at most ``alpha`` of its good documents. Among the
cutoffs that hold, the one with the most bad documents less ``cost`` times the good ones rejected is taken.
A stratum with too few labels gets no cutoff, and its documents pass.

Edge cases: null and empty texts have no words and fail the base rules; a null stratum is one of its own;
labels that repeat a document count once, as the worst; labels that are null or fit no document don't count; rows with
equal identifiers are judged each; without labels only the base rules hold; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, space_words, write_table

LEVELS = 50
ALPHA, DELTA, COST = 0.02, 0.05, 10
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
MOST_STRATA = 10_000


def _repeat_words(w: Column, size: int = 5) -> Column:
    """Words in windows that stand in the text twice or more. Hashes tell whether there are
    any; where there are, the windows themselves are sorted and compared."""
    n = F.size(w)
    starts = F.sequence(F.lit(0), n - size)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    def places(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a.g == b.g, F.lit(False))
        return F.array_compact(F.transform(s, lambda e, k: F.when(same(e, F.get(s, k - 1)) | same(e, F.get(s, k + 1)), e.i)))

    grams = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, size), " ").alias("g"), i.alias("i"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, i: Column) -> Column:
        return F.struct((acc.n + i + size - F.greatest(acc.end, i)).alias("n"), (i + size).alias("end"))

    covered = F.aggregate(F.array_sort(let(grams, places)), zero, cover, lambda acc: acc.n)
    repeated = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n >= size, F.when(repeated, covered).otherwise(0)).otherwise(0)


def features(text: Column) -> Column:
    """A struct of whole-text counts, all long."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    blank = F.lit(" \t\n\x0b\x0c\r")
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, blank) != "")
    counts = lambda w, ls: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(ls).cast("long").alias("n_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace(whole, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    return let(space_words(whole), lambda w: let(lines, lambda ls: counts(w, ls)))


def base_failed(f: Column) -> Column:
    return (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)


def share(f: Column, rule: str) -> Column:
    """The smallest cutoff, in 1 / LEVELS, that lets the text pass."""
    part, whole = (f[c] for c in RULES[rule])
    return F.when(whole > 0, F.floor((LEVELS * part + whole - 1) / F.when(whole > 0, whole))).otherwise(0).cast("int")


def lgamma(x: Column) -> Column:
    """By Stirling's series at x + 8, for x of 1 or more."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    down = F.lit(0.0)
    for k in range(8):
        down = down + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - down


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) of n draws with this rate, for k <= rate * n: terms fall from k down, and
    those that can't count in double precision are left out; 1 for larger k."""
    import math

    odds = (1 - rate) / rate
    top = F.exp(lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * math.log(rate) + (n - k) * math.log1p(-rate))
    many = F.least(k, F.ceil(F.sqrt(n * rate * 1600)) + 60).cast("int")
    step = lambda acc, j: F.struct(
        (acc.t * (k - j) * odds / (n - k + j + 1)).alias("t"), (acc.s + acc.t * (k - j) * odds / (n - k + j + 1)).alias("s")
    )
    terms = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda acc: acc.s)
    return F.when(k <= rate * n, F.least(F.lit(1.0), top * total)).otherwise(1.0)


def thresholds(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST, label_id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """``stratum`` and a cutoff for each rule (null: none) from ``rows`` (``id, stratum, f``) and
    ``labels`` (1 good, 0 bad). One row for each stratum with a cutoff."""
    marks = labels.where(F.col(quality_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).cast("long").alias("id")).agg(F.min(quality_col).alias("q"))
    scores = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), share(F.col("f"), r).alias("s")) for r in RULES])).alias("x")
    sides = rows.join(marks, "id").select("stratum", "q", scores).select("stratum", "x.*", "q")
    counted = sides.groupBy("stratum", "rule", "s").agg(F.count_if(F.col("q") == 1).alias("good"), F.count_if(F.col("q") == 0).alias("bad"))
    counted = write_table(counted, "shares")  # strata * rules * levels at most
    strata = counted.agg(F.countDistinct("stratum")).first()[0]
    totals = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n"))
    levels = totals.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    over = levels.join(counted, ["stratum", "rule"]).groupBy("stratum", "rule", "n", "cut").agg(
        F.sum(F.when(F.col("s") > F.col("cut"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("s") > F.col("cut"), F.col("bad")).otherwise(0)).alias("caught"),
    )
    rate, level = alpha / len(RULES), delta / (max(1, strata) * len(RULES))
    tested = over.withColumn("p", binomial_tail(F.col("n").cast("double"), F.col("k").cast("double"), rate))
    lenient = Window.partitionBy("stratum", "rule").orderBy(F.desc("cut"))
    held = tested.withColumn("worst", F.max("p").over(lenient)).where(F.col("worst") <= level).withColumn("gain", F.col("caught") - cost * F.col("k"))
    best = held.where("gain > 0").groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cut")).alias("b"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cut"))).alias(r) for r in RULES])


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``rows`` (with ``stratum`` and ``f``) and ``kept``."""
    cutoffs = write_table(cutoffs.withColumnRenamed("stratum", "__stratum"), "cutoffs")
    if cutoffs.count() <= MOST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    joined = rows.join(cutoffs.select("__stratum", F.struct(*RULES).alias("__cut")), F.col("stratum") == F.col("__stratum"), "left")
    f, bad = F.col("f"), F.lit(False)
    for r in RULES:
        bad = bad | F.coalesce(share(f, r) > F.col(f"__cut.{r}"), F.lit(False))
    return joined.withColumn("kept", ~base_failed(f) & ~bad).drop("__stratum", "__cut")


def measured_columns(id_col: str, text_col: str, stratum_col: str) -> list[Column]:
    """``id, stratum, f``."""
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("id"), stratum.alias("stratum"), features(F.col(f"`{text_col}`")).alias("f")]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    return docs.select(*measured_columns(id_col, text_col, stratum_col))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """``id, stratum, f`` (counts) and ``kept`` of each row."""
    rows = write_table(measured(docs, id_col, text_col, stratum_col), "counts")
    return judged(rows, thresholds(rows, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns that they came with. Counts are made once and written beside
    their rows, so that labels are joined to identifiers and counts alone and no text is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = write_table(docs.select(row.alias("row"), *measured_columns(id_col, text_col, stratum_col)), "counted")
    cutoffs = thresholds(rows.select("id", "stratum", "f"), labels, **options)
    return judged(rows.select("row", "stratum", "f"), cutoffs).where("kept").select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    counts = [F.col(f"f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select(F.col("id").alias("doc_id"), *counts, base_failed(F.col("f")).alias("base_failed"), "kept")


_SHARES = ", ".join(f"{{'rule': '{r}', 'part': {a}, 'whole': {b}}}" for r, (a, b) in RULES.items())
_RATE = ALPHA / len(RULES)
OP2_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS ls
  FROM documents
), g AS (
  SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
), f AS (
  SELECT rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals
  FROM d LEFT JOIN rep USING (rid)
), m AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), x AS (
  SELECT rid, doc_id, stratum, unnest([{_SHARES}], recursive := true) FROM f
), s AS (
  SELECT rid, doc_id, stratum, rule, CASE WHEN whole > 0 THEN ({LEVELS} * part + whole - 1) // whole ELSE 0 END AS s FROM x
), c AS (
  SELECT stratum, rule, s, count(*) FILTER (q = 1) AS good, count(*) FILTER (q = 0) AS bad FROM s JOIN m USING (doc_id) GROUP BY ALL
), lv AS (
  SELECT stratum, rule, n, unnest(range(0, {LEVELS})) AS cut FROM (SELECT stratum, rule, sum(good) AS n FROM c GROUP BY ALL)
), o AS (
  SELECT stratum, rule, n, cut, sum(CASE WHEN s > cut THEN good ELSE 0 END) AS k, sum(CASE WHEN s > cut THEN bad ELSE 0 END) AS caught FROM lv JOIN c USING (stratum, rule) GROUP BY ALL
), p AS (
  SELECT *, CASE WHEN k > {_RATE} * n THEN 1 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_RATE}) + (n - j) * ln(1 - {_RATE})))) END AS p FROM o
), held AS (
  SELECT *, caught - {COST} * k AS gain FROM p
  QUALIFY max(p) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) <= {DELTA} / (greatest(1, (SELECT count(DISTINCT stratum) FROM c)) * {len(RULES)}) AND caught - {COST} * k > 0
), best AS (
  SELECT stratum, rule, cut FROM held QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, cut DESC) = 1
), bad AS (
  SELECT DISTINCT rid FROM s JOIN best USING (stratum, rule) WHERE s > cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.rid IS NULL AS kept
FROM f LEFT JOIN bad USING (rid)
"""
