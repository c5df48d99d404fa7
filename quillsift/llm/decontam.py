"""Benchmark decontamination.

Benchmark items become word windows (n-grams) of normalised words. Their hashes form a
hash set, laid out as an array of buckets, which a scalar subquery hands to every
task; a document's windows are hashed and looked up in the row itself, hits are verified word by word, and
no document moves. The set goes out only if it has at most ``most_windows`` windows, counted first; beyond
that, hashes of windows are joined by a shuffle, and only rows that hit are verified.

Edge cases: null texts have no words; an item with fewer words than a window is one window,
one with none is never found; items with equal windows are all found; an item whose identifier
is null counts as the empty identifier; rows with equal identifiers are judged each; an empty table
on either side gives no hits; other columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, let, write_table

WINDOW = 10
MOST_WINDOWS = 500_000
_HITS = "array<struct<pos: int, len: int, items: array<string>>>"


def _starts(n: Column, length: int) -> Column:
    """Positions at which a window of this length can start, from 0."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, i: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *[F.get(words, i + k) for k in range(length)])


def _gram(words: Column, i: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, i + 1, length), " ")


def windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """``len, gram, h, items``: each distinct window and the items that have it."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), alnum_words(F.col(text_col).cast("string")).alias("words"))
    n = F.size("words")
    length = F.least(n, F.lit(window))
    grams = items.where(n > 0).select(
        "item", length.alias("len"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n - length), lambda i: _gram(F.col("words"), i, length)))).alias("gram")
    )
    return grams.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hash_of(gram: Column, length: Column, window: int) -> Column:
    """The hash of a window from its joined words, as ``_hash`` has it."""
    words = F.split(gram, " ")
    out = F.lit(None).cast("long")
    for k in range(window, 0, -1):
        out = F.when(length == k, _hash(words, F.lit(0), k)).otherwise(out)
    return out


def _bucketed(grams: DataFrame, n: int) -> tuple[Column, int]:
    """The hash set: an array with an array of windows for each bucket."""
    m = 1 << max(4, (2 * n - 1).bit_length())
    held = grams.groupBy(F.pmod("h", F.lit(m)).alias("bucket")).agg(F.collect_list(F.struct("h", "gram", "items")).alias("entries"))
    slots = held.sparkSession.range(m).join(held, F.col("id") == F.col("bucket"), "left").select("id", F.coalesce("entries", F.array().cast("array<struct<h: bigint, gram: string, items: array<string>>>")).alias("entries"))
    one = slots.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "entries"))), lambda x: x.entries).alias("slots"))
    return one.scalar(), m


def _hits(words: Column, slots: Column, m: int, lengths: list[int]) -> Column:
    """Verified hits of a row's windows, by position."""
    def of(length: int) -> Column:
        entries = lambda h: F.get(slots, F.pmod(h, F.lit(m)).cast("int"))

        def at(h: Column, i: Column) -> Column:
            return F.when(F.exists(entries(h), lambda e: e.h == h), F.struct(i.alias("i"), h.alias("h")))

        def verified(x: Column) -> Column:
            right = F.filter(entries(x.h), lambda e: (e.h == x.h) & (e.gram == _gram(words, x.i, length)))
            return F.transform(right, lambda e: F.struct(x.i.alias("pos"), F.lit(length).alias("len"), e["items"].alias("items")))

        hashes = F.transform(_starts(F.size(words), length), lambda i: _hash(words, i, length))
        return F.flatten(F.transform(F.array_compact(F.transform(hashes, at)), verified))

    return F.concat(*map(of, lengths)) if lengths else F.array().cast(_HITS)


def _report(words: Column, hits: Column) -> Column:
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(acc: Column, x: Column) -> Column:
        end = F.greatest(acc.end, x.pos + x.len)
        return F.struct((acc.n + end - F.least(end, F.greatest(acc.end, x.pos))).alias("n"), end.alias("end"))

    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(F.array_sort(F.transform(hits, lambda x: F.struct(x.pos.alias("pos"), x.len.alias("len")))), start, cover, lambda acc: acc.n).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["items"])))).alias("items"),
        hits.alias("hits"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, out: str = "contamination", most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``n_hit`` (words inside any occurrence of a
    window), ``items`` (identifiers as strings, sorted) and ``hits`` (``pos, len, items``)."""
    if not 1 <= window:
        raise ValueError("window must be positive")
    grams = windows(benchmark, item_id_col, item_text_col, window)
    grams = write_table(grams.withColumn("h", _hash_of(F.col("gram"), F.col("len"), window)), "windows")
    sizes = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most ``window`` rows
    text = F.col(text_col).cast("string")
    if sum(sizes.values()) <= most_windows:
        slots, m = _bucketed(grams, sum(sizes.values()))
        # read once, so that the optimiser puts the subquery's value in its place instead of a copy into each row
        found = let(F.col("__slots"), lambda s: let(alnum_words(text), lambda w: let(_hits(w, s, m, sorted(sizes)), lambda h: _report(w, h))))
        return docs.withColumn("__slots", slots).withColumn(out, found).drop("__slots")
    keyed = write_table(docs.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    sought = keyed.select("__row", alnum_words(text).alias("words"))
    hashes_of = lambda k: F.transform(_starts(F.size("words"), k), lambda i: F.struct(i.alias("i"), F.lit(k).alias("k"), _hash(F.col("words"), i, k).alias("h")))
    hashed = sought.select("__row", F.explode(F.flatten(F.array(*map(hashes_of, sorted(sizes))))).alias("x")).select("__row", "x.*")
    maybe = hashed.join(grams.select("h").distinct(), "h", "left_semi").groupBy("__row").agg(F.collect_list(F.struct("i", "k")).alias("xs"))
    seen = sought.join(maybe, "__row").select("__row", F.explode(F.transform("xs", lambda x: F.struct(x.i.alias("pos"), x.k.alias("len"), _gram(F.col("words"), x.i, x.k).alias("gram")))).alias("x")).select("__row", "x.*")
    hits = seen.join(grams.select("len", "gram", "items"), ["len", "gram"]).groupBy("__row").agg(F.collect_list(F.struct("pos", "len", "items")).alias("__hits"))
    joined = keyed.join(hits, "__row", "left").withColumn("__hits", F.coalesce("__hits", F.array().cast(_HITS)))
    return joined.withColumn(out, let(alnum_words(text), lambda w: _report(w, F.col("__hits")))).drop("__row", "__hits")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hit a window, with the columns that they came with."""
    marked = contamination(docs, benchmark, out="__contamination", **options)
    return marked.where("__contamination.n_hit = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", filler: str = " ", **options) -> DataFrame:
    """``docs`` with ``filler`` in place of the words that were hit and what stands between two of them."""
    marked = contamination(docs, benchmark, text_col=text_col, out="__contamination", **options)
    text, hits = F.col(text_col), F.col("__contamination.hits")
    # letters of words and gaps as they stand in the text: gap 0, word 0, gap 1, word 1, ...
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    words, gaps = F.regexp_extract_all(text, F.lit(word), F.lit(0)), F.split(text, word, -1)

    def kept(ws: Column, gs: Column) -> Column:
        hit = F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x.pos, x.pos + x.len - 1)))))
        # runs of hit words become one filler: walk the runs' borders
        runs = F.aggregate(
            hit, F.array().cast("array<struct<a: int, b: int>>"),
            lambda acc, i: F.when(F.try_element_at(acc, F.lit(-1)).b == i - 1, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1)).a.alias("a"), i.alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(i.alias("a"), i.alias("b"))))),
        )
        piece = lambda a, b: F.concat(F.array_join(F.transform(F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.get(gs, i), F.get(ws, i))), ""), F.get(gs, b))
        parts = let(runs, lambda rs: F.transform(F.sequence(F.lit(0), F.size(rs)), lambda k: piece(F.coalesce(F.get(rs, k - 1).b + 1, F.lit(0)), F.coalesce(F.get(rs, k).a, F.size(ws)))))
        return F.array_join(parts, filler)

    clean = F.when(F.col("__contamination.n_hit") > 0, let(words, lambda ws: let(gaps, lambda gs: kept(ws, gs)))).otherwise(text)
    return marked.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = lambda name: F.col(f"contamination.{name}")
    return found.select(
        "doc_id", c("n_words").alias("n_words"), c("n_hit").alias("n_hit"), F.size(c("items")).cast("long").alias("n_items"),
        F.sha2(F.array_join(c("items"), ","), 256).alias("items_sha256"), (c("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::varchar, '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT k FROM g
), s AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)
), h AS (
  SELECT s.doc_id, s.i, s.k, g.item FROM s JOIN g ON s.k = g.k AND s.gram = g.gram
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
