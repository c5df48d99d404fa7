"""License scans by a positional index of rare tokens.

Templates are short licence notices. The index maps each of their words to its postings
(template, position). A word's weight is its inverse document frequency over the whole corpus. Of each
template, as many of the places with the highest weight are looked up as can't all be wrong in a match; such a posting and a place in the file
give a template and the place where it would start, and the starts that postings agree on are verified: the share of the template's
words that stand at their relative positions must reach ``least``, and each mandatory phrase must stand in the span.
Base labels come from fixed phrases, found at all places.

Edge cases: null and empty texts have no words, no labels and score 0; a notice cut at the text's start or end can match
by the words that are there; ties in weight go by the word; repeated rows are judged each; texts are read
whole; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, let

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, notice, mandatory phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute it and or modify it", "gnu general public license"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: A file is looked up if it has one of these; each mandatory phrase list has one of them.
KEYS = ("license", "permission", "cc", "creative", "redistribution", "unencumbered", "fee")
LEAST = 0.8
#: No notice has as many words.
LONGEST = 4096


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def weights(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each licence word over all of ``docs``. The
    driver gets a count for each word of the templates, whatever the corpus."""
    words = vocabulary(templates)
    own = F.array_intersect(F.array(*map(F.lit, words)), alnum_words(F.col(text_col).cast("string")))
    seen = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in seen.collect()}  # at most the vocabulary and the total
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}


def _places(words: Column, phrase: str) -> Column:
    ws = phrase.split()
    hit = lambda w, i: F.when((w == ws[0]) & (F.array_join(F.slice(words, i + 1, len(ws)), " ") == phrase), i)
    return F.array_compact(F.transform(words, hit))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def base(words: Column) -> Column:
    """``n_base, first_word, last_word, labels`` by the fixed phrases."""
    hits = []
    for phrase, label in PHRASES.items():
        found = F.when(F.array_contains(words, phrase.split()[0]), _places(words, phrase)).otherwise(_empty("int"))
        hits.append(_labelled(found, label))
    return let(F.concat(*hits), lambda h: F.struct(
        F.size(h).cast("long").alias("n_base"), F.array_min(F.transform(h, lambda x: x.at)).cast("long").alias("first_word"),
        F.array_max(F.transform(h, lambda x: x.at)).cast("long").alias("last_word"), F.array_sort(F.array_distinct(F.transform(h, lambda x: x.label))).alias("labels"),
    ))


def _labelled(found: Column, label: str) -> Column:
    return F.transform(found, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def matches(words: Column, weight: dict[str, float], templates=TEMPLATES, least: float = LEAST) -> Column:
    """Array of structs ``label, start, score`` of the templates that stand in a file."""
    if any(len(notice.split()) >= LONGEST or "|" in label for label, notice, _ in templates):
        raise ValueError(f"a notice has fewer than {LONGEST} words and a label no bar")
    ranked = sorted(weight, key=lambda w: (-weight[w], w))
    postings: dict[str, list] = {}
    for t, (_, notice, _) in enumerate(templates):
        # of its rarest places a match has one right at least, whatever else stands in the file
        ws = notice.split()
        places = sorted(range(len(ws)), key=lambda p: (ranked.index(ws[p]), p))
        for p in places[: len(ws) - math.ceil(least * len(ws) - 1e-9) + 1]:
            postings.setdefault(ws[p], []).append((t, p))
    post = {w: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in ps]) for w, ps in postings.items()}
    index = F.array(*[F.struct(F.lit(w).alias("w"), post[w].alias("post")) for w in ranked if w in post])

    words_of = lambda xs: F.array(*map(F.lit, xs))
    notices = F.array(*[F.struct(F.lit(label).alias("label"), words_of(notice.split()).alias("words"), words_of(phrases).alias("phrases")) for label, notice, phrases in templates])

    def verified(c: Column) -> Column:
        def judged(t: Column) -> Column:
            n = F.size(t.words)
            right = F.size(F.array_compact(F.transform(t.words, lambda w, p: F.when(F.get(words, c.at + p) == w, 1))))
            start = F.greatest(c.at, F.lit(0))
            span = F.concat(F.lit(" "), F.array_join(F.slice(words, start + 1, F.greatest(c.at + n - start, F.lit(0))), " "), F.lit(" "))
            whole = F.forall(t.phrases, lambda x: span.contains(F.concat(F.lit(" "), x, F.lit(" "))))
            return F.when((right >= least * n) & whole, F.concat_ws("|", t.label, start.cast("string"), (right / n).cast("string")))

        return let(F.get(notices, c.t), judged)

    def looked_up(own: Column) -> Column:
        at = F.array_compact(F.transform(words, lambda w, i: F.when(F.exists(own, lambda x: x.w == w), F.struct(w.alias("w"), i.alias("i")))))
        # a template and a start as one number, a match as one string: arrays of those are made distinct by hashing
        coded = lambda x, q: q.t * F.lit(1 << 33).cast("long") + (x.i - q.p + LONGEST)
        starts = F.flatten(F.transform(at, lambda x: F.flatten(F.transform(F.filter(own, lambda o: o.w == x.w), lambda o: F.transform(o.post, lambda q: coded(x, q))))))
        opened = lambda c: F.struct(F.shiftright(c, 33).cast("int").alias("t"), (F.pmod(c, F.lit(1 << 33).cast("long")) - LONGEST).cast("int").alias("at"))
        found = F.array_compact(F.transform(F.array_distinct(starts), lambda c: let(opened(c), verified)))
        return F.transform(F.array_distinct(found), lambda x: let(F.split(x, r"\|"), lambda p: F.struct(F.get(p, 0).alias("label"), F.get(p, 1).cast("int").alias("start"), F.get(p, 2).cast("double").alias("score"))))

    found = let(F.filter(index, lambda x: F.array_contains(words, x.w)), looked_up)
    gate = F.arrays_overlap(words, F.array(*map(F.lit, KEYS)))
    return F.when(gate, found).otherwise(_empty("struct<label: string, start: int, score: double>"))


def scan(docs: DataFrame, text_col: str = "text", out: str = "license", **options) -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words``, ``base`` (see ``base``), ``matches`` (see
    ``matches``), ``labels`` (of both, distinct and sorted) and ``score`` (the best match's)."""
    weight = weights(docs, text_col, options.get("templates", TEMPLATES))

    def whole(w: Column) -> Column:
        return let(F.struct(base(w).alias("b"), matches(w, weight, **options).alias("m")), lambda x: F.struct(
            F.size(w).cast("long").alias("n_words"), x.b.alias("base"), x.m.alias("matches"),
            F.array_sort(F.array_union(x.b.labels, F.transform(x.m, lambda m: m.label))).alias("labels"),
            F.coalesce(F.array_max(F.transform(x.m, lambda m: m.score)), F.lit(0.0)).alias("score"),
        ))

    return docs.withColumn(out, let(alnum_words(F.col(text_col).cast("string")), whole))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = lambda name: F.col(f"license.{name}")
    return scan(docs).select(
        "doc_id", c("n_words").alias("n_words"), *[c(f"base.{x}").alias(x) for x in ("n_base", "first_word", "last_word")],
        F.array_join(c("base.labels"), ",").alias("base_labels"), F.array_join(c("labels"), ",").alias("labels"), c("score").alias("score"),
    )


def _sql() -> str:
    """Every template at every place of the files that have a key word."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    hits = []
    for label, notice, phrases in TEMPLATES:
        ws = notice.split()
        right = " + ".join(f"(CASE WHEN s + {p} >= 1 AND w[greatest(s + {p}, 1)] = {text(x)} THEN 1 ELSE 0 END)" for p, x in enumerate(ws))
        whole = " AND ".join(f"contains(' ' || array_to_string(w[greatest(s, 1) : s + {len(ws) - 1}], ' ') || ' ', {text(f' {x} ')})" for x in phrases)
        hits.append(f"SELECT rid, {text(label)} AS label, ({right}) / {len(ws)}.0::DOUBLE AS score FROM (SELECT rid, w, unnest(range({2 - len(ws)}, len(w) + 1)) AS s FROM gated) WHERE ({right}) >= {LEAST} * {len(ws)} AND {whole}")
    places = " UNION ALL ".join(f"SELECT rid, i, {text(label)} AS label FROM p WHERE array_to_string(w[i : i + {len(x.split()) - 1}], ' ') = {text(x)}" for x, label in PHRASES.items())
    keys = " OR ".join(f"list_contains(w, {text(k)})" for k in KEYS)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), gated AS (SELECT * FROM d WHERE {keys}
), p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM gated
), places AS ({places}
), b AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM places GROUP BY rid
), hits AS ({' UNION ALL '.join(hits)}
), names AS (SELECT DISTINCT rid, label, base FROM (SELECT rid, label, true AS base FROM places UNION ALL SELECT rid, label, false FROM hits)
), l AS (SELECT rid, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM names GROUP BY rid
), best AS (SELECT rid, max(score) AS score FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid) LEFT JOIN best USING (rid)
"""


OP6_SQL = _sql()
