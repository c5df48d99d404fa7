"""URL filters.

Rules come first: a rule is a host and a path prefix and fits that host and its subdomains; the
longest that fits decides. Other URLs go to the method: host labels and path segments are split at their
separators, and concatenated names are segmented by Viterbi over a unigram model; a word counts once for each host that has
it, two at least, and a run that splits into other words isn't one, so that a concatenated name with several hosts stays apart; a seed lexicon is added; multinomial naive Bayes then scores the segmented tokens. It is trained on all URLs,
with the label that seed words give: a URL of whose host labels one, or a run of their words, is a seed word is
unwanted. Add-one smoothing; a score over 0 (more likely unwanted) blocks.

All words count, however rare. Up to ``most_words`` words and tokens go to the tasks as a dictionary; beyond that, candidate substrings of
the distinct names meet the words by a shuffle and are segmented there, and of the tokens' weights the ``most_words`` most
frequent are broadcast, the others joined by a shuffle. Both ways give the same scores but for the order of their sums.

Edge cases: a null url or one without :// has an empty host and path and is allowed, as no token speaks against it; an empty host
too; without unwanted URLs, or without others, all that no rule blocks is allowed; repeated rows are judged each;
texts of any length are read whole; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, write_table

#: Verdict, host, path prefix.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Words of unwanted hosts.
SEEDS = ("casino", "poker", "bets", "bet", "jackpot", "pills", "viagra", "pharmacy", "adult", "porn", "xxx", "escort", "spam", "ads", "adserver", "malware", "phishing", "warez", "crack", "loan", "payday", "replica")
#: Words that the segmenter should know besides.
LEXICON = ("cheap", "free", "win", "farm", "track", "best", "online", "shop", "store", "news", "blog", "mail", "home", "world", "web", "the", "my", "top", "buy", "now")
#: Words that a task holds at most.
MOST_WORDS = 50_000
#: What each letter of an unknown word costs.
LETTER = 2.3
_TOKEN = re.compile(r"[a-z]+|[0-9]+")


def split_url(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none does."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(said))
    return rule, verdict


def best_split(n: int, spans: dict[int, list[tuple[int, float]]], total: int) -> list[int]:
    """Viterbi: the ends of the parts of a name of ``n`` letters at the least cost. ``spans``: for each end the known words that end
    there, as start and cost. Any other stretch is one unknown word, which is the dearer the longer it is."""
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    open_cost, open_from = math.inf, 0  # the cheapest unknown word that ends here
    for end in range(1, n + 1):
        begun = best[end - 1] + math.log(total)
        if begun < open_cost:
            open_cost, open_from = begun, end - 1
        open_cost += LETTER
        best[end], back[end] = open_cost, open_from
        for start, cost in spans.get(end, ()):
            if best[start] + cost < best[end]:
                best[end], back[end] = best[start] + cost, start
    out, end = [], n
    while end:
        out.append(end)
        end = back[end]
    return out[::-1]


def parts(name: str, ends: list[int]) -> list[str]:
    return [name[a:b] for a, b in zip([0, *ends], ends)]


class Segmenter:
    """Splits a run of letters into the words of the highest unigram probability."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) or 1
        self.cost = {w: math.log(self.total / n) for w, n in counts.items()}
        self.sizes = sorted({len(w) for w in counts}, reverse=True)
        self.known: dict[str, list[str]] = {}

    def __call__(self, name: str) -> list[str]:
        if name not in self.known:
            if len(self.known) > 50_000:
                self.known = {}
            spans: dict[int, list[tuple[int, float]]] = {}
            for start in range(len(name)):
                for n in self.sizes:
                    if (cost := self.cost.get(name[start : start + n])) is not None and start + n <= len(name):
                        spans.setdefault(start + n, []).append((start, cost))
            split = parts(name, best_split(len(name), spans, self.total))
            if len(name) > 63:
                return split
            self.known[name] = split
        return self.known[name]


def composite(n: int, spans: dict[int, list[int]]) -> bool:
    """Whether a run splits into two or more of the words whose places ``spans`` has, as starts by end."""
    reached = {0}
    for end in range(1, n + 1):
        if any(start in reached and (start, end) != (0, n) for start in spans.get(end, ())):
            reached.add(end)
    return n in reached


def simple_words(counts: dict[str, int], always: frozenset[str]) -> dict[str, int]:
    """``counts`` without the runs that split into two or more words of three letters at least; those of ``always`` stay and are parts too."""
    words = {w for w in (*counts, *always) if len(w) >= 3}
    sizes = sorted({len(w) for w in words})

    def splits(w: str) -> bool:
        spans: dict[int, list[int]] = {}
        for start in range(len(w)):
            for n in sizes:
                if start + n > len(w):
                    break
                if w[start : start + n] in words:
                    spans.setdefault(start + n, []).append(start)
        return composite(len(w), spans)

    return {w: n for w, n in counts.items() if w in always or not splits(w)}


def raw_tokens(host: str, path: str) -> tuple[list[str], list[str]]:
    """Runs of letters of the host, without its public suffix, and runs of letters and digits of the path."""
    labels = host.split(":")[0].rsplit(".", 1)[0] if "." in host else host
    return re.findall("[a-z]+", labels), _TOKEN.findall(path.lower())


def tokens(segment: Segmenter, host: str, path: str) -> list[str]:
    names, parts = raw_tokens(host, path)
    out = [f"h:{w}" for n in names for w in segment(n)]
    return out + [f"p:{w}" if w.isalpha() else f"p:#{len(w)}" for p in parts for w in (segment(p) if p.isalpha() else [p])]


def unwanted(found: list[str], seeds: frozenset[str]) -> bool:
    return any(t[2:] in seeds for t in found if t[0] == "h")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: set[tuple[str, str]] = set()
        for host, path in zip(*(c.to_pylist() for c in batch.columns)):
            names, parts = raw_tokens(host, path)
            out.update((w, host) for w in [*names, *(p for p in parts if p.isalpha())])
        words, hosts = zip(*sorted(out)) if out else ((), ())
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "host": pa.array(hosts, pa.string())})


def _seen(batches: Iterator[pa.RecordBatch], counts: dict[str, int], seeds: frozenset[str]) -> Iterator[pa.RecordBatch]:
    segment = Segmenter(counts)
    for batch in batches:
        words, bad = [], []
        for host, path in zip(*(c.to_pylist() for c in batch.columns)):
            if found := tokens(segment, host, path):
                said = unwanted(found, seeds)
                words += found
                bad += [said] * len(found)
                words.append("")  # the URL itself, for the prior
                bad.append(said)
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "bad": pa.array(bad, pa.bool_())})


def _own_tokens(batches: Iterator[pa.RecordBatch], counts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    segment = Segmenter(counts)
    for batch in batches:
        rows, out = [], []
        for row, host, path in zip(*(c.to_pylist() for c in batch.columns)):
            found = tokens(segment, host, path)
            rows += [row] * len(found)
            out += found
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "token": pa.array(out, pa.string())})


def _scored(batches: Iterator[pa.RecordBatch], counts: dict[str, int], model: dict[str, float], prior: float) -> Iterator[pa.RecordBatch]:
    segment = Segmenter(counts)
    for batch in batches:
        scores = []
        for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = tokens(segment, host, path)
            scores.append(prior + sum(map(model.__getitem__, found)) if found else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def _candidates(names: DataFrame, known: DataFrame, sizes: list[int], columns: list[str]) -> DataFrame:
    """``name, spans``: the known words at all their places in each name, with ``columns`` of ``known``."""
    inside = lambda i: F.transform(F.filter(F.array(*map(F.lit, sizes)), lambda n: i + n <= F.length("name")), lambda n: F.struct(i.alias("start"), (i + n).alias("end"), F.substr("name", i + 1, n).alias("word")))
    subs = names.select("name", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("name") - 1), inside))).alias("x")).select("name", "x.*")
    met = subs.join(known, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("end", "start", *columns))).alias("spans"))
    return names.join(met, "name", "left")


def _split_names(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, found in zip(*(c.to_pylist() for c in batch.columns)):
            spans: dict[int, list[tuple[int, float]]] = {}
            for x in found or ():
                spans.setdefault(x["end"], []).append((x["start"], math.log(total / x["n"])))
            out.append(parts(name, best_split(len(name), spans, total)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])


def _composites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, found in zip(*(c.to_pylist() for c in batch.columns)):
            spans: dict[int, list[int]] = {}
            for x in found or ():
                spans.setdefault(x["end"], []).append(x["start"])
            if composite(len(name), spans):
                out.append(name)
        yield pa.RecordBatch.from_pydict({"word": pa.array(out, pa.string())})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, kinds, names = [], [], []
        for row, host, path in zip(*(c.to_pylist() for c in batch.columns)):
            for kind, found in zip("hp", raw_tokens(host, path)):
                rows += [row] * len(found)
                kinds += [kind] * len(found)
                names += found
        yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int64()), "kind": pa.array(kinds, pa.string()), "name": pa.array(names, pa.string())})


def _sizes(words: DataFrame) -> list[int]:
    """The lengths of words: one number for each length that occurs."""
    return sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect())


def _shuffled_tokens(urls: DataFrame, words: DataFrame, always: list[str]) -> DataFrame:
    """``row, token`` of all URLs, for a vocabulary of any size."""
    spark = urls.sparkSession
    own = spark.createDataFrame([(w,) for w in always], "word string")
    long = words.select("word").unionByName(own).where(F.length("word") >= 3).distinct()
    tested = words.join(own, "word", "left_anti").select(F.col("word").alias("name"))
    mixed = _candidates(tested, long, _sizes(long), []).mapInArrow(_composites, "word string")
    simple = write_table(words.join(mixed, "word", "left_anti"), "simple-words")
    total, n = simple.agg(F.sum("n"), F.count("*")).first()
    floor = max(1, (total or 0) // max(1, n))
    held = simple.join(own.withColumn("own", F.lit(True)), "word", "full").select("word", F.when(F.col("own"), F.greatest(F.lit(floor).cast("long"), F.coalesce("n", F.lit(0)))).otherwise(F.col("n")).alias("n"))
    held = write_table(held, "known-words")
    total = held.agg(F.sum("n")).first()[0] or 1
    pieces = write_table(urls.select("row", "host", "path").mapInArrow(_pieces, "row long, kind string, name string"), "pieces")
    letters = F.col("name").rlike("^[a-z]+$")
    names = pieces.where(letters).select("name").distinct()
    split = _candidates(names, held, _sizes(held), ["n"]).mapInArrow(lambda it: _split_names(it, total), "name string, words array<string>")
    joined = pieces.join(split, "name", "left")
    some = F.coalesce("words", F.array(F.concat(F.lit("#"), F.length("name").cast("string"))))
    return write_table(joined.select("row", F.explode(some).alias("word"), "kind").select("row", F.concat_ws(":", "kind", "word").alias("token")), "url-tokens")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, seeds=SEEDS, lexicon=LEXICON, most_words: int = MOST_WORDS) -> DataFrame:
    """``id, host, path, rule, score, verdict`` of each row."""
    host, path = split_url(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    by_host = urls.select("host", "path").mapInArrow(_raw, "word string, host string").distinct()
    words = write_table(by_host.groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    always = sorted({*seeds, *lexicon})
    if words.count() <= most_words:
        # seed and lexicon words count at least as the known words do on average
        counts = simple_words({r["word"]: r["n"] for r in words.collect()}, frozenset(always))
        floor = max(1, sum(counts.values()) // max(1, len(counts)))
        counts |= {w: max(floor, counts.get(w, 0)) for w in always}
        bad_seeds = frozenset(seeds)
        seen = urls.select("host", "path").mapInArrow(lambda it: _seen(it, counts, bad_seeds), "word string, bad boolean")
        tokens_of = None
    else:
        urls = write_table(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
        tokens_of = _shuffled_tokens(urls, words, always)
        bad_rows = tokens_of.groupBy("row").agg(F.max(F.col("token").isin([f"h:{s}" for s in seeds])).alias("bad"))
        seen = tokens_of.join(bad_rows, "row").select(F.col("token").alias("word"), "bad").unionByName(bad_rows.select(F.lit("").alias("word"), "bad"))
    seen = seen.groupBy("word").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad"))
    seen = write_table(seen, "tokens")
    sums = seen.groupBy((F.col("word") == "").alias("whole")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("n"))
    classes = {r["whole"]: (r["good"], r["bad"], r["n"]) for r in sums.collect()}  # two rows
    (docs_good, docs_bad, _), (good, bad, n) = classes.get(True, (0, 0, 0)), classes.get(False, (0, 0, 0))
    learnt = bool(docs_good and docs_bad)
    prior = math.log(docs_bad / docs_good) if learnt else -1.0
    odds = F.log((F.col("bad") + 1) / (bad + n + 1)) - F.log((F.col("good") + 1) / (good + n + 1)) if learnt else F.lit(0.0)
    weights = seen.where("word <> ''").select(F.col("word").alias("token"), odds.alias("odds"), (F.col("good") + F.col("bad")).alias("n"))
    if tokens_of is None and n <= most_words:
        model = {r["token"]: r["odds"] for r in weights.collect()}
        scored = urls.mapInArrow(lambda it: _scored(it, counts, model, prior), "id long, host string, path string, score double")
    else:
        if tokens_of is None:  # few words, but many tokens of other kinds
            urls = write_table(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
            tokens_of = write_table(urls.select("row", "host", "path").mapInArrow(lambda it: _own_tokens(it, counts), "row long, token string"), "url-tokens")
        hot = write_table(weights.orderBy(F.desc("n"), "token").limit(most_words), "hot-tokens")
        marked = tokens_of.join(F.broadcast(hot.select("token", "odds")), "token", "left")
        rest = marked.where("odds IS NULL").drop("odds").join(weights.select("token", "odds").hint("merge"), "token")
        sums = marked.where("odds IS NOT NULL").select("row", "odds").unionByName(rest.select("row", "odds")).groupBy("row").agg(F.sum("odds").alias("sum"))
        scored = urls.join(sums, "row", "left").select("id", "host", "path", (F.lit(prior) + F.col("sum")).alias("score"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("id", "host", "path", rule.alias("rule"), "score", F.coalesce(verdict, method).alias("verdict"))


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")
