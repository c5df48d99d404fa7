"""SimHash links, near copies and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quillsift.llm import simhash


def reference_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, prints, radius=4):
    """The smallest identifier of each row's class, by all pairs."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    v = np.array(prints, np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= radius)):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(ids))]


TEXTS = [None, "", "  ", "One", "one two", "one two three four", "ONE two Three four five", "é É x\x0by", "a b c d " * 70000, "x y z w v", "one two"]


def test_fingerprint():
    for t in TEXTS[:8] + TEXTS[9:]:
        assert simhash.fingerprint(t) == reference_print(t), t
    small = "k l m n o p q " * 200
    assert simhash.fingerprint(small) == reference_print(small) and simhash.fingerprint(TEXTS[8]) >= 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=0, max_size=600))
def test_bit_counts(hashes):
    assert simhash._bit_counts(np.array(hashes, np.uint64)).tolist() == [sum(h >> i & 1 for h in hashes) for i in range(64)]


def test_near_duplicates_odd(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "one", 0), (None, "alone on this earth today", 0), (3, "repeats", 1), (3, "repeats", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.id is None, r.id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df).collect()), key=repr)
    prints = [simhash.fingerprint(t) for _, t, _ in rows]
    want = sorted(((i is None, i, p, c) for (i, _, _), p, c in zip(rows, prints, classes([r[0] for r in rows], prints))), key=repr)
    assert got == want and simhash.near_duplicates(df.limit(0)).count() == 0


def planted_prints(n, seed):
    """Random fingerprints, chains of 1 to 6 flips, a dense ball."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << bit
        out.append(x)
    center = rng.getrandbits(64)
    return list(dict.fromkeys(out + [center ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]))


@pytest.mark.parametrize("slice_rows", [simhash.SLICE, 3000])
def test_links_are_exact(spark, slice_rows):
    prints = planted_prints(300, 7)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(0, s) for s in signed], "family long, fp long").repartition(3)
    roots = {r.node: r.root for r in simhash.components(simhash.meetings(df, slice_rows=slice_rows)).collect()}
    assert [roots.get(s, s) for s in signed] == classes(signed, prints)
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    pairs = {(r.a, r.b) for r in simhash.meetings(df, slice_rows=slice_rows, spanning=False).collect()}
    assert all(far(a, b) <= 4 for a, b in pairs) and len(pairs) <= 2081 * len(prints)
    roots = {r.node: r.root for r in simhash.components(simhash.meetings(df, spanning=False, blocks=4).select("a", "b")).collect()}
    assert [roots.get(s, s) for s in signed] == classes(signed, prints)
    # labels: no pair within one, and every class of labels that meets another is paired with some
    label = {s: s % 3 if s % 2 else None for s in signed}
    own = lambda s: label[s] if label[s] is not None else s
    named = spark.createDataFrame([(0, s, label[s]) for s in signed], "family long, fp long, label long")
    pairs = [(r.a, r.b) for r in simhash.meetings(named, slice_rows=slice_rows, spanning=False).collect()]
    assert pairs and all(far(a, b) <= 4 and own(a) != own(b) for a, b in pairs)
    by_label = [(own(a), own(b)) for a, b in pairs]
    want = [(own(a), own(b)) for a in signed for b in signed if a < b and far(a, b) <= 4 and own(a) != own(b)]
    roots = [{r.node: r.root for r in simhash.components(spark.createDataFrame(x, "a long, b long")).collect()} for x in (by_label, want)]
    assert roots[0] == roots[1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5), (2000, 1000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000, 2000: 1000}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op7_on_the_table(spark, sf):
    got = {r.doc_id: r for r in simhash.op7(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids, prints = [d.doc_id for d in docs], [simhash.fingerprint(d.text) for d in docs]
    assert [int(got[i].fingerprint, 16) for i in ids] == prints and [got[i].component_id for i in ids] == classes(ids, prints)
    assert all(simhash.fingerprint(d.text) == reference_print(d.text) for d in docs[:20])


def words(rng, n):
    return [rng.choice("lorem ipsum dolor sit amet".split()) if rng.random() < 0.3 else "".join(rng.choices("abcdefghij", k=7)) for _ in range(n)]


def test_resemblance():
    rng = random.Random(1)
    a = words(rng, 400)
    b = a[:380] + words(rng, 20)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    made = simhash.resemblance(*(simhash.sketch([x.encode() for x in w]) for w in (a, b)))
    assert abs(true - made) < 0.1 and simhash.resemblance(simhash.sketch([]), simhash.sketch([])) == 1 and simhash.resemblance(simhash.sketch([]), simhash.sketch([b"x"])) == 0


def near_corpus():
    rng = random.Random(3)
    docs = []
    for k in range(60):
        base = words(rng, 150)
        docs.append((k, " ".join(base)))
        if k % 3 == 0:
            docs.append((100 + k, " ".join(base)))
            near = list(base)
            near[75] = "changed"
            docs.append((200 + k, " ".join(near)))
    return docs


def test_deduplicate(spark):
    rows = [(i, t, "s") for i, t in near_corpus()] + [(500, None, "s"), (501, "", "s"), (502, " ", "s"), (None, "no key at all here", "s"), (None, "no key at all here", "s"), (7, "twice the same row", "s"), (7, "twice the same row", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    texts = dict(near_corpus())
    assert [i for i, _ in got if i is not None and i < 400 and texts.get(i) is not None and i != 7] == [k for k in sorted(range(60), key=lambda k: repr((k, texts[k]))) if k != 7]
    assert sum(t in (None, "", " ") for _, t in got) == 1 and sum(i is None for i, _ in got) == 1 and sum(t == "twice the same row" for _, t in got) == 1
    assert simhash.deduplicate(df.limit(0)).count() == 0


def linked(spark, texts):
    """Classes of texts by the stage, as sets of numbers."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    of_key = {r.key: r.root for r in simhash.copy_classes(df).collect()}
    out = {}
    for i, t in enumerate(texts):
        out.setdefault(of_key[__import__("hashlib").sha256(t.encode()).hexdigest()], set()).add(i)
    return sorted(map(sorted, out.values()))


def true_classes(texts, least=0.8):
    """Classes by all pairs of whole shingle sets."""
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return sorted(sorted(i for i in range(len(texts)) if root[i] == r) for r in set(root))


def test_copies_among_the_same_words(spark):
    """Texts of the same words in another order are no copies, and hide none."""
    rng = random.Random(5)
    shared = words(rng, 150)
    texts = [" ".join(rng.sample(shared, 150)) for _ in range(300)]
    for k in range(30):
        near = texts[k].split()
        near[70] = "changed"
        texts.append(" ".join(near))
    got = linked(spark, texts)
    assert got == true_classes(texts) and sum(len(c) == 2 for c in got) == 30


def test_copies_with_an_added_passage(spark):
    """A pair of 0.8 or more is found however the copy was changed."""
    rng = random.Random(6)
    texts = [" ".join(words(rng, 160)) for _ in range(60)]
    texts += [f"{t} {' '.join(words(rng, 36))}" for t in texts]
    got = linked(spark, texts)
    assert got == true_classes(texts) and sum(len(c) == 2 for c in got) == 60


def test_pairs_below_the_similarity_stay_apart(spark):
    """Pairs of 0.7 to 0.8 are no copies."""
    rng = random.Random(8)
    texts = [" ".join(words(rng, 160)) for _ in range(40)]
    for k in range(40):
        near = texts[k].split()
        near[20], near[60], near[100], near[140] = "one", "two", "three", "four"
        texts.append(" ".join(near))
    got = linked(spark, texts)
    assert got == true_classes(texts) and len(got) == 80


def test_copies_are_sought_by_simhash(spark, sf, monkeypatch):
    """The stage takes the links of fingerprints, all of them, before it seeks others."""
    rng = random.Random(9)
    texts = [" ".join(words(rng, 400)) for _ in range(30)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:5]] + [t + " end" for t in texts]
    prints = [simhash.fingerprint(t) for t in texts]
    want = classes(list(range(len(texts))), prints)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(3)
    pairs = simhash.simhash_pairs(df)
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == want and len(set(want)) < len(texts) - 5
    calls, real = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: calls.append(a) or real(*a, **k))
    docs = df.withColumnRenamed("node", "doc_id")
    kept = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, sf).collect()}
    assert len(calls) == 1 and kept == {c[0] for c in true_classes(texts)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_parity_never_exceeds_the_difference(x, y, both):
    x, y = x | both, y | both
    bits = [simhash.parity(np.array(sorted(s), np.uint64)).view(np.uint64) for s in (x, y)]
    assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= len(x ^ y) and len(bits[0]) == simhash.PARITY


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    """Texts put together from common passages share tokens, but their parity bits tell them apart before any text is read."""
    rng = random.Random(10)
    passages = [words(rng, 30) for _ in range(40)]
    texts = [" ".join(sum(rng.sample(passages, 10), [])) for _ in range(120)]
    texts += [f"{t} more" for t in texts[:10]]
    written, real = [], simhash.write_table

    def spy(df, name):
        out = real(df, name)
        written.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(simhash, "write_table", spy)
    got = linked(spark, texts)
    assert got == true_classes(texts) and sum(len(c) == 2 for c in got) == 10 and sum(written) <= 40


def test_pipeline(spark, sf):
    """Stage by stage: columns, what goes and what stays."""
    from quillsift.llm import decontam, packing, quality
    from quillsift.llm.common import write_table

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "benchmark passages", "pseudonyms", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, write_table(stage(spark, docs, sf), "stage")
        if name != "packing":
            assert docs.columns == before.columns
            sizes.append(docs.count())
    good = {r.id for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert sizes[1] == len(good) and sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]
    assert docs.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert docs.select("doc_id").distinct().count() == sizes[4] and packing.pack_documents(before).count() > 0
    assert decontam.contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contamination.n_hit > 0").count() == 0
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == sizes[4]
