"""Packing, shards and flat token files against the tokenizer itself."""

import array
import io
import zlib

import pytest

from quillsift.llm import packing, sstable, tokencount
from quillsift.llm.common import scratch_path
from quillsift.llm.tokens import WordEncoder, tokenizer_path

ODD = ["", None, "  ", "áb Å İ H\u0331x don't I'll, it's. <|endoftext|> x<|startoftext|>y 12.5, a\xa0b c \x1cq\x0bz ΑΣ. Σ, \x85 A.B. ...,, ,a a,. \u200b\ufeff x\x00y ǅ ﬁ K ſ 's 'S a'S. q###,", "Ⅷ٣ ½ \U0001f600hi. .", "word " * 9000, "Ein Überläufer, ça va? Él!"]


@pytest.fixture(scope="module")
def enc():
    return WordEncoder(tokenizer_path())


def whole(enc, text):
    return array.array("I", enc.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(None, "no key", 1), (3, "twice", 1), (3, "twice", 1), (-5, "below zero", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long").repartition(3), rows


def test_encoder_equals_library(enc):
    assert enc.encode_many(ODD) == [whole(enc, t) for t in ODD]
    small = WordEncoder(tokenizer_path(), memory=3)
    for t in ODD:
        assert small.encode_many([t, t]) == [whole(enc, t)] * 2


def test_encoder_on_the_table(spark, sf, enc):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert enc.encode_many(texts) == [whole(enc, t) for t in texts]


def check_pieces(pieces, full, size=4096, slack=8):
    """Each id once, sequences gapless, little padding."""
    spans, sequences = {}, {}
    for r in pieces:
        spans.setdefault(r.id, []).append((r.start, r.length, bytes(r.ids), r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, raws in full.items():
        assert sum(n for _, n, _, _ in spans[doc]) == sum(len(x) // 4 for x in raws)
        if len(raws) == 1:
            assert b"".join(x for _, _, x, _ in sorted(spans[doc])) == raws[0] and {t for *_, t in spans[doc]} == {len(raws[0]) // 4}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and (at >= size - slack or at & (at - 1) == 0)


def test_packing(spark, enc):
    df, rows = docs(spark)
    full = {}
    for doc, text, _ in rows:
        full.setdefault(doc, []).append(whole(enc, text) + b"\2\0\0\0")
    check_pieces(packing.pack_documents(df).collect(), full)
    check_pieces(packing.pack_documents(df, size=64, open_windows=2, slack=0, merge_partitions=2).collect(), full, 64, 0)
    assert packing.pack_documents(df.limit(0)).count() == 0 and packing.pack_documents(df, end_id=None).where("id = 0").count() == 0


def test_packing_of_the_table(spark, sf, enc):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    check_pieces(packing.pack_documents(d).collect(), {r.doc_id: [whole(enc, r.text) + b"\2\0\0\0"] for r in d.collect()})


def test_shards(spark, enc):
    df, rows = docs(spark)
    shards = sstable.write_shards(df, scratch_path(spark, "t"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, got = 0, sorted(sstable.read_shards(shards).collect(), key=lambda r: r.start)
    assert len(got) == len(order)
    for r, (doc, text, _) in zip(got, order):
        raw = whole(enc, text) + b"\1\0\0\0"
        assert (r.id, r.start, bytes(r.ids)) == (doc, at, raw)
        at += len(raw) // 4
    assert sstable.lookup(shards, 3) == [x for x in (whole(enc, t) + b"\1\0\0\0" for d, t, _ in order if d == 3)]
    assert sstable.lookup(shards, None) == [whole(enc, "no key") + b"\1\0\0\0"] and sstable.lookup(shards, 77) == []
    assert sstable.read_shards(sstable.write_shards(df.limit(0), scratch_path(spark, "t"))).count() == 0


def test_many_small_shards(spark, enc):
    """Their manifest is one file, and a task reads several of them."""
    rows = [(k, f"word {k} of many") for k in range(400)]
    shards = sstable.write_shards(spark.createDataFrame(rows, "doc_id long, text string"), scratch_path(spark, "t"), shards=60)
    read = sstable.read_shards(shards)
    assert len(shards.inputFiles()) == 1 and shards.count() > 30 and read.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got, at = sorted(read.collect(), key=lambda r: r.start), 0
    for r, (doc, text) in zip(got, rows, strict=True):
        raw = whole(enc, text) + b"\1\0\0\0"
        assert (r.id, r.start, bytes(r.ids)) == (doc, at, raw)
        at += len(raw) // 4


def test_shard_format():
    out = io.BytesIO()
    w = sstable.Writer(out, block_size=200, restart=4)
    keys = [-(2**63), -3, 0, *range(5, 400, 2), 2**63 - 1]
    for k in keys:
        w.add(sstable.key_of(k), array.array("I", [abs(k) % 70000] * (k % 5)).tobytes())
    w.close()
    raw = out.getvalue()
    r = sstable.Reader(io.BytesIO(raw), len(raw))
    assert [k for k, _ in r.scan()] == keys and len(r.index) > 5 and r.n_docs == len(keys)
    for k in keys:
        assert r.get(k) == [array.array("I", [abs(k) % 70000] * (k % 5)).tobytes()]
    assert r.get(6) == [] and sum(r.may_have(sstable.key_of(k)) for k in range(1000, 2000)) < 40
    with pytest.raises(ValueError):
        bad = bytearray(raw)
        bad[3] ^= 255
        list(sstable.Reader(io.BytesIO(bytes(bad)), len(bad)).scan())
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(b"x" * 100), 100)


def test_separators(spark, tmp_path):
    import numpy as np

    files = {"a": [5, 9, 9, 1, 2, 3, 9], "b": [], "c": [1, 2, 3, 4, 5, 6, 7], "d": [9], "e": [1] * 30 + [9] + [2] * 3, "f": [9, 9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files] + [(None,), (f"file://{tmp_path}/a",)], "path string")
    for block in (2, 4, 6, 1 << 20):
        got = sorted((r.path[-1], r.ordinal, r.start, r.n_tokens, r.ended) for r in tokencount.scan_separators(df, end_id=9, block_size=block).collect())
        want = []
        for name, ids in files.items():
            start = k = 0
            for i, x in enumerate(ids):
                if x == 9:
                    want.append((name, k, start, i + 1 - start, True))
                    start, k = i + 1, k + 1
            if start < len(ids):
                want.append((name, k, start, len(ids) - start, False))
        assert got == sorted(want)


def test_token_counts(spark, sf):
    literal = WordEncoder(tokenizer_path(), True)
    want = {r.doc_id: len(literal.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.op5(spark, sf).collect()} == want
    assert zlib.crc32(b"") == 0
