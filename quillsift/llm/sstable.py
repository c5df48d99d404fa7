"""Sorted-string-table shards: documents keyed by identifier.

A file holds blocks of entries in ascending key order, then a Bloom filter, a
sparse index of the blocks and a footer of fixed size:

    block   entries: varint shared key bytes, varint further key bytes, varint value bytes, key rest, value;
            then the places of the restart entries (whole keys) and their count, 32 bits each; stored as a zstd frame
    bloom   bits, by double hashing of the key's XXH64
    index   for each block: last key, place, stored size, crc32
    footer  places and sizes of index and bloom, entries, tokens, hash count, magic

A key is 0x00 for null, else 0x01 and the identifier as 8 bytes, big end first, sign flipped, so that
bytes compare as the identifiers do. A value is a byte with the width of an id (2 or 4) and the ids.

Edge cases: null identifiers come first; repeated identifiers keep an entry each, in the order of their shards, then of their ids;
one that fills more than a shard is dealt over several;
null and empty texts have the end id only; an empty table gives no file; other columns aren't read.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, write_table
from .packing import Rows
from .tokens import encoded, tokenizer_path

MAGIC = b"QSSST001"
_FOOTER = struct.Struct("<QQQQQQI8s")
#: Identifiers that the bounds of shards are taken from, at most.
SAMPLE = 1_000_000
#: Tokens that a task reads back, about, where shards are smaller.
READ_TOKENS = 4_000_000
_DEALT = "id long, shard long, value binary"
_DEALT_ARROW = pa.schema([("id", pa.int64()), ("shard", pa.int64()), ("value", pa.binary())])
_MANIFEST = "shard long, path string, n_docs long, n_tokens long"
_READ = "id long, start long, n_tokens long, ids binary"
_READ_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def key_of(doc: int | None) -> bytes:
    return b"\0" if doc is None else b"\1" + struct.pack(">Q", (doc + (1 << 63)) & (1 << 64) - 1)


def doc_of(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh64_intdigest(key)
    return h & 0xFFFFFFFF, h >> 32 | 1


def _value(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return b"\2" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\4" + ids


def _ids(value: bytes) -> bytes:
    return np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes() if value[0] == 2 else value[1:]


class Writer:
    """Writes one shard to ``out``; ``add`` takes keys in ascending order."""

    def __init__(self, out, block_size: int = 1 << 16, restart: int = 16, bits_per_key: int = 10):
        import zstandard

        self.out, self.block_size, self.restart, self.bits_per_key = out, block_size, restart, bits_per_key
        self.pressed = zstandard.ZstdCompressor(level=1)
        self.place, self.index, self.hashes = 0, [], []
        self.n_docs = self.n_tokens = 0
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.starts, self.count, self.last = [], 0, [], 0, b""

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.place += len(raw)

    def add(self, key: bytes, ids: bytes) -> None:
        self.add_value(key, _value(ids))

    def add_value(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.count % self.restart:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        else:
            self.starts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.count, self.last = self.count + 1, key
        self.hashes.append(_hashes(key))
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + (len(value) - 1) // value[0]
        if self.size >= self.block_size:
            self._end_block()

    def _end_block(self) -> None:
        if self.count:
            raw = self.pressed.compress(b"".join(self.block) + struct.pack(f"<{len(self.starts)}II", *self.starts, len(self.starts)))
            self.index.append((self.last, self.place, len(raw), zlib.crc32(raw)))
            self._write(raw)
        self._fresh()

    def close(self) -> None:
        self._end_block()
        bits, rounds = max(64, self.n_docs * self.bits_per_key), 7
        a, b = (np.array(x, np.uint64) for x in zip(*self.hashes)) if self.hashes else (np.zeros(0, np.uint64),) * 2
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for k in range(rounds):
            at = (a + np.uint64(k) * b) % np.uint64(bits)
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        bloom_at = self.place
        self._write(struct.pack("<Q", bits) + bloom.tobytes())
        index_at = self.place
        self._write(b"".join(_varint(len(k)) + k + struct.pack("<QQI", *rest) for k, *rest in self.index))
        self.out.write(_FOOTER.pack(index_at, self.place - index_at, bloom_at, index_at - bloom_at, self.n_docs, self.n_tokens, rounds, MAGIC))


class Reader:
    """Reads one shard: ``get`` by binary search, ``scan`` in order."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.plain = file, zstandard.ZstdDecompressor()
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_tokens, self.rounds, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        bloom = self._at(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        raw, at, self.index = self._at(index_at, index_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQI", raw, at + n)))
            at += n + 20

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _block(self, k: int) -> bytes:
        _, place, n, crc = self.index[k]
        raw = self._at(place, n)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        return self.plain.decompress(raw)

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def may_have(self, key: bytes) -> bool:
        a, b = _hashes(key)
        return all(self.bloom[x >> 3] >> (x & 7) & 1 for x in ((a + k * b) % self.bits for k in range(self.rounds)))

    def get(self, doc: int | None) -> list[bytes]:
        """The ids of each entry with this identifier."""
        key, out = key_of(doc), []
        if not self.may_have(key):
            return out
        for k in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            raw = self._block(k)
            n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
            end = len(raw) - 4 - 4 * n
            starts = struct.unpack_from(f"<{n}I", raw, end)
            low, high = 0, n - 1
            while low < high:  # the last restart entry below the key
                mid = (low + high + 1) // 2
                if next(self._entries(raw, starts[mid], end))[0] < key:
                    low = mid
                else:
                    high = mid - 1
            for found, value in self._entries(raw, starts[low], end):
                if found == key:
                    out.append(_ids(value))
                elif found > key:
                    return out
        return out

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            raw = self._block(k)
            end = len(raw) - 4 - 4 * struct.unpack_from("<I", raw, len(raw) - 4)[0]
            for key, value in self._entries(raw, 0, end):
                yield doc_of(key), _ids(value)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, none_shards: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``id, shard, value`` of each document. A shard holds the identifiers from its bound to the next; a key that
    several bounds name, or null, is dealt over their shards by a hash of its value."""
    end, rows = b"" if end_id is None else end_id.to_bytes(4, "little"), Rows(_DEALT_ARROW)
    for docs, chunk in encoded(batches, path):
        for doc, ids in zip(docs, chunk):
            value = _value(ids + end)
            if doc is None:
                shard = zlib.crc32(value) % none_shards
            else:
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                shard = none_shards + int(high) - zlib.crc32(value) % max(1, int(high - low))
            rows.add((doc, shard, value), len(value) + 32)
        if rows.size > 8 << 20:
            yield rows.batch()
    yield rows.batch()


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A file for each shard. A repeated attempt writes another one; only the
    file of the attempt that ended is in the manifest."""
    writer = out = uri = own = None

    def close() -> pa.RecordBatch:
        writer.close()
        out.close()
        return pa.RecordBatch.from_pydict({"shard": [own], "path": [uri], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    for batch in batches:
        for doc, shard, value in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != own:
                if writer is not None:
                    yield close()
                own, uri = shard, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                files, local = _filesystem(uri)
                files.create_dir(posixpath.dirname(local), recursive=True)
                out = files.open_output_stream(local)
                writer = Writer(out)
            writer.add_value(key_of(doc), value)
    if writer is not None:
        yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(_READ_ARROW)
    for batch in batches:
        for shard in batch.to_pylist():
            files, local = _filesystem(shard["path"])
            with files.open_input_file(local) as file:
                start = shard["base"]
                for doc, ids in Reader(file, file.size()).scan():
                    rows.add((doc, start, len(ids) // 4, ids), len(ids) + 64)
                    start += len(ids) // 4
                    if rows.size > 8 << 20:
                        yield rows.batch()
    yield rows.batch()


def _bounds(ids: DataFrame, shards: int) -> tuple[int, np.ndarray]:
    """The number of shards for null and the bounds of the others, from a sample of the identifiers as a range
    partitioner takes it: ``SAMPLE`` at most, whatever the corpus. They only decide how even the shards are."""
    total, none = ids.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    want = min(100 * shards, SAMPLE)
    share = min(1.0, want / max(1, total - none))
    sample = ids.where("id is not null").sample(share, 42).limit(2 * SAMPLE).toPandas()["id"].to_numpy(np.int64)
    sample = np.sort(sample)
    at = np.arange(1, shards) * len(sample) // shards
    return max(1, -(-shards * none // max(1, total))), sample[at] if len(sample) else sample


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 1, shards: int | None = None) -> DataFrame:
    """Write all documents to shards in ``folder``, in ascending order of their identifiers; ``shards``: about as many (default: as the
    input has partitions). Texts become ids where they are read, so that only ids are shuffled.
    The manifest: ``shard, path, n_docs, n_tokens, base``, base being the tokens of all shards before."""
    path = tokenizer or tokenizer_path()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    none_shards, bounds = _bounds(source.select("id"), shards or max(1, docs.rdd.getNumPartitions()))
    values = source.mapInArrow(lambda it: _encode(it, path, end_id, none_shards, bounds), _DEALT)
    dealt = values.repartitionById(none_shards + len(bounds) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", "value")
    # a row for each shard: one small file, not one for each task
    manifest = write_table(dealt.mapInArrow(lambda it: _write(it, folder), _MANIFEST).repartition(1), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids`` of every document in the shards; a task reads several small ones."""
    shards, tokens = manifest.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n = max(1, min(shards, max(manifest.sparkSession.sparkContext.defaultParallelism, -(-tokens // READ_TOKENS))))
    return manifest.repartition(n).mapInArrow(_read, _READ)


def lookup(manifest: DataFrame, doc: int | None) -> list[bytes]:
    """Ids of the entries with this identifier, by Bloom filter and binary search in each shard."""
    found = []
    for row in manifest.orderBy("shard").select("path").toLocalIterator():
        files, local = _filesystem(row.path)
        with files.open_input_file(local) as file:
            found += Reader(file, file.size()).get(doc)
    return found


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = write_shards(docs, scratch_path(spark, "sst"))
    return read_shards(shards).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
