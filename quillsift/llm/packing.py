"""Packing: documents' tokens into sequences of a fixed size.

Bounded-space online packing. Each partition keeps a fixed number of open
windows and places a document's last piece best-fit: into the window where it leaves the
smallest gap. If none fits and all windows are in use, the fullest is emitted;
when its gap is over ``slack``, the piece's head fills it first. What stays open at
the end of the partitions is merged, a fixed number of partitions at a time, so
that no task holds more than ``merge_partitions * open_windows * size`` ids.

Edge cases: null and empty texts have the end id only (no pieces if ``end_id`` is None);
a null id is kept; repeated rows are packed each; texts of any length are cut
into whole sequences; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table
from .tokens import encoded, tokenizer_path

_SCHEMA = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, open boolean"
_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_())])
_FLUSH = 8 << 20


class Rows:
    """Rows gathered until they are worth a batch."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.size = schema, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, values: tuple, size: int = 64) -> None:
        for column, v in zip(self.columns, values):
            column.append(v)
        self.size += size

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.size = [[] for _ in self.schema], 0
        return out


class Windows:
    """The open windows of a partition. ``put`` returns the windows that are complete,
    each a list of pieces (document, start, ids)."""

    def __init__(self, size: int, most: int, slack: int):
        self.size, self.most, self.slack = size, most, slack
        self.gaps: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.made = 0

    def put(self, doc, start: int, ids: memoryview) -> list[list]:
        done = []
        while len(ids) // 4 >= self.size:
            done.append([(doc, start, ids[: 4 * self.size])])
            start, ids = start + self.size, ids[4 * self.size :]
        n = len(ids) // 4
        if not n:
            return done
        k = bisect_left(self.gaps, (n, -1))
        if k == len(self.gaps):
            if len(self.gaps) == self.most:
                gap, w = self.gaps.pop(0)
                if gap > self.slack:
                    self.pieces[w].append((doc, start, ids[: 4 * gap]))
                    start, ids, n = start + gap, ids[4 * gap :], n - gap
                done.append(self.pieces.pop(w))
            self.made += 1
            self.pieces[self.made] = []
            insort(self.gaps, (self.size, self.made))
            k = bisect_left(self.gaps, (n, -1))
        gap, w = self.gaps.pop(k)
        self.pieces[w].append((doc, start, ids))
        if gap > n:
            insort(self.gaps, (gap - n, w))
        else:
            done.append(self.pieces.pop(w))
        return done


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, size: int, most: int, slack: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    end = b"" if end_id is None else end_id.to_bytes(4, "little")
    windows, rows, made = Windows(size, most, slack), Rows(_ARROW), 0

    def emit(window: list, is_open: bool) -> None:
        nonlocal made
        sequence, at = (part << 32) + made, 0
        made += 1
        for (doc, total), start, ids in window:
            n = len(ids) // 4
            rows.add((doc, start, n, bytes(ids), total, sequence, at, part, is_open), len(ids) + 64)
            at += n

    for docs, chunk in encoded(batches, path):
        for doc, raw in zip(docs, chunk):
            raw += end
            for window in windows.put((doc, len(raw) // 4), 0, memoryview(raw)):
                emit(window, False)
                if rows.size > _FLUSH:
                    yield rows.batch()
    for w in sorted(windows.pieces):
        emit(windows.pieces[w], True)
    yield rows.batch()


def _merge(table: pa.Table, size: int, merge_partitions: int) -> pa.Table:
    """Whole windows first go together best-fit, the largest first; what then stays open is
    joined end to end, and the last sequence ends in lengths that are powers of two."""
    table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    windows: dict[int, list] = {}
    for r in table.to_pylist():
        windows.setdefault(r["sequence_id"], []).append(((r["id"], r["doc_tokens"]), r["start"], memoryview(r["ids"])))
    rows, made = Rows(_ARROW), 0
    group = (1 << 62) + ((table.column("part")[0].as_py() // merge_partitions) << 32)

    def emit(pieces: list) -> None:
        nonlocal made
        at = 0
        for (doc, total), start, ids in pieces:
            rows.add((doc, start, len(ids) // 4, bytes(ids), total, group + made, at, None, False))
            at += len(ids) // 4
        made += 1

    fill = lambda pieces: sum(len(p[2]) // 4 for p in pieces)
    gaps: list[tuple[int, int]] = []
    bins: list[list] = []
    for pieces in sorted(windows.values(), key=fill, reverse=True):
        n = fill(pieces)
        k = bisect_left(gaps, (n, -1))
        if k == len(gaps):
            bins.append([])
            gaps.append((size, len(bins) - 1))
        gap, b = gaps.pop(k)
        bins[b] += pieces
        insort(gaps, (gap - n, b))
    rest = []
    for gap, b in gaps:
        if gap == 0:
            emit(bins[b])
        else:
            rest += bins[b]
    left = fill(rest)
    while left:
        want = size if left >= size else 1 << (left.bit_length() - 1)
        pieces, left = [], left - want
        while want:
            doc, start, ids = rest.pop(0)
            if len(ids) // 4 > want:
                rest.insert(0, (doc, start + want, ids[4 * want :]))
                ids = ids[: 4 * want]
            pieces.append((doc, start, ids))
            want -= len(ids) // 4
        emit(pieces)
    return pa.Table.from_batches([rows.batch()])


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int | None = 2,
    size: int = 4096, open_windows: int = 32, slack: int = 8, merge_partitions: int = 16,
) -> DataFrame:
    """Pieces of all documents: ``id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit integers. A
    sequence is its pieces in the order of ``offset``; one that is neither full nor a power of
    two long has at most ``slack`` free places.
    """
    path = tokenizer or tokenizer_path()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    first = write_table(source.mapInArrow(lambda it: _pack(it, path, end_id, size, open_windows, slack), _SCHEMA), "packed")
    merged = (
        first.filter("open").groupBy(F.floor(F.col("part") / merge_partitions).alias("merge_group"))
        .applyInArrow(lambda t: _merge(t.drop_columns(["merge_group"]) if "merge_group" in t.column_names else t, size, merge_partitions), _SCHEMA)
    )
    return first.filter("not open").unionByName(merged).drop("part", "open")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
