"""Token counts of flat token files that have no index.

Separator scan. A file is a row of ids of fixed width; documents end with an
end-of-document identifier. Blocks of the files are read in parallel and searched for that identifier
with one vectorised comparison each. A document may span blocks: a prefix scan
over the blocks' counts gives each block the number of documents before it and
the place of the last end before it, so that every end knows its document's number and start.

Edge cases: an empty file has no documents; ids after a file's last end count as one
more document with ``ended`` false; two ends in a row give an empty document.
For ``write_flat``: null and empty texts have the end id only; null ids and repeated rows stay; other columns aren't read.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, write_table
from .packing import Rows
from .sstable import _filesystem
from .tokens import encoded, tokenizer_path

#: The tokenizer's <|endoftext|>; its string in a text is ordinary text here.
END = 49407
_WRITTEN = "id long, path string, ordinal long"
_WRITTEN_ARROW = pa.schema([("id", pa.int64()), ("path", pa.string()), ("ordinal", pa.int64())])
_BLOCKS = "path string, block long, n_ids long, n_ends long, last_end long"


def _flat(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    uri = f"{folder}/tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
    out, rows, n, end = None, Rows(_WRITTEN_ARROW), 0, end_id.to_bytes(2, "little")
    for docs, chunk in encoded(batches, path, True):
        if out is None:
            files, local = _filesystem(uri)
            files.create_dir(posixpath.dirname(local), recursive=True)
            out = files.open_output_stream(local)
        out.write(b"".join(np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end for ids in chunk))
        for doc in docs:
            rows.add((doc, uri, n))
            n += 1
        if rows.size > 8 << 20:
            yield rows.batch()
    if out is not None:
        out.close()
        yield rows.batch()


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    """A flat file of 16-bit ids for each partition; ``id, path, ordinal`` of the documents in them."""
    path = tokenizer or tokenizer_path()
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return write_table(source.mapInArrow(lambda it: _flat(it, folder, path, end_id), _WRITTEN), "flat")


def _block(path: str, block: int, size: int, width: int) -> np.ndarray:
    files, local = _filesystem(path)
    with files.open_input_file(local) as file:
        file.seek(block * size)
        return np.frombuffer(file.read(size), f"<u{width}")


def _sizes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, local = _filesystem(path)
            n = -(-files.get_file_info(local).size // size)
            for k in range(0, n, 4096):
                own = min(4096, n - k)
                yield pa.RecordBatch.from_pydict({"path": [path] * own, "block": list(range(k, k + own))})


def _count(batches: Iterator[pa.RecordBatch], size: int, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, block in zip(*(c.to_pylist() for c in batch.columns[:2])):
            ids = _block(path, block, size, width)
            ends = np.flatnonzero(ids == end_id)
            last = int(ends[-1]) + block * (size // width) if len(ends) else None
            yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "n_ids": [len(ids)], "n_ends": [len(ends)], "last_end": pa.array([last], pa.int64())})


def _number(batches: Iterator[pa.RecordBatch], size: int, width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids, base = _block(r["path"], r["block"], size, width), r["block"] * (size // width)
            ends = np.flatnonzero(ids == end_id) + base
            starts, done = np.concatenate([[r["open_from"]], ends + 1]), np.ones(len(ends), bool)
            if r["is_last"] and starts[-1] < base + len(ids):
                ends, done = np.append(ends, base + len(ids) - 1), np.append(done, False)
            n = len(ends)
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["path"]] * n, pa.string()), pa.array(np.arange(n) + r["docs_before"]), pa.array(starts[:n]), pa.array(ends - starts[:n] + 1), pa.array(done)],
                    names=["path", "ordinal", "start", "n_tokens", "ended"],
                )


def scan_separators(files: DataFrame, end_id: int = END, width: int = 2, block_size: int = 4 << 20) -> DataFrame:
    """``path, ordinal, start, n_tokens, ended`` of each document in the files of column
    ``path``. ``n_tokens`` holds the end identifier. ``block_size`` is in bytes, a multiple of ``width``."""
    if block_size % width:
        raise ValueError("block_size must be a multiple of width")
    paths = files.select(F.col("path").cast("string")).where("path is not null").distinct()
    listed = paths.mapInArrow(lambda it: _sizes(it, block_size), "path string, block long").repartition("path", "block")
    blocks = write_table(listed.mapInArrow(lambda it: _count(it, block_size, width, end_id), _BLOCKS), "blocks")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "path", "block",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max("last_end").over(before), F.lit(-1)) + 1).alias("open_from"),
        F.lead("block").over(order).isNull().alias("is_last"),
    )
    dealt = stitched.repartition("path", "block")
    return dealt.mapInArrow(lambda it: _number(it, block_size, width, end_id), "path string, ordinal long, start long, n_tokens long, ended boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = write_flat(docs, scratch_path(spark, "flat-files"))
    found = scan_separators(written)
    return written.join(found.hint("merge"), ["path", "ordinal"]).select(F.col("id").alias("doc_id"), "ordinal", "start", "n_tokens", F.regexp_extract("path", r"tokens-(\d+)", 1).cast("long").alias("file"))
