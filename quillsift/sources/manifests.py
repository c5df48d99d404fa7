"""Manifest sources: directories, documents in a table, and tables of text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import decode_secret, slashed, trim_space
from ..schemas import SCALARS
from .yamlwalk import walk

PRUNED_DIRS = frozenset((".git", "vendor", "node_modules"))
EXTENSIONS = frozenset((".yaml", ".yml"))
MAX_FILE_SIZE = 5 * 1024 * 1024

FILES = "file string, length bigint, content binary, error string"
_WALKED = f"{SCALARS}, error string"


def list_manifests(target: str) -> Iterator[tuple[str, int]]:
    """Paths and sizes under a directory. Pruned directories, symbolic links and other
    extensions are left out; hidden files aren't."""
    if not os.path.isdir(target):
        raise NotADirectoryError(f"target is not a directory: {target}")
    if os.path.islink(target) or os.path.basename(os.path.normpath(target)) in PRUNED_DIRS:
        return
    pending = [target]
    while pending:
        folder = pending.pop()
        with os.scandir(folder) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name not in PRUNED_DIRS:
                        pending.append(e.path)
                elif os.path.splitext(e.name)[1].lower() in EXTENSIONS and e.is_file(follow_symlinks=False):
                    yield e.path, e.stat(follow_symlinks=False).st_size


def read_manifest(path: str, length: int, max_size: int) -> dict:
    row = {"file": path.replace("\\", "/"), "length": length, "content": None, "error": None}
    if length > max_size:
        return row | {"error": f"file size ({length} bytes) exceeds maximum limit of {max_size} bytes"}
    try:
        with open(path, "rb") as f:
            return row | {"content": f.read()}
    except OSError as e:
        return row | {"error": f"failed to read file: {e.strerror or type(e).__name__}"}


class _Share(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxfilesize", MAX_FILE_SIZE))
        self.parts = max(1, min(int(options.get("partitions", 8)), 4096))

    def partitions(self) -> list[_Share]:
        """The largest files first, each to the share with the fewest bytes so far."""
        import heapq

        files = sorted(list_manifests(self.path), key=lambda f: (-f[1], f[0]))
        shares: list[list] = [[] for _ in range(min(self.parts, max(1, len(files))))]
        heap = [(0, i) for i in range(len(shares))]
        for f in files:
            size, i = heapq.heappop(heap)
            shares[i].append(f)
            heapq.heappush(heap, (size + min(f[1], self.most) + 1024, i))
        return [_Share(s) for s in shares]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for path, length in partition.files:
            r = read_manifest(path, length, self.most)
            yield r["file"], r["length"], r["content"], r["error"]


class ManifestSource(DataSource):
    """``spark.read.format("manifests").load(directory)``: a row for each manifest; options ``maxFileSize`` and ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_directory(spark: SparkSession, target: str, max_file_size: int = MAX_FILE_SIZE, workers: int | None = None) -> DataFrame:
    """``file, length, content, error`` of each manifest under a directory that driver and executors share, or under the URI
    of a store that Spark reads."""
    if "://" in target:
        return read_store(spark, target, max_file_size)
    if not os.path.isdir(target):
        raise NotADirectoryError(f"target is not a directory: {target}")
    spark.dataSource.register(ManifestSource)
    n = max(1, min(workers or 2 * spark.sparkContext.defaultParallelism, 128))
    return spark.read.format("manifests").option("maxFileSize", max_file_size).option("partitions", n).load(target)


def read_store(spark: SparkSession, uri: str, max_file_size: int = MAX_FILE_SIZE) -> DataFrame:
    """The same for any file system that Spark knows: executors list and read. As Spark has it, names that begin with ``.`` or ``_`` are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    inside = F.substr("path", F.lit(len(uri.rstrip("/")) + 1))
    kept = F.lower("path").rlike(r"\.ya?ml\z")
    for name in PRUNED_DIRS:
        kept = kept & ~inside.contains(f"/{name}/")
    found = found.where(kept)
    columns = lambda content, error: (F.col("path").alias("file"), "length", content.alias("content"), error.cast("string").alias("error"))
    said = F.concat(F.lit("file size ("), F.col("length").cast("string"), F.lit(f" bytes) exceeds maximum limit of {max_file_size} bytes"))
    read = found.where(F.col("length") <= max_file_size).select(*columns(F.col("content"), F.lit(None)))
    return read.unionByName(found.where(F.col("length") > max_file_size).select(*columns(F.lit(None).cast("binary"), said)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "doc_index", "resource", "kind", "field_path", "line", "column", "key_name", "nearby_keys", "value", "scan_mode", "error"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for file, content, error in zip(*(batch.column(n).to_pylist() for n in ("file", "content", "error"))):
            rows: list[dict] = []
            if error is None:
                found = walk(content if content is not None else b"")
                rows = [r | {"file": file, "nearby_keys": []} for r in found.scalars] + [{"file": file, "error": e} for e in found.errors]
            else:
                rows = [{"file": file, "error": error}]
            for k in range(0, len(rows), 10_000):
                part = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in part], t) for n, t in zip(names, kinds)], names=names)


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``scalars``, ``errors`` and the cached relation that both read, of a relation of files (``file, content, error``). The entries of a Secret's data are decoded:
    what isn't base64 becomes an error that names the key only, binary payloads are left out."""
    from pyspark import StorageLevel

    # read by two branches; spilled blocks are recomputed from the files if an executor is lost
    walked = files.select("file", F.col("content").cast("binary").alias("content"), "error").mapInArrow(_walk, _WALKED).persist(StorageLevel.MEMORY_AND_DISK)
    plain = walked.where("error is null")
    data = plain.where("scan_mode = 'secret_data'").withColumn("value", trim_space(F.col("value"))).where("value <> ''").withColumn("__d", decode_secret(F.col("value")))
    opened = data.where("not __d.error and __d.text is not null").withColumn("value", F.col("__d.text")).withColumn("scan_mode", F.lit("full")).drop("__d")
    scalars = plain.where("scan_mode <> 'secret_data'").unionByName(opened).drop("error")
    undecoded = data.where("__d.error").select("file", F.concat(F.lit("failed to decode Secret."), "field_path", F.lit(": invalid base64 encoding")).alias("message"))
    return scalars, walked.where("error is not null").select("file", F.col("error").alias("message")).unionByName(undecoded), walked


def from_documents(df: DataFrame, name_col: str, text_col: str) -> DataFrame:
    """A table of named YAML texts as files; names with backslashes get slashes."""
    return df.select(slashed(F.col(name_col)).alias("file"), F.octet_length(text_col).cast("long").alias("length"), F.col(text_col).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
