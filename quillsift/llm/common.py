"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    It is the one that ``spark.checkpoint.dir`` names. Where that is unset, a
    local session gets a temporary folder; a cluster session is refused, as a
    machine-local folder would lose data there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quillsift-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/quillsift-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: this cuts lineage and
    computes it once, and the files outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # the shuffles of this one query aren't needed after it
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before) if before is not None else spark.conf.unset(CLEAN_SHUFFLES)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame | None) -> None:
    """Delete what ``write_table`` wrote, once everything that reads it is written itself."""
    if df is None:
        return
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is computed once: a lambda binds it, so that
    no optimiser rule can copy it into several places."""
    return F.element_at(F.transform(F.array(value), body), 1)


def none_if_empty(n: Column, then: Column, otherwise: Column) -> Column:
    return F.when(n > 0, then).otherwise(otherwise)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, and what separates the words of the alphanumeric kind.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for an ASCII text, and much faster
    than ``translate``, which other texts need."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def alnum_words(text: Column) -> Column:
    """Words of ASCII digits, letters and all characters beyond ASCII, A-Z lower-cased; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
