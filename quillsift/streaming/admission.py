"""Admission reviews as a stream: stateless, in append mode, so without watermark or state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import PolicyConfig, admit


def read_reviews(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of request bodies: one JSON document a line, in files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).withColumnRenamed("value", "body")


def serve(bodies: DataFrame, out: str, checkpoint: str, config: PolicyConfig = PolicyConfig(), once: bool = False, **options) -> StreamingQuery:
    """Write responses and rejected bodies' reasons under ``out``. The body itself is never written."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            responses, rejects = admit(batch, config, **options)
            # the batch number makes a repeated batch overwrite itself
            responses.write.mode("overwrite").json(f"{out}/responses/batch={number}")
            rejects.select("status", "reason").write.mode("overwrite").json(f"{out}/rejects/batch={number}")
        finally:
            batch.unpersist()

    writer = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
