"""Streaming ingest: files of a folder once each by content, with resume and a status table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.text import content_key, is_pdf
from lodestar.operators.tables import upsert
from lodestar.sources.files import append_new


def watch(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 1000, archive: str | None = None) -> DataFrame:
    """New valid files of a folder as a stream: path, sha256, object_key, size_bytes. Files that are done move to ``archive``."""
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).schema("path string, modificationTime timestamp, length long, content binary")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder)
    return files.filter(is_pdf(F.col("content"))).select("path", F.sha2("content", 256).alias("sha256"), content_key(F.col("content")).alias("object_key"), F.col("length").alias("size_bytes"))


def ingest(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append the first row of each key to a Parquet table and stop when the input is read; the checkpoint resumes."""
    return stream.dropDuplicates([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_new(stream: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """As :func:`ingest`, without state that grows: each batch is held against the table, so a batch that runs twice adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        append_new(batch.sparkSession, batch.dropDuplicates([key]), path, key)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lifecycle(status: DataFrame, events: DataFrame) -> DataFrame:
    """The status table (sha256, status, at) after status events of the same columns; the latest wins."""
    return upsert(status, events, ["sha256"], "at")


def pending(status: DataFrame, limit: int | None = None) -> DataFrame:
    """Uploaded documents that are not extracted yet, the oldest first."""
    out = status.filter(F.col("status") == "uploaded").orderBy("at", "sha256")
    return out.limit(limit) if limit else out
