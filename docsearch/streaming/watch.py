"""Continuous ingestion: a stream of new files in a folder; each micro-batch is compared with the manifest, so repeated ones do no harm.

A stream of files tells neither of edits nor of removals, nor of empty files: those come with the next ``Pipeline.ingest``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docsearch.pipeline import Pipeline

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(pipeline: Pipeline, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts a query that ingests files as they appear in a folder; with ``once``, for what is there now."""
    files = pipeline.spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            pipeline.ingest_files(rows, folder)

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()
