"""New message files as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from mailcorpus.sources import mail


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Decode files below ``folder`` once each and append them to the Parquet table; it can be read meanwhile.

    The checkpoint is the progress: a restart goes on after the last complete batch.
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.eml").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    parsed = mail.parse_messages(files)
    return parsed.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
