"""Archives as a stream (an extension: one file is one book, so no state is kept).

Each micro-batch converts its new archives and hands the files to a writer; books never span
batches, so a batch that is tried again writes the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.convert import book_files, convert


def archive_stream(spark: SparkSession, folder: str, glob: str = "*.epub", at_once: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", at_once).load(folder)
    return raw.select(F.col("path").alias("book_id"), "content")


def convert_stream(archives: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Convert what is there and stop; ``write(files, batch)`` gets each batch's files."""
    return archives.writeStream.foreachBatch(lambda batch, n: write(book_files(convert(batch)), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
