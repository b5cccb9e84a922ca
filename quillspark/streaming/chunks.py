"""Documents that arrive as files, chunked as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark import schemas
from quillspark.operators.chunking import chunk_documents


def stream_chunks(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Chunks of the JSON-lines documents that appear in a folder; chunking is row-local, so the stream needs no state."""
    docs = spark.readStream.schema(schemas.RECORDS["document"]).option("maxFilesPerTrigger", files_a_batch).json(folder)
    return chunk_documents(docs.drop("metadata"))


def write_chunks(chunks: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table once for every input file, until no new files are there."""
    return chunks.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
