"""Continuous ingest: files that arrive in a folder become chunks of the index, source by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, generate, index


def ingest_stream(spark: SparkSession, folder: str, target: str, collection: str, checkpoint: str, backends: generate.Backends = generate.OFFLINE) -> StreamingQuery:
    """Read new text files, chunk and embed them, and replace their sources; repeated batches write the same rows."""

    def batch(rows: DataFrame, _: int) -> None:
        chunks = chunking.build_chunks(rows, "path", "source_name")
        index.ingest(target, collection, generate.embed(chunks, "text", backends=backends))

    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    docs = files.select(F.col("value").alias("text"), F.input_file_name().alias("path"), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("source_name"))
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
