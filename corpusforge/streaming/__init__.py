"""The stateless cleaners over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.cleaners import CHAIN, clean_frame

DOCUMENT = "path string, content string"


def document_stream(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """Documents (path, content) as Parquet files arrive."""
    return spark.readStream.schema(schema).parquet(path)


def clean_stream(documents: DataFrame, chain=CHAIN) -> DataFrame:
    """The chain, row by row: nothing is kept between batches."""
    return clean_frame(documents, chain=chain)


def write_stream(documents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return documents.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
