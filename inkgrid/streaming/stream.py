"""Images that arrive as files, as a stream of text lines.

All steps work inside one image and a file brings its image whole, so no state and no watermark are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Pipeline
from ..sources.images import decode, stream_files


def stream_lines(spark: SparkSession, path: str, pipeline: Pipeline, pattern: str = "*.png") -> DataFrame:
    return pipeline.transform(decode(stream_files(spark, path, pattern)))


def write_lines(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each file once."""
    return lines.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
