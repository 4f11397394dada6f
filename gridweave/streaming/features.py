"""Features that arrive as files of lines: decoded and counted as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweave.sources import geojson


def read(spark: SparkSession, folder: str, files: int = 64) -> DataFrame:
    """Features of the files in a folder, at most so many files a batch."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(folder).where(F.length(F.trim("value")) > 0)
    return geojson.decode(lines.select(F.lit(None).cast("long").alias("ordinal"), F.col("value").alias("text")))


def counts(features: DataFrame) -> DataFrame:
    """(object_type, n), kept up to date: the state has a row a type."""
    return features.groupBy("object_type").agg(F.count(F.lit(1)).alias("n"))


def store(features: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append features to Parquet by type, until what has arrived is used up; run again with the same checkpoint to go on."""
    return features.writeStream.format("parquet").partitionBy("object_type").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
