"""Mentions as a stream (an extension: the batch operators kept up to date while rows arrive).

Late and repeated deliveries are part of the data: rows carry the day of the session (event time) and the time of
loading. State is bounded by watermarks on the load time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_redelivery(stream: DataFrame, keys: list[str], loaded: str = "loaded_at", delay: str = "30 days") -> DataFrame:
    """Each row once, however often it is delivered within ``delay`` of load time."""
    return stream.withWatermark(loaded, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, key: str, time: str, width: str, delay: str) -> DataFrame:
    """Rows per key and window of event time; rows later than ``delay`` are left out once their window is closed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there and stop; a second call goes on where the first ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.format("parquet").option("path", path).start().awaitTermination()
