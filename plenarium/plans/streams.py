"""Queries over the event stream, run to its end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenarium.lineage import shared_folder
from plenarium.sources.tables import table
from plenarium.streaming import speeches as S


def s1_hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events per type and six hours, by a streaming aggregation with a watermark; the windows closed at the end."""
    schema = table(spark, folder, "events").schema
    stream = S.read_stream(spark, f"{folder}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared_folder(spark)
    S.run_to_table(S.windowed_counts(stream, "event_type", "ts", "6 hours", "1 day"), f"{out}/table", f"{out}/state")
    return spark.read.parquet(f"{out}/table").withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (s1_hourly_events,)}

ORACLE = {
    "s1_hourly_events": """
        WITH e AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, ts FROM events)
        SELECT start, event_type, count(*) AS n FROM e WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 DAY GROUP BY 1, 2""",
}
