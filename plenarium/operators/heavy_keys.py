"""Per-key results without the imbalance of a few heavy keys (problem 3).

Method: value-frequency compression. Rows are grouped by key *and* value first; equal rows of a heavy key melt into one
weighted row before the shuffle, spread over as many tasks as the key has values. Exact distinct counts, modes and
percentiles are then derived from the weighted values of each key.

A key whose values are nearly all different is still spread: the second grouping is two-step as well (sums and counts
have partial results), and the cumulative weights of percentiles and modes come from bounded partial results of value
ranges rather than from one sorted key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Value ranges a key is spread over when its weighted values are put in order.
RANGES = 64


def compress(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key``, ``value``, ``weight``: the different values of each key with the number of rows. Nulls are values."""
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("weight"))


def key_profile(weighted: DataFrame) -> DataFrame:
    """``key``, ``n_rows``, ``n_values`` (exact distinct non-null values), ``mode_value`` and ``mode_rows``.

    Equally frequent values: the lowest is the mode. A key without a non-null value has 0 values and a null mode. The
    null key is a key of its own. Partial aggregation bounds what a heavy key sends to one row per map task.
    """
    filled = F.col("value").isNotNull()
    # least of (-weight, value): the most rows, then the lowest value
    best = F.min(F.when(filled, F.struct((-F.col("weight")).alias("minus"), F.col("value").alias("value"))))
    return (
        weighted.groupBy("key")
        .agg(F.sum("weight").alias("n_rows"), F.count(F.when(filled, 1)).alias("n_values"), best.alias("best"))
        .select("key", "n_rows", "n_values", F.col("best.value").alias("mode_value"), (-F.col("best.minus")).alias("mode_rows"))
    )


def key_percentile(weighted: DataFrame, share: float) -> DataFrame:
    """``key`` and ``percentile_value``: the lowest non-null value at or below which at least ``share`` of the key's
    non-null rows lie. Keys without a non-null value have no row. The key may be null.

    Exact, and no key is sorted in one task: values (numbers) are cut into ``RANGES`` ranges between the key's least and
    greatest; range totals give the range that holds the percentile, and only that range is searched, value by value."""
    w = weighted.where(F.col("value").isNotNull())
    span = w.groupBy(F.col("key").alias("k")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("weight").alias("total"))
    width = F.col("high").cast("double") - F.col("low")
    at = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("value").cast("double") - F.col("low")) / width * RANGES).cast("int"))).otherwise(F.lit(0))
    cut = w.join(span, F.col("key").eqNullSafe(F.col("k"))).select("key", "value", "weight", "total", at.alias("range"))
    before = F.sum("weight").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = cut.groupBy("key", "range").agg(F.sum("weight").alias("weight"), F.max("total").alias("total")).withColumn("upto", before)
    need = F.ceil(F.col("total") * share)
    holding = ranges.where((F.col("upto") >= need) & (F.col("upto") - F.col("weight") < need)).select(F.col("key").alias("k"), F.col("range").alias("r"), (F.col("upto") - F.col("weight")).alias("base"))
    inside = cut.join(holding, F.col("key").eqNullSafe(F.col("k")) & (F.col("range") == F.col("r")))
    upto = F.col("base") + F.sum("weight").over(Window.partitionBy("key", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("upto", upto).where(F.col("upto") >= need).groupBy("key").agg(F.min("value").alias("percentile_value"))


def heavy_keys(weighted: DataFrame, share: float = 0.03) -> DataFrame:
    """Non-null keys that hold at least ``share`` of all rows (rows with a null key count in the total), with
    ``n_rows``. An empty table has none. The total is an aggregate of the keys' sums; at most 1 / ``share`` rows."""
    keys = weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"))
    total = keys.agg(F.sum("n_rows")).scalar()
    return keys.where(F.col("key").isNotNull() & (F.col("n_rows") >= total * share))
