"""A gapless row number over a total order, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenarium.lineage import cut

_LOCAL = (1 << 33) - 1


def row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """``name`` from 0 in the order of the columns ``order`` (equal rows in any order).

    Rows are cut into ranges, sorted within them and written to the shared checkpoint folder, so that ranges are the same
    whenever they are read; each range counts its rows; a row's number is its range's offset and its place. The window
    runs over one row per range."""
    # an identifier given after the sort counts rows within a range in its lower 33 bits
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    at = F.shiftright("__i", 33)
    offsets = placed.groupBy(at.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__n")
    offsets = offsets.select("__p", before.alias("__before"))
    return placed.withColumn("__p", at).join(offsets, "__p").withColumn(name, F.col("__before") + F.col("__i").bitwiseAND(F.lit(_LOCAL))).drop("__p", "__i", "__before")
