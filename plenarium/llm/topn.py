"""The N best rows of every group (problem 4).

Method: a mergeable aggregation. Every task keeps the N best rows of each group it has seen (a bounded heap, held as
one Arrow table and renewed batch by batch), so that at most N rows per group and task are shuffled. The heaps of a
group are merged afterwards by the same rule. Rows are compared by score, then by the unique identifier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows taken in before the heaps are renewed, and rows held in heaps before they are handed on (a task that sees more
#: groups than that hands on several heaps of a group; the merge takes any number).
RENEW, HOLD = 100_000, 400_000


def _best(rows: pa.Table, n: int) -> pa.Table:
    """The first ``n`` rows of each group by score (descending), then identifier."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("group", "ascending"), ("score", "descending"), ("id", "ascending")]))
    groups = rows.column("group").combine_chunks()
    if len(groups) <= n:
        return rows
    # a row is among the best n if the row n places before it is of another group
    same = pc.fill_null(pc.equal(groups.slice(n), groups.slice(0, len(groups) - n)), False).to_numpy(zero_copy_only=False)
    return rows.filter(pa.array(np.concatenate([np.ones(n, bool), ~same])))


def top_n(df: DataFrame, group: str, score: str, identifier: str, n: int) -> DataFrame:
    """``group``, ``identifier``, ``score`` and ``place`` (1 is best) of the ``n`` best rows of each group.

    Rows with a null group, score or identifier take no part. Ties go to the lower identifier. Repeated rows count one
    by one; a group of fewer than ``n`` rows comes out whole; an empty table gives an empty table. Other columns of
    ``df`` are not read.
    """
    rows = df.select(F.col(group).alias("group"), F.col(identifier).alias("id"), F.col(score).alias("score")).dropna()
    if n < 1:
        rows = rows.limit(0)

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        taken = kept = 0
        for b in batches:
            held.append(b)
            taken += b.num_rows
            if taken - kept >= RENEW:
                best = _best(pa.Table.from_batches(held), n)
                if best.num_rows >= HOLD:
                    yield from best.to_batches()
                    held, taken, kept = [], 0, 0
                else:
                    held, taken, kept = best.to_batches(), best.num_rows, best.num_rows
        if held:
            yield from _best(pa.Table.from_batches(held), n).to_batches()

    partial = rows.mapInArrow(heaps, rows.schema)
    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "id"))
    return partial.withColumn("place", place).where(F.col("place") <= n).select(F.col("group").alias(group), F.col("id").alias(identifier), F.col("score").alias(score), "place")
