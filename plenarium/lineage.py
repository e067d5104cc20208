"""Folders shared by all machines: cutting long lineages in a way that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """A new folder name in the session's ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a
    temporary folder of its own; on a cluster such a folder would not be shared, so that it is an error there."""
    base = session.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not session.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        base = tempfile.mkdtemp(prefix="plenarium-")
    return f"{base.rstrip('/')}/plenarium-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it with its lineage cut. The copy is reliable: executors may
    be lost afterwards."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables of fewer bytes than that are spread over all cores, whatever their files look like.
SMALL = 256 << 20


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """``df``, made by narrow steps from the table ``scan``, over all cores if the table has less than ``SMALL`` bytes (its
    few row groups would leave cores idle). A larger table stays as it is: there its rows are never shuffled."""
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL else df
