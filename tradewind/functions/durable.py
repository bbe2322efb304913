"""Cutting lineage before a result is read several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it from there.

    Used where several passes follow an expensive aggregation. A checkpoint outlives the executors that
    wrote it. The folder is the one the cluster names; only a local session may fall back to a temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="tradewind-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
