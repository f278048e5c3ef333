"""Cutting the lineage of tables that are read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the shared folder that ``spark.checkpoint.dir`` names (a local one only for tests on one machine)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint()
