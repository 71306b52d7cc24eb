"""Cutting long plans: a table that many later steps read is computed once, into the folder that executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stage(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in ``spark.checkpoint.dir``; a folder of our own only where the session names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="docsearch-"))
    return df.checkpoint()
