"""Cutting the lineage of what later steps read more than once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows as files in the folder ``spark.checkpoint.dir``, which all executors share: later plans begin there, and
    a lost executor costs no rerun of what came before.  Where that setting is absent, a temporary folder takes its place
    if driver and executors are one process, as in tests; on a cluster that is an error."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
