"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in spark.checkpoint.dir; a session on one machine without that setting takes a folder of its own."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tidelog-")  # driver and executor are one process
        sc.setCheckpointDir(path)
    return rows.checkpoint(eager=True)
