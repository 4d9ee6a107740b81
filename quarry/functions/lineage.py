"""Cutting a plan's lineage with files that all executors can read."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that spark.checkpoint.dir names; a folder of our own only where all of Spark runs in this process."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()
